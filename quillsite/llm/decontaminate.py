"""Benchmark decontamination by size-partitioned MinHash containment search.

A document leaks an item if it has at least 0.8 of the item's 5-word shingles, however long the document is. Items are
partitioned by size (four partitions for each doubling). An item's sketch is its bottom-k MinHash values, k being one more
than the shingles that may be missing at the upper size of its partition; a document that leaks the item must have one
of these k. Each partition has a cut-off, the largest value in a sketch of its items, and a document is searched for the
values up to the largest cut-off. Equal values make a candidate; a candidate is verified by counting the item's shingles
in the document, word by word.

Only DataFrame functions run here. A document's values are looked up where its text is read and not shuffled; documents
that no sketch value touches are never verified. The sketches and the items' shingles are broadcast if they fit; if they
don't, a bit map of the sketches is broadcast instead, and only values that it may hold are shuffled.

Words are parted by ASCII white space; A-Z are lower-cased.

Cases: an item with fewer than five words is one shingle, its whole sequence, which a document must hold as its own
whole sequence; a null or blank item or text has no shingle and leaks nothing. Equal items are reported each by its id;
items of equal id, or without one, are one item with the shingles of all. Documents are told apart by id and text, so
those of equal or null id are judged each by itself, and repeats of one row are reported once. A text of any length is
judged whole, in its row. Empty tables give an empty result. Other columns are ignored, whatever their names, and carried
along by drop_leaks().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bit_map, bounded, checkpointed, fits, let, lowered, may_have, named, picked, row_key, words_of

WORDS, SHARE = 5, 0.8
#: Size partitions for each doubling of the size.
PARTS = 4


def shingles(text: Column, words: int = WORDS, spelt: bool = False) -> Column:
    """The hashes of a text's shingles, as an array, repeats included; spelt: structs of the hash h and the words s."""

    def made(hash_: Column, parts: Column) -> Column:
        return F.struct(hash_.alias("h"), F.array_join(parts, " ").alias("s")) if spelt else hash_

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: made(F.xxhash64(*(F.get(w, i + k) for k in range(words))), F.slice(w, i + 1, words)))
        one = F.array(made(F.xxhash64(F.concat_ws(" ", w)), w))
        none = F.array().cast("array<struct<h:bigint,s:string>>" if spelt else "array<bigint>")
        return F.when(F.size(w) >= words, many).when(F.size(w) > 0, one).otherwise(none)

    return let(words_of(lowered(text)), of)


def minhash(h: Column) -> Column:
    """The MinHash order of a shingle: its hash mixed again and made non-negative."""
    return F.shiftrightunsigned(F.xxhash64(h, F.lit(7)), 1)


def item_shingles(items: DataFrame, id: str = "item_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """(item_id, size, part, h, s, value, in_sketch) for each different shingle of each item.

    part: the size partition; in_sketch: h is among the item's bottom k by its MinHash value.
    """
    rows = items.select(named(id).alias("item_id"), F.explode(shingles(named(text), spelt=True)).alias("x")).select("item_id", "x.h", "x.s").distinct()
    own = Window.partitionBy("item_id")
    rows = rows.withColumn("size", F.count("*").over(own)).withColumn("part", F.floor(PARTS * F.log2("size") + F.lit(1e-9)).cast("int"))
    upper = F.greatest(F.ceil(F.pow(F.lit(2.0), (F.col("part") + 1) / PARTS) - F.lit(1e-9)) - 1, F.col("size"))
    k = F.floor(upper * F.lit(1 - share) + F.lit(1e-9)) + 1
    return rows.withColumn("value", minhash(F.col("h"))).withColumn("in_sketch", F.row_number().over(own.orderBy("value", "s")) <= k)


def cut_offs(known: DataFrame) -> DataFrame:
    """(part, n_items, cut_off) of each size partition; cut_off as a share of all values."""
    most = F.max(F.when(F.col("in_sketch"), F.col("value"))) / F.lit(float(1 << 63))
    return known.groupBy("part").agg(F.count_distinct("item_id").alias("n_items"), most.alias("cut_off"))


def candidates(docs: DataFrame, known: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, k1, k2, item_id): documents that share a sketch value with an item; k1, k2 tell documents apart."""
    probes = checkpointed(known.filter("in_sketch").select("item_id", "h", "value"))
    most = probes.agg(F.max("value")).first()[0]
    sketch = F.filter(shingles(named(text)), lambda h: minhash(h) <= F.lit(-1 if most is None else most).cast("bigint"))
    k1, k2 = row_key(named(id), named(text))
    values = docs.select(named(id).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.explode(sketch).alias("h"))
    probes = probes.select("item_id", "h")
    if fits(probes):
        met = values.join(F.broadcast(probes), "h")
    else:
        # A document has each value once, so a value that stands in very many documents meets few items but many rows.
        told = may_have(values, checkpointed(bit_map(probes, "h")), "h", "may")
        met = told.filter("may").drop("may").distinct().join(probes, "h")
    return met.select("doc_id", "k1", "k2", "item_id").distinct()


def leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every document that holds share or more of an item."""
    return _leaks(docs, items, id, text, item_id, item_text, share).drop("k1", "k2")


def _leaks(docs, items, id="doc_id", text="text", item_id="item_id", item_text="text", share=SHARE) -> DataFrame:
    known = checkpointed(item_shingles(items, item_id, item_text, share))
    found = checkpointed(candidates(docs, known, id, text))
    key = row_key(named(id), named(text))
    rest = picked(docs.select(named(id), named(text)), checkpointed(found.select("k1", "k2").distinct()), key, keep=True)
    # A document may leak many items and an item may leak into many documents: each shared shingle is looked up among
    # the items first, and only then tied to the pair.
    each = rest.select(key[0].alias("k1"), key[1].alias("k2"), F.explode(shingles(named(text), spelt=True)).alias("x")).select("k1", "k2", "x.h", "x.s")
    shared = each.join(bounded(known.select("item_id", "h", "s", "size")), ["h", "s"])
    counts = shared.groupBy("k1", "k2", "item_id").agg(F.count_distinct("s").alias("n_shared"), F.first("size").alias("n_item"))
    pairs = counts.join(found.withColumnRenamed("item_id", "found_id"), ["k1", "k2"]).filter(F.col("item_id").eqNullSafe(F.col("found_id")))
    pairs = pairs.select("doc_id", "k1", "k2", "item_id", "n_shared", "n_item")
    pairs = pairs.filter(F.col("n_shared") >= F.lit(share) * F.col("n_item") - F.lit(1e-9))
    return pairs.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without the documents that leak an item."""
    gone = checkpointed(_leaks(docs, items, id, text, **how).select("k1", "k2").distinct())
    return picked(docs, gone, row_key(named(id), named(text)), keep=False)
