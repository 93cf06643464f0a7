"""Mixing sources to target weights by pivotal rounding.

Each source gets a share of all words; a document is then due share / size copies, a number with a fraction. Whole
copies are taken as they are. The fractions are rounded by pivotal sampling: two documents at a time pass words to each
other, at random but fair odds, until one of them has a whole number of copies. The words that a source is due are kept
by every such step, and long documents come first, so that the one left undecided at the end is a short one; it goes to
the nearer whole number. What a source then misses is made up for by one document whose size is nearest to it, twice.

Documents meet in chunks of bounded size; each chunk leaves at most one undecided document, and these meet in chunks
again, level by level, until one is left per source. Odds come from hashes of ids and texts, so reruns agree however the
rows are partitioned.

By the pivotal steps every document is expected to be taken as often as it is due. The one left at the end of a source and
the two that make up for what it misses aren't left to chance: three documents of each source, at most, are off by less
than a copy.

Cases: a null or blank text has size 0 and is taken with 0 words. A null source is a source of its own, ranked last. Null
and equal ids are no ties: documents are told apart by id, text and source. Repeats of one row are alike and counted, so
it doesn't matter which of them is taken, and no chunk gets more of them than of others. Of documents that would make up
equally well for what is missed, the one with the least id is chosen, then the one with the least hash. A text of any
length is only counted. An empty table gives an empty result. Other columns of the input are carried along by mix(),
whatever their names, and ignored by plan().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, fresh, join_back, key_of, named, numbered, picked, row_key, words_of

#: So many documents are rounded in one task; so many undecided ones meet on the next level.
CHUNK, FAN = 8192, 4096
#: So many times, what a source misses is made up for by one document.
REPAIRS = 2
WEIGHTS, CAP = (1, 2, 3), 3


def sources_of(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(skey, n_docs, source_size, weight): weights repeat over the sources in code point order, null last.

    The rank is counted over sorted partitions, so no task gets all sources.
    """
    grouped = sized.groupBy("skey").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = [(F.col("skey") == "n").asc(), F.col("skey").asc()]
    ranked = checkpointed(grouped.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    ahead = ranked.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1 + F.col("ahead")
    of = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    return ranked.join(F.broadcast(ahead), "_p").select("skey", "n_docs", "source_size", of.alias("weight"))


def targets_of(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """sources with target: all words by weight, at most cap times a source's size, the excess shared out again."""
    sources = checkpointed(sources)
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, most = 0.0, cap * F.col("source_size")
    while True:  # level: words for each unit of weight; it only rises, and each round closes a source or ends
        open_ = F.col("weight") * F.lit(level) < most
        closed, weight = sources.agg(F.coalesce(F.sum(F.when(~open_, most)), F.lit(0)), F.coalesce(F.sum(F.when(open_, F.col("weight"))), F.lit(0))).first()
        new = (total - closed) / weight if weight else level
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), most.cast("double")))


def odds(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) that depends on two documents only."""
    return xxhash.xxh64_intdigest(f"{a}:{b}".encode(), seed) / 2.0**64


def pivot(ids, sizes, due, seed: int = 42) -> tuple[np.ndarray, int]:
    """due (fractions of a copy) with all but at most one value made 0 or 1; the index of that one, or -1.

    A step passes words between two documents: a gains x words and b loses x, or the other way round, with odds that
    keep each one's expectation; x is the least that makes either whole. The sum of size * due never changes.
    """
    due, held = np.array(due, float), -1
    for i in range(len(due)):
        if due[i] <= 1e-12 or due[i] >= 1 - 1e-12:
            due[i] = round(due[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min((1 - due[a]) * sizes[a], due[b] * sizes[b])
        down = min(due[a] * sizes[a], (1 - due[b]) * sizes[b])
        x = up if odds(ids[a], ids[b], seed) * (up + down) < down else -down
        due[a] += x / sizes[a]
        due[b] -= x / sizes[b]
        for k in (a, b):
            if min(due[k], 1 - due[k]) <= 1e-9:
                due[k] = round(due[k])
        free = [k for k in (a, b) if 0 < due[k] < 1]
        held = free[0] if free else -1
    return due, held


def _rounded(docs: DataFrame, seed: int) -> DataFrame:
    """docs (rid, skey, chunk, chunks, size, due, …) with due 0 or 1 but for one row of a chunk."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "rid", "due"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        pdf["due"], _ = pivot(pdf["rid"].tolist(), pdf["size"].tolist(), pdf["due"], seed)
        return pdf

    return docs.groupBy("skey", "chunk").applyInPandas(run, docs.schema)


def plan(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 42) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row of docs."""
    return _plan(docs, id, text, source, weights, cap, seed).select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _keys(id: str, text: str, source: str) -> list[Column]:
    k1, k2 = row_key(named(id), named(text))
    return [k1.alias("k1"), k2.alias("k2"), key_of(named(source)).alias("skey")]


def _plan(docs, id="doc_id", text="text", source="source", weights=WEIGHTS, cap=CAP, seed=42) -> DataFrame:
    """(k1, k2, skey, doc_id, size, source_size, target, copies) of every row of docs."""
    size = F.size(words_of(named(text))).cast("bigint").alias("size")
    sized = docs.select(*_keys(id, text, source), named(id).alias("doc_id"), size)
    alike = checkpointed(sized.groupBy("k1", "k2", "skey").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.count("*").alias("m")))
    sized = checkpointed(numbered(alike, "m", "j").withColumn("rid", F.xxhash64("k1", "k2", "skey", "j")).drop("m", "j"))
    facts = checkpointed(targets_of(sources_of(sized, weights), cap))
    due = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    rows = join_back(sized, facts.select("skey", "source_size", "target", "n_docs", F.col("n_docs").alias("n")), "skey", "n").withColumn("_due", due)
    chunks = F.ceil(F.col("n_docs") / CHUNK).cast("bigint")
    rows = rows.select(
        "k1", "k2", "doc_id", "rid", "skey", "size", "source_size", "target", "n_docs", F.floor("_due").cast("bigint").alias("whole"), (F.col("_due") - F.floor("_due")).alias("due"),
        F.pmod(F.xxhash64("rid", F.lit(seed)), chunks).alias("chunk"), chunks.alias("chunks"),
    )
    level = checkpointed(_rounded(rows, seed))
    done = [level.filter("due <= 0 or due >= 1")]
    level = level.filter("due > 0 and due < 1")
    while level.agg(F.max("chunks")).first()[0] not in (None, 1):
        less = F.ceil(F.col("chunks") / FAN).cast("bigint")
        level = checkpointed(_rounded(level.withColumn("chunk", F.floor(F.col("chunk") / FAN).cast("bigint")).withColumn("chunks", less), seed))
        done.append(level.filter("due <= 0 or due >= 1"))
        level = level.filter("due > 0 and due < 1")
    out = level.withColumn("due", F.when(F.col("due") >= 0.5, 1.0).otherwise(0.0))
    for d in done:
        out = out.unionByName(d)
    free = (F.try_divide("target", "source_size") % 1 > 1e-9) & (F.col("size") > 0)
    copies = (F.col("whole") + F.round("due").cast("bigint")).alias("copies")
    out = checkpointed(out.select("k1", "k2", "doc_id", "rid", "skey", "size", "source_size", "target", "n_docs", copies, F.when(free, F.round("due").cast("int")).alias("up")))
    for _ in range(REPAIRS):
        out = _repaired(out)
    return out.select("k1", "k2", "skey", "doc_id", "size", "source_size", "target", "copies")


def _repaired(rows: DataFrame) -> DataFrame:
    """rows, where in each source one document more or less is rounded up if that brings the source nearer to its target.

    Only documents with a fraction of a copy (up: 0 or 1) change, between the two whole numbers next to it.
    """
    gap = F.first("target") - F.sum(F.col("size") * F.col("copies"))
    gaps = rows.groupBy("skey").agg(F.first("n_docs").alias("n"), gap.alias("gap"))
    seen = join_back(rows, gaps, "skey", "n")
    left = F.abs(F.abs("gap") - F.col("size"))
    fits = (F.col("up") == F.when(F.col("gap") > 0, 0).otherwise(1)) & (left < F.abs("gap"))
    best = seen.filter(fits).groupBy("skey").agg(F.min(F.struct(left.alias("left"), "doc_id", "rid")).alias("b")).select("skey", F.col("b.rid").alias("best"))
    n = gaps.select("skey", "n")
    rows = join_back(rows, n.join(best, "skey", "left"), "skey", "n")
    chosen = F.coalesce(F.col("rid") == F.col("best"), F.lit(False))
    step = F.when(chosen, 1 - 2 * F.col("up")).otherwise(0)
    return checkpointed(rows.withColumn("copies", F.col("copies") + step).withColumn("up", F.col("up") + step).drop("best"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", cap: int = CAP, **how) -> DataFrame:
    """docs with each row as often as the mix takes it. Rows that aren't taken are gone.

    A last column copy counts from 1; if there is one of this name already, underscores are added to it.
    """
    k1, k2, skey, copies, copy = fresh(docs.columns, "k1", "k2", "skey", "copies", "copy")
    planned = _plan(docs, id, text, source, cap=cap, **how)
    each = [F.count_if(F.col("copies") == c).alias(f"n{c}") for c in range(1, cap + 1)]
    facts = checkpointed(planned.groupBy("k1", "k2", "skey").agg(F.count("*").alias("m"), F.max("copies").alias("copies"), *each))
    one, many = facts.filter("m = 1 AND copies > 0").select("k1", "k2", "skey", "copies"), facts.filter("m > 1")
    keyed = docs.withColumns(dict(zip((k1, k2, skey), _keys(id, text, source))))
    met = keyed.join(one.toDF(k1, k2, skey, copies), [k1, k2, skey])
    columns = [named(c) for c in docs.columns]
    out = met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*columns, copy)
    if many.isEmpty():
        return out
    # Repeats of one row: one of them stands for all and is written out as often as they are taken together.
    again = picked(docs, checkpointed(many.select("k1", "k2").distinct()), row_key(named(id), named(text)), keep=True)
    again = again.select(*_keys(id, text, source), F.struct(*columns).alias("row")).groupBy("k1", "k2", "skey").agg(F.first("row").alias("row"))
    taken = many.select("k1", "k2", "skey", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"n{c}").alias("n")) for c in range(1, cap + 1)))).alias("x")).select("k1", "k2", "skey", "x.*")
    rows = numbered(again.join(taken, ["k1", "k2", "skey"]), "n", "j")
    return out.union(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "c"))).select("row.*", "copy"))
