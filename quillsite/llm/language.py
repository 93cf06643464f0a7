"""Language identification by prediction by partial matching.

Each language has a context tree of order 3 over the 256 values of its texts' bytes. A byte that was seen after a context
has the share of its count; the rest, as much as different bytes were seen (escape method C), goes to the next shorter context
over those not seen in the longer one (exclusion), down to equal shares. With frozen statistics the probabilities
of a context sum to one, so minus their logarithms are exact code lengths in bits. A text belongs to the language that
codes it in the fewest bits; the score is that language's share if each is weighed by two to minus its code length.

A code length is that of the next shorter context plus what the escape costs, unless the byte was seen after the context.
So up to order 1 it stands in a table, and for orders 2 and 3 only what was seen is kept, as a correction for each of the
languages that saw it, sorted by its bytes. Neither the alphabet nor the order depends on how many languages there are;
memory follows the bytes of the sample.

The model is fitted on a bounded sample of documents for each language, those with the smallest hashes of their ids, as
far as they fit into a number of bytes; all texts are scored whole.

Cases: a null text and one without a letter (Unicode's category L) is `und` with score 0. Documents of unknown language
teach nothing, nor do those without an id or text; if no document does, every text is `und`. Of texts with equal id and
language the least one teaches. Equal rows are judged alike; null and equal ids are carried along; ties go to the language
first in code point order. Long texts are scored piece by piece, and the pieces' bits are added up. An empty table gives
an empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, checkpointed, named

#: The order of the longest context, and the documents for each language in the sample.
ORDER, SAMPLE = 3, 400
#: The bytes of a language in the sample, at most.
BYTES = 2_000_000
#: So many grams are counted at once.
AT_ONCE = 1 << 22
LETTER = regex.compile(r"\p{L}")
#: Texts are scored in pieces of so many bytes, to bound memory; pieces overlap by the context.
PIECE = 1 << 20


def symbols_of(texts: list[bytes], symbols: int) -> tuple[np.ndarray, int]:
    """The symbol of each byte value, and how many byte values share the last symbol."""
    counts = np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256)
    own = np.argsort(-counts, kind="stable")[: symbols - 1]
    of = np.full(256, symbols - 1, dtype=np.uint8)
    of[own] = np.arange(len(own))
    return of, 256 - len(own)


def code_table(texts: list[bytes], of: np.ndarray, shared: int, order: int, symbols: int) -> np.ndarray:
    """Bits for each (context of `order` symbols, symbol), as a flat table: the low orders of Tree.

    A text begins after `order` times the last symbol.
    """
    pad = np.full(order, symbols - 1, np.uint8)
    grams = np.zeros(symbols ** (order + 1), dtype=np.int64)
    for t in texts:
        s = np.concatenate([pad, of[np.frombuffer(t, np.uint8)]]).astype(np.int64)
        at = s[order:].copy()
        for k in range(1, order + 1):
            at += s[order - k : -k] * symbols**k
        np.add.at(grams, at, 1) if len(at) < 4096 else np.add(grams, np.bincount(at, minlength=len(grams)), out=grams)
    p = np.full((1, symbols), 1 / symbols)
    for k in range(order + 1):
        counts = grams.reshape(-1, symbols**k, symbols).sum(axis=0)  # by the last k symbols
        seen = counts > 0
        total, different = counts.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
        lower = np.tile(p, (symbols**k // len(p), 1))  # the shorter context is the tail of the longer one
        rest = np.where(seen, 0, lower)
        left = rest.sum(axis=1, keepdims=True)
        escape = np.where(left > 0, different / np.maximum(total + different, 1), 0)
        kept = np.where(left > 0, counts / np.maximum(total + different, 1), counts / np.maximum(total, 1))
        p = np.where(total == 0, lower, np.where(seen, kept, escape * rest / np.where(left > 0, left, 1)))
    bits = -np.log2(p)
    bits[:, symbols - 1] += np.log2(shared)
    return bits.ravel().astype(np.float32)


def grams(s: np.ndarray) -> np.ndarray:
    """The four bytes that end at each position of s from the fourth on, as one number."""
    s = s.astype(np.uint32)
    return s[:-3] << 24 | s[1:-2] << 16 | s[2:-1] << 8 | s[3:]


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The different grams of all texts, sorted, and their counts. A text begins after three zero bytes."""
    keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    batch: list[np.ndarray] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        found, n = np.unique(np.concatenate(batch), return_counts=True)
        both, at = np.unique(np.concatenate([keys, found]), return_inverse=True)
        return both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)

    size = 0
    for t in texts:
        for start in range(0, len(t), AT_ONCE):
            batch.append(grams(np.frombuffer((bytes(ORDER) + t[:AT_ONCE]) if not start else t[start - ORDER : start + AT_ONCE], np.uint8)))
            size += len(batch[-1])
            if size >= AT_ONCE:
                keys, counts = merged()
                batch, size = [], 0
    return merged() if batch else (keys, counts)


def seen_after(ctx: np.ndarray, counts: np.ndarray, lower: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For grams of contexts 0, 1, .. with their probabilities in the shorter context: their own probabilities, what they
    take more bits than by escape, and the bits of each context's escape (0 for one that wasn't seen)."""
    total, different = np.bincount(ctx, counts, contexts), np.bincount(ctx, minlength=contexts)
    open_ = (different > 0) & (different < 256)
    left = np.where(open_, np.maximum(1 - np.bincount(ctx, lower, contexts), 1e-15), 1)
    escape = np.where(open_, -np.log2(np.where(open_, different / np.maximum(total + different, 1), 1) / left), 0)
    p = counts / (total + np.where(open_, different, 0))[ctx]
    return p, -np.log2(p) + np.log2(lower) - escape[ctx], escape


class Tree:
    """The frozen context tree of one language.

    low: bits by the last byte and the next; escapes2: bits by the last two bytes; more2, more3: bits by grams of three
    and four bytes as (keys, bits); escapes3: bits by the last three bytes as (keys, bits).
    """

    def __init__(self, texts: list[bytes]):
        keys, counts = counted(texts)
        p = np.full((1, 256), 1 / 256)
        for k in (0, 1):
            n = np.bincount(keys & np.uint32(256 ** (k + 1) - 1), counts, 256 ** (k + 1))
            seen = np.flatnonzero(n)
            p = np.tile(p, (256**k // len(p), 1)).ravel()
            own, _, escape = seen_after(seen >> 8, n[seen], p[seen], 256**k)
            p *= np.repeat(np.exp2(-escape), 256)
            p[seen] = own
            p = p.reshape(-1, 256)
        self.low, p = -np.log2(p).ravel(), p.ravel()
        three, at = np.unique(keys & np.uint32(0xFFFFFF), return_inverse=True)
        own, more, self.escapes2 = seen_after((three >> 8).astype(np.int64), np.bincount(at, counts, len(three)), p[three & np.uint32(0xFFFF)], 1 << 16)
        self.more2 = three, more
        contexts, ctx = np.unique(keys >> np.uint32(8), return_inverse=True)
        _, more, escape = seen_after(ctx, counts, own[at], len(contexts))
        self.more3, self.escapes3 = (keys, more), (contexts, escape)


class Sparse:
    """Sums of bits by key and language, of which most are zero."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        keys = np.concatenate([k for k, _ in tables])
        order = np.argsort(keys, kind="stable")
        self.langs = len(tables)
        self.lang = np.repeat(np.arange(len(tables), dtype=np.int32), [len(k) for k, _ in tables])[order]
        self.bits = np.concatenate([b for _, b in tables])[order].astype(np.float32)
        self.keys, starts = np.unique(keys[order], return_index=True)
        self.starts = np.append(starts, len(keys))

    def sums(self, keys: np.ndarray) -> np.ndarray:
        """By language, the bits of all keys, repeats included."""
        if not len(self.keys):
            return np.zeros(self.langs)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        at = at[self.keys[at] == keys]
        first, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        rows = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.lang[rows], self.bits[rows], self.langs)


class Model:
    """Frozen code lengths for all languages, side by side."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.langs = sorted(texts)
        trees = [Tree(texts[x]) for x in self.langs]
        if trees:
            self.low, self.escapes2 = (np.stack(x, axis=1).astype(np.float32) for x in ([t.low for t in trees], [t.escapes2 for t in trees]))
            self.more2, self.more3, self.escapes3 = (Sparse(x) for x in ([t.more2 for t in trees], [t.more3 for t in trees], [t.escapes3 for t in trees]))

    def code_lengths(self, text: bytes) -> np.ndarray:
        """Bits of a text by language."""
        out = np.zeros(len(self.langs))
        tail = bytes(ORDER)
        for start in range(0, len(text), PIECE):
            piece = tail + text[start : start + PIECE]
            g = grams(np.frombuffer(piece, np.uint8))
            out += self.low.take(g & np.uint32(0xFFFF), axis=0).sum(axis=0, dtype=np.float64)
            out += self.escapes2.take(g >> np.uint32(8) & np.uint32(0xFFFF), axis=0).sum(axis=0, dtype=np.float64)
            out += self.more2.sums(g & np.uint32(0xFFFFFF)) + self.escapes3.sums(g >> np.uint32(8)) + self.more3.sums(g)
            tail = piece[len(piece) - ORDER :]
        return out

    def judge(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0
        lengths = self.code_lengths(text.encode("utf-8", "surrogatepass"))
        best = int(np.argmin(lengths))
        return self.langs[best], float(1 / np.exp2(np.maximum(lengths[best] - lengths, -1000)).sum())


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(id.cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def within(sizes: list[tuple], most: int) -> list:
    """The first ones of (id, size), in their order, passing over those that don't fit; the smallest one if none does."""
    out, left = [], most
    for id, n in sizes:
        if n <= left:
            out.append(id)
            left -= n
    return out or [min(sizes, key=lambda x: x[1])[0]] if sizes else []


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, most: int = BYTES) -> Model:
    """The model of docs that aren't held out, from at most `sample` documents and `most` bytes for each language.

    The sample is chosen by ids and languages alone. A threshold on the hash, from the language's count, first leaves
    about three times the sample, so what meets in one task is bounded however frequent the language is.
    """
    rows = docs.select(named(id).alias("doc_id"), named(lang).alias("lang"), named(text).alias("text"))
    known = rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = bounded(checkpointed(known.groupBy("lang").agg(F.count("*").alias("n"))))
    share = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = known.select("doc_id", "lang", share.alias("r")).join(counts, "lang").filter(F.col("r") * F.col("n") < 3 * sample)
    near = near.select("doc_id", "lang", "r").distinct()
    chosen = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("r", "doc_id"))).filter(F.col("n") <= sample)
    met = known.filter(F.col("text").isNotNull()).join(bounded(checkpointed(chosen.select("doc_id", "lang", "r"))), ["doc_id", "lang"])
    met = checkpointed(met.groupBy("doc_id", "lang").agg(F.min("text").alias("text"), F.first("r").alias("r")))
    by: dict[str, list[tuple]] = {}
    for r in met.select("doc_id", "lang", F.octet_length("text").alias("n")).orderBy("lang", "r", "doc_id").collect():
        by.setdefault(r["lang"], []).append((r["doc_id"], r["n"]))
    fitting = {x: set(within(sizes, most)) for x, sizes in by.items()}
    if any(len(fitting[x]) < len(by[x]) for x in by):
        keys = [(d, x) for x, ids in fitting.items() for d in ids]
        met = met.join(bounded(met.sparkSession.createDataFrame(keys, met.select("doc_id", "lang").schema)), ["doc_id", "lang"])
    texts: dict[str, list[bytes]] = {}
    for r in met.orderBy("lang", "doc_id").select("lang", "text").toLocalIterator():
        texts.setdefault(r["lang"], []).append(r["text"].encode("utf-8", "surrogatepass"))
    return Model(texts)


def identify(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.judge(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(named(id).alias("doc_id"), held_out(named(id)).alias("held_out"), named(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
