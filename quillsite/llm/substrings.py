"""Substring deduplication by anchored phrases, in place of a greedy relative Lempel-Ziv parse.

A window of 20 words is a duplicate if the same words start earlier: in a document of smaller id, or in the same one.

Documents are dealt into reference blocks by a hash of their id. Each block is indexed by anchors: of the 8-word grams in
a window the one with the least hash is its anchor, so equal windows have equal anchors, and consecutive windows mostly
share one. The windows of one anchor make a phrase of up to 32 words. The index holds every phrase of every block, and
all blocks are parsed against it:

1. A phrase that is found earlier, in this block or another, is copied from there; phrases whose sources continue each
   other are merged to one factor. No text is extended against a block's text, and neither the merging nor a factor's
   length decides what is removed.
2. A factor ends inside a phrase where the context of the copied passage changes. Only there, the windows of phrases
   that share their anchor with a different phrase are looked up one by one: the check at factor boundaries.

Both steps are exact, so a word is removed if and only if it lies in a duplicate window. Phrases are told apart by 128
bits of hash (anchor and content), windows by 128 bits.

A block has a bounded number of characters and sends at most one row for each different phrase, so a passage that stands
in very many documents meets the index once for each block: no key of a window has more rows than there are blocks, of
about 40 bytes each. Texts are shuffled to their blocks once; the steps read that shuffle again. Texts too short for a
window aren't shuffled at all, nor are repeats of one row but the first.

Cases: a null or blank text has no words, nothing is removed, and kept_sha256 is that of the empty text. A null id comes
before all others; such documents are in the order of a hash of their texts. Other documents of equal id are in the order
of their texts and share a block, so ids should not repeat without end. Rows of equal id and text are repeats: the first
is a document like any other, and of the rest all is removed if there are enough words for a window. A long text makes
its block longer and is handled whole. An empty table gives an empty result. Other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, named, numbered, picked, row_key, words_of

WINDOW, GRAM = 20, 8
#: Characters in a reference block, on average.
BLOCK_CHARS = 4_000_000
R1, R2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SPAN = "w binary, pid bigint, d bigint, at bigint, n int, src_d bigint, src_at bigint"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads close values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(h: np.ndarray, r: np.uint64, n: int) -> np.ndarray:
    """For each start, the polynomial hash of n values."""
    out, size = np.zeros(max(len(h) - n + 1, 0), np.uint64), max(len(h) - n + 1, 0)
    for k in range(n):
        out = out * r + h[k : k + size]
    return out


def least(values: np.ndarray, n: int) -> np.ndarray:
    """For each start, the position of the leftmost least of n values."""
    if len(values) < n:
        return np.zeros(0, np.int64)
    at, span = np.arange(len(values)), 1
    while 2 * span <= n:
        a, b = at[:-span], at[span:]
        at, span = np.where(values[a] <= values[b], a, b), 2 * span
    if span < n:
        a, b = at[: len(at) - (n - span)], at[n - span :]
        at = np.where(values[a] <= values[b], a, b)
    return at


def _first_of_equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair, the index of the first one that equals it."""
    if not len(a):
        return np.zeros(0, np.int64)
    order = np.lexsort((b, a))  # stable: equal pairs stay in order
    x, y = a[order], b[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    first = np.empty(len(a), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return first


class Block:
    """The documents of a block as one sequence of words, with its phrases.

    doc, at: number of the document and position of each word in it; keys: (d, rank among equal d) of each document.
    Phrases: a (anchor), b (content), lo and hi (first and last window), in the order of the documents.
    """

    def __init__(self, table: pa.Table):
        rows = sorted(zip(table["d"].to_pylist(), ["" if t is None else t for t in table["text"].to_pylist()], table["doc_id"].to_pylist()), key=lambda r: r[:2])
        self.ids = [r[2] for r in rows]
        self.words = [r[1].encode("utf-8", "surrogatepass").split() for r in rows]
        d = np.array([r[0] for r in rows], np.int64)
        self.d = d
        same = np.concatenate([[0], (d[1:] == d[:-1]).astype(np.int64)]) if len(d) else d
        index = np.arange(len(d))
        self.rank = index - np.maximum.accumulate(np.where(same == 0, index, 0)) if len(d) else d
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.doc = np.repeat(index, sizes)
        self.pos = np.arange(self.start[-1]) - self.start[self.doc]
        digest = xxhash.xxh3_128_digest
        raw = b"".join([b"".join(map(digest, w)) for w in self.words])
        h = np.frombuffer(raw, dtype="<u8").reshape(-1, 2)
        self.h1, self.h2 = np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])
        self._phrases()

    def _phrases(self) -> None:
        n = len(self.h1) - WINDOW + 1
        if n <= 0:
            self.a = self.b = np.zeros(0, np.uint64)
            self.lo = self.hi = np.zeros(0, np.int64)
            return
        grams = mixed(rolled(self.h1, R1, GRAM))
        anchor = least(grams, WINDOW - GRAM + 1)[:n]
        whole = self.doc[:n] == self.doc[WINDOW - 1 : WINDOW - 1 + n]
        first = whole & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~whole[:-1]])
        last = whole & np.concatenate([(anchor[1:] != anchor[:-1]) | ~whole[1:], [True]])
        self.lo, self.hi = np.flatnonzero(first), np.flatnonzero(last)
        at = anchor[self.lo]
        self.a = grams[at]
        # The content of words lo to hi + WINDOW: a difference of prefix sums, scaled by the inverse power.
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(self.h2), R2)]))
        inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(self.h2), np.uint64(pow(int(R2), -1, 1 << 64)))]))
        sums = np.concatenate([[np.uint64(0)], np.add.accumulate(mixed(self.h2) * power[:-1])])
        shape = ((at - self.lo) * 64 + (self.hi - self.lo)).astype(np.uint64)
        self.b = mixed((sums[self.hi + WINDOW] - sums[self.lo]) * inverse[self.lo] + mixed(shape + np.uint64(1)))

    def places(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(d, at) of words: at holds the rank among documents of equal d, then the position."""
        k = self.doc[i]
        return self.d[k], (self.rank[k] << 32) | self.pos[i]

    def firsts(self) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the first phrase of each kind, and for each phrase the index of its first."""
        first = _first_of_equal(self.a, self.b)
        return np.flatnonzero(first == np.arange(len(self.a))), first


def _sortable(x: np.ndarray) -> np.ndarray:
    """Signed integers as eight bytes whose order is theirs."""
    return (x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")


def _unsorted(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _fixed(columns: list[np.ndarray]) -> pa.Array:
    """The columns' bytes side by side, as one binary value for each row."""
    rows = np.stack(columns, axis=1).astype(">u8")  # big-endian, so that bytes sort as the numbers do
    width = 8 * rows.shape[1]
    data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])
    return data.cast(pa.binary())


def _columns(values: pa.ChunkedArray, width: int) -> np.ndarray:
    """What _fixed made, as big-endian 64-bit columns."""
    joined = b"".join(values.to_pylist())
    return np.frombuffer(joined, ">u8").reshape(-1, width)


def _index(table: pa.Table) -> pa.Table:
    """The block's different phrases: a, and v with content, place of the first one and block."""
    block = Block(table)
    first, _ = block.firsts()
    d, at = block.places(block.lo[first]) if len(first) else (np.zeros(0, np.int64),) * 2
    pid = np.full(len(first), table["pid"][0].as_py() if table.num_rows else 0)
    v = _fixed([block.b[first].astype(">u8"), _sortable(d), _sortable(at), _sortable(pid)])
    return pa.table({"a": pa.array(block.a[first].view(np.int64)), "v": v})


def _parse(key, docs: pa.Table, found: pa.Table) -> pa.Table:
    """Factors of the block's documents, and the windows to be checked at their boundaries.

    found: (a, b, src: place of the first phrase of all blocks) of those that are not first here or that share their
    anchor with other phrases.
    """
    block = Block(docs)
    first, of = block.firsts()
    n = len(block.a)
    d, at = block.places(block.lo) if n else (np.zeros(0, np.int64),) * 2
    src_d, src_at = d[of], at[of]
    several = np.zeros(n, bool)
    if n and found.num_rows:
        fa, fv = found["a"].to_numpy().view(np.uint64), _columns(found["v"], 3)
        fb = fv[:, 0].astype(np.uint64)
        order = np.lexsort((fb, fa))
        fa, fb, fd, fat = fa[order], fb[order], _unsorted(fv[order, 1]), _unsorted(fv[order, 2])
        # Both sides are sorted by (a, b); equal keys meet at the same rank among all keys.
        _, rank = np.unique(np.concatenate([np.stack([fa, fb], 1), np.stack([block.a[first], block.b[first]], 1)]), axis=0, return_inverse=True)
        rank = rank.ravel()
        where = np.full(rank.max() + 1, -1)
        where[rank[: len(fa)]] = np.arange(len(fa))
        k = where[rank[len(fa) :]]
        known = k >= 0
        at_first = np.full(n, -1)
        at_first[first[known]] = k[known]
        k = at_first[of]
        src_d, src_at = np.where(k >= 0, fd[k], src_d), np.where(k >= 0, fat[k], src_at)
        several = k >= 0
    copied = (src_d != d) | (src_at != at)
    rows = _factors(block, np.flatnonzero(copied), d, at, src_d, src_at)
    edge = np.flatnonzero(several & ~copied)
    size = block.hi[edge] - block.lo[edge] + 1
    i = np.repeat(block.lo[edge], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    words = np.arange(WINDOW)
    w1, w2 = np.zeros(len(i), np.uint64), np.zeros(len(i), np.uint64)
    for k in words:
        w1, w2 = w1 * R1 + block.h1[i + k], w2 * R2 + block.h2[i + k]
    wd, wat = block.places(i) if len(i) else (np.zeros(0, np.int64),) * 2
    # Of equal windows in this block only the first goes to the others; the rest are copies of it here and now.
    head = _first_of_equal(w1, w2)
    own = head == np.arange(len(i))
    windows = (_fixed([mixed(w1[own]).astype(">u8"), mixed(w2[own]).astype(">u8")]), wd[own], wat[own], np.full(own.sum(), WINDOW), wd[own], wat[own])
    late = (wd[~own], wat[~own], np.full((~own).sum(), WINDOW), wd[head[~own]], wat[head[~own]])
    rows = tuple(np.concatenate(x) for x in zip(rows, late))
    spans = (_fixed([_sortable(rows[0]), _sortable(rows[1]), np.zeros(len(rows[0]), ">u8")]), *rows)
    pid = np.int64(key[0].as_py())
    parts = [pa.table({"w": x[0], "pid": pa.array(np.full(len(x[1]), pid)), "d": pa.array(x[1]), "at": pa.array(x[2]), "n": pa.array(x[3].astype(np.int32)), "src_d": pa.array(x[4]), "src_at": pa.array(x[5])}) for x in (windows, spans)]
    return pa.concat_tables(parts)


def _factors(block: Block, k: np.ndarray, d, at, src_d, src_at) -> tuple[np.ndarray, ...]:
    """(d, at, n, src_d, src_at) of factors: copied phrases, joined while their sources continue each other."""
    if not len(k):
        return (np.zeros(0, np.int64),) * 5
    doc = block.doc[block.lo[k]]
    joined = (doc[1:] == doc[:-1]) & (k[1:] == k[:-1] + 1) & (src_d[k[1:]] == src_d[k[:-1]]) & (src_at[k[1:]] - src_at[k[:-1]] == at[k[1:]] - at[k[:-1]])
    head = np.concatenate([[True], ~joined])
    tail = np.concatenate([~joined, [True]])
    h, t = k[head], k[tail]
    return d[h], at[h], block.hi[t] + WINDOW - block.lo[h], src_d[h], src_at[h]


def _kept(key, docs: pa.Table, spans: pa.Table) -> pa.Table:
    """What is left of each document of a block without the words of its spans."""
    rows = sorted(zip(docs["d"].to_pylist(), ["" if t is None else t for t in docs["text"].to_pylist()], docs["doc_id"].to_pylist()), key=lambda r: r[:2])
    by: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d, at, n in zip(*(spans[c].to_pylist() for c in ("d", "at", "n"))):
        by.setdefault((d, at >> 32), []).append((at & 0xFFFFFFFF, n))
    out, rank = [], 0
    for i, (d, text, id) in enumerate(rows):
        rank = rank + 1 if i and rows[i - 1][0] == d else 0
        words = text.encode("utf-8", "surrogatepass").split()
        kept, total, end = words, len(words), 0
        if cut := by.get((d, rank)):
            kept = []
            for at, n in sorted(cut):
                kept += words[end:at] if at > end else []
                end = max(end, at + n)
            kept += words[end:]
        out.append((id, total, total - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    ids, n_words, n_removed, sha = zip(*out) if out else ((),) * 4
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def blocks(docs: DataFrame, id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(pid, d, doc_id, text): the documents with their blocks; d puts them in order."""
    doc_id, t = named(id).cast("bigint"), named(text)
    chars, low = docs.agg(F.coalesce(F.sum(F.octet_length(t)), F.lit(0)), F.min(doc_id)).first()
    n = max(1, -(-chars // block_chars))
    # Documents without an id are spread below all ids, unless ids are so low that there is no room for them.
    own = F.shiftrightunsigned(F.xxhash64(t), 2) if low is None or low >= -(1 << 62) else F.lit(0)
    d = F.coalesce(doc_id, F.lit(-(1 << 63)) + own)
    return docs.select(d.alias("d"), doc_id.alias("doc_id"), t.alias("text")).select(F.pmod(F.xxhash64("d"), F.lit(n)).alias("pid"), "d", "doc_id", "text")


def spans(dealt: DataFrame) -> DataFrame:
    """(pid, d, at, n, src_d, src_at): stretches of duplicate windows, and where each stood first.

    at holds the document's rank among those of equal id in its upper 32 bits and the first word in the lower.
    """
    index = dealt.groupBy("pid").applyInArrow(_index, "a bigint, v binary")
    own = Window.partitionBy("a")
    place = F.substring("v", 9, 16)
    alike = Window.partitionBy("a", F.substring("v", 1, 8))
    met = index.withColumn("src", F.min(place).over(alike)).withColumn("n", F.count("*").over(own)).filter("n > 1")
    several = F.min(F.substring("v", 1, 8)).over(own) != F.max(F.substring("v", 1, 8)).over(own)
    met = met.withColumn("several", several).filter((place != F.col("src")) | F.col("several"))
    pid = F.conv(F.hex(F.substring("v", 26, 7)), 16, 10).cast("bigint")
    found = met.select(pid.alias("pid"), "a", F.concat(F.substring("v", 1, 8), F.col("src")).alias("v"))
    parsed = dealt.groupBy("pid").cogroup(found.groupBy("pid")).applyInArrow(_parse, SPAN)
    first = F.min(F.struct("d", "at")).over(Window.partitionBy("w"))
    checked = parsed.withColumn("f", first)
    factor = F.length("w") > 16
    late = (F.col("f.d") != F.col("d")) | (F.col("f.at") != F.col("at"))
    source = lambda c: F.when(factor, F.col(f"src_{c}")).otherwise(F.col(f"f.{c}")).alias(f"src_{c}")
    return checked.filter(factor | late).select("pid", "d", "at", "n", source("d"), source("at"))


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of docs."""
    rows = docs.select(named(id).cast("bigint").alias("doc_id"), named(text).alias("text"))
    long = F.coalesce(F.octet_length("text") >= 2 * WINDOW - 1, F.lit(False))
    words = words_of(F.col("text"))
    count = F.size("w").cast("bigint")
    kept = F.sha2(F.array_join("w", " "), 256).alias("kept_sha256")
    short = rows.filter(~long).select("doc_id", words.alias("w")).select("doc_id", count.alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"), kept)
    key = row_key(F.col("doc_id"), F.col("text"))
    rows = rows.filter(long)
    repeated = checkpointed(rows.groupBy(key[0].alias("k1"), key[1].alias("k2")).agg(F.count("*").alias("n")).filter("n > 1"))
    if repeated.isEmpty():
        return _deduplicated(rows, block_chars).union(short)
    again = picked(rows, repeated, key, keep=True).select(key[0].alias("k1"), key[1].alias("k2"), F.struct("doc_id", "text").alias("row"))
    first = checkpointed(again.groupBy("k1", "k2").agg(F.first("row").alias("row")).join(repeated, ["k1", "k2"]))
    copies = numbered(first.select("k1", "k2", "row.doc_id", words_of(F.col("row.text")).alias("w"), (F.col("n") - 1).alias("n")), "n", "j")
    gone = count >= WINDOW
    rest = copies.select("doc_id", count.alias("n_words"), F.when(gone, count).otherwise(0).alias("n_removed"), F.when(gone, F.sha2(F.lit(""), 256)).otherwise(kept).alias("kept_sha256"))
    one = picked(rows, repeated, key, keep=False).union(first.select("row.*"))
    return _deduplicated(one, block_chars).union(rest).union(short)


def _deduplicated(docs: DataFrame, block_chars: int) -> DataFrame:
    dealt = blocks(docs, block_chars=block_chars)
    return dealt.groupBy("pid").cogroup(spans(dealt).groupBy("pid")).applyInArrow(_kept, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
