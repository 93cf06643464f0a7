"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: the density of lexicon words, how near they stand to the second person, capitals, punctuation and
obfuscation. The lexicon has a fixed part and a learned one: words and beginnings of words that are far more frequent in
toxic training documents. Nothing sees its own answers: trees are fitted to features whose lexicon was learned on other
rows (three folds), and calibrated on scores of rows that neither the trees nor any lexicon of their features had seen.
The calibration is isotonic.

The model is fitted on a bounded sample of labelled documents, those with the smallest hashes of their ids, as far as
they fit into a number of characters; all texts are scored whole.

Cases: a null or blank text has all features zero and gets a score too. Without labelled documents every score is 0; if
all are toxic or none is, every score is the share of toxic ones, 1 or 0. A document with several labels counts as toxic
if one of them says so; of texts with equal ids the least one teaches, and a label without an id teaches nothing. Equal
rows are scored alike; null and equal ids are carried along. Ties between cuts of a feature go to the first feature and
the lowest cut. An empty table gives an empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, checkpointed, named
from .language import held_out, within

#: Labelled documents in the sample, and the score from which a document is predicted to be toxic.
SAMPLE, THRESHOLD = 12_000, 0.3
#: The characters of the sample, at most.
CHARS = 48_000_000
FOLDS, TREES, DEPTH, RATE, BINS, LEAST = 3, 80, 3, 0.1, 64, 10
#: A learned entry is in so many toxic documents, and so many times as frequent there as in others.
SUPPORT, RATIO, PREFIX = 8, 8.0, (3, 10)

# Insults, and words of the second person in several languages.
INSULTS = frozenset("ass asshole bastard bitch clown crap creep cunt damn dick disgusting dumb dumbass fool freak fuck garbage hate idiot idiotic imbecile jerk kill loser moron moronic pathetic pig retard scum shit slut stupid sucker trash ugly vermin whore worthless arschloch depp dumm idiota imbécile con connard crétin débile estúpido gilipollas imbécil merde pendejo puta putain salaud scheisse scheiße trottel wichser".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
WORD = re.compile(r"[^\W\d_]+")
#: A letter, then symbols or digits that stand for letters, then a letter again.
MASKED = re.compile(r"[^\W\d_][@$!*#%&+013457]+[^\W\d_]")
LONG = re.compile(r"([^\W\d_])\1\1")
LEET = str.maketrans("@$!013457", "asioleast")
MASKED_WORD = re.compile(r"(?<![^\W_])[^\W_]*[^\W\d_][@$!*013457]+[^\W\d_][^\W_]*")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
MARKS = re.compile(r"[!?]")
OTHER = re.compile(r"[^\w\s]")
NAMES = ("hits", "density", "weight", "near", "fixed", "fixed_density", "masked_hits", "masked", "long", "upper", "caps_words", "marks", "other", "second", "log_words")


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def entries(words: set[str]) -> set[str]:
    """What a document's words may put into a lexicon: whole words, marked by $, and beginnings of words."""
    out = {w + "$" for w in words if len(w) > 1}
    for w in words:
        out.update(w[:n] for n in range(PREFIX[0], min(len(w), PREFIX[1]) + 1))
    return out


class Lexicon:
    """Words and beginnings of words with the logarithm of how much more frequent they are in toxic documents."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.memo = weights, {}

    def __getstate__(self):
        return {"weights": self.weights, "memo": {}}

    def weight(self, word: str) -> float:
        if (w := self.memo.get(word)) is None:
            get = self.weights.get
            w = max([get(word + "$", 0.0), *(get(word[:n], 0.0) for n in range(PREFIX[0], min(len(word), PREFIX[1]) + 1))])
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[word] = w
        return w


def near(at: np.ndarray, you: np.ndarray) -> int:
    """How many of the sorted places at are at most three words away from one of the sorted places you."""
    if not len(at) or not len(you):
        return 0
    k = np.searchsorted(you, at)
    gap = np.minimum(np.abs(at - you[np.minimum(k, len(you) - 1)]), np.abs(at - you[np.maximum(k - 1, 0)]))
    return int((gap <= 3).sum())


def parts(text: str | None) -> tuple[list[str], list[str], list[float]]:
    """The words of a text, its masked words in plain letters, and shares of characters and words, as the end of NAMES."""
    text = text or ""
    words = tokens(text)
    masked = MASKED_WORD.findall(text) if MASKED.search(text) else []
    n, size, upper = max(len(words), 1), max(len(text), 1), len(UPPER.findall(text))
    shares = [
        len(masked) / n, len(LONG.findall(text)) / n, upper / size, float(upper > 0.5 * size), len(MARKS.findall(text)) / size, len(OTHER.findall(text)) / size,
        sum(w in SECOND for w in words) / n, float(np.log1p(len(words))),
    ]
    return words, [m.lower().translate(LEET) for m in masked], shares


def joined(n: int, weights: list[float], hits: int, close: int, fixed: int, masked_hits: int, shares: list[float]) -> list[float]:
    """The features, in the order of NAMES. Weights are added up exactly, so their order doesn't matter."""
    n = max(n, 1)
    return [float(np.log1p(hits)), hits / n, math.fsum(weights) / n, close / n, float(np.log1p(fixed)), fixed / n, float(np.log1p(masked_hits)), *shares]


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    words, plain, shares = parts(text)
    counts = Counter(words)
    hit = {w: x for w in counts if (x := lexicon.weight(w)) > 0}
    at = np.array([i for i, w in enumerate(words) if w in hit or w in INSULTS], np.int64) if hit or not INSULTS.isdisjoint(counts) else np.zeros(0, np.int64)
    you = np.array([i for i, w in enumerate(words) if w in SECOND], np.int64) if len(at) else at
    masked_hits = sum(w in INSULTS or lexicon.weight(w) > 0 for w in plain)
    return joined(len(words), [counts[w] * x for w, x in hit.items()], sum(counts[w] for w in hit), near(at, you), sum(counts[w] for w in counts if w in INSULTS), masked_hits, shares)


class Sample:
    """Labelled texts as numbers of words, with what their features need besides a lexicon.

    counts: for each class and fold, in how many documents each entry is. Only entries of enough toxic documents can
    enter a lexicon, and no others are kept.
    """

    def __init__(self, texts: list[str | None], y: np.ndarray, fold: np.ndarray):
        self.vocabulary: dict[str, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary))
        self.words, self.plain, self.shares = [], [], []
        for t in texts:
            words, plain, shares = parts(t)
            self.words.append(np.fromiter(map(number, words), np.int32, len(words)))
            self.plain.append(plain)
            self.shares.append(shares)
        self.names = list(self.vocabulary)
        self.insult, self.second = (np.array([w in known for w in self.names], bool) for known in (INSULTS, SECOND))
        support: Counter = Counter()
        for ids, v in zip(self.words, y):
            if v:
                support.update(entries({self.names[i] for i in np.unique(ids)}))
        self.entries = sorted(e for e, a in support.items() if a >= SUPPORT)
        at = {e: i for i, e in enumerate(self.entries)}
        own = [np.array(sorted(at[e] for e in entries({w}) if e in at), np.int64) for w in self.names]
        size = np.array([len(x) for x in own], np.int64)
        self.starts, self.own = np.concatenate([[0], np.cumsum(size)]), np.concatenate([*own, np.zeros(0, np.int64)])
        self.counts = np.zeros((2, FOLDS, len(self.entries)), np.int64)
        for ids, v, k in zip(self.words, y, fold):
            found = [self.own[self.starts[i] : self.starts[i + 1]] for i in np.unique(ids)]
            if found:
                self.counts[int(v), k, np.unique(np.concatenate(found))] += 1
        self.size = np.array([[((y == v) & (fold == k)).sum() for k in range(FOLDS)] for v in (0, 1)])

    def lexicon(self, *without: int) -> Lexicon:
        """The lexicon of all folds but some."""
        used = [k for k in range(FOLDS) if k not in without]
        (n0, n1), (others, toxic) = self.size[:, used].sum(axis=1), self.counts[:, used].sum(axis=1)
        ratio = (toxic / max(n1, 1)) / ((others + 0.5) / (n0 + 1))
        return Lexicon({self.entries[i]: float(np.log(ratio[i])) for i in np.flatnonzero((toxic >= SUPPORT) & (ratio >= RATIO))})

    def features(self, rows: np.ndarray, lexicon: Lexicon) -> np.ndarray:
        """What features() gives for some of the texts."""
        known = np.array([lexicon.weights.get(e, 0.0) for e in self.entries] + [0.0])
        some = self.starts[1:] > self.starts[:-1]
        weight = np.zeros(len(self.names))
        if some.any():  # the greatest weight of a word's entries; runs of words without any are empty
            weight[some] = np.maximum.reduceat(known[self.own], self.starts[:-1][some])
        out = []
        for r in rows:
            ids = self.words[r]
            hit, fixed = weight[ids] > 0, self.insult[ids]
            at = np.flatnonzero(hit | fixed)
            found, n = np.unique(ids[hit], return_counts=True)
            masked_hits = sum(w in INSULTS or lexicon.weight(w) > 0 for w in self.plain[r])
            close = near(at, np.flatnonzero(self.second[ids])) if len(at) else 0
            out.append(joined(len(ids), (n * weight[found]).tolist(), int(hit.sum()), close, int(fixed.sum()), masked_hits, self.shares[r]))
        return np.array(out).reshape(-1, len(NAMES))


class Trees:
    """Gradient-boosted trees for a yes or no, over features cut into bins at quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
        b, mean = self.binned(x), float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.base = float(np.log(mean / (1 - mean)))
        self.trees, s = [], np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-s))
            tree: list = []
            s = s + RATE * self._grow(b, y - p, p * (1 - p), np.arange(len(y)), DEPTH, tree, np.zeros(len(y)))
            self.trees.append(tree)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], axis=1) if len(x) else np.zeros((0, len(self.cuts)), int)

    def _grow(self, b, g, h, rows, depth, tree, out):
        """Appends the nodes of a tree in preorder: (feature, bin, left, right) or (value,); sets out at its rows."""
        at = len(tree)
        tree.append(None)
        value = float(g[rows].sum() / (h[rows].sum() + 1.0))
        best = (1e-6, None, None)
        if depth and len(rows) >= 2 * LEAST:
            for f in range(b.shape[1]):
                n = np.bincount(b[rows, f], minlength=BINS).cumsum()
                gl, hl = np.bincount(b[rows, f], g[rows], BINS).cumsum(), np.bincount(b[rows, f], h[rows], BINS).cumsum()
                gain = gl**2 / (hl + 1) + (gl[-1] - gl) ** 2 / (hl[-1] - hl + 1) - gl[-1] ** 2 / (hl[-1] + 1)
                gain[(n < LEAST) | (n > len(rows) - LEAST)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        _, f, k = best
        if f is None:
            tree[at], out[rows] = (value,), value
        else:
            low = b[rows, f] <= k
            left = len(tree)
            self._grow(b, g, h, rows[low], depth - 1, tree, out)
            right = len(tree)
            self._grow(b, g, h, rows[~low], depth - 1, tree, out)
            tree[at] = (f, k, left, right)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        b, s = self.binned(x), np.full(len(x), self.base)
        for tree in self.trees:
            pending = [(0, np.arange(len(x)))]
            while pending:
                at, rows = pending.pop()
                if len(tree[at]) == 1:
                    s[rows] += RATE * tree[at][0]
                elif len(rows):
                    f, k, left, right = tree[at]
                    low = b[rows, f] <= k
                    pending += [(left, rows[low]), (right, rows[~low])]
        return 1 / (1 + np.exp(-s))


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best non-decreasing fit of y on scores (pooled adjacent violators), as points to interpolate between."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []  # mean, weight, score sum
    for s, v in zip(scores[order], y[order]):
        pools.append([float(v), 1.0, float(s)])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, w, t = pools.pop()
            a = pools[-1]
            a[0], a[1], a[2] = (a[0] * a[1] + m * w) / (a[1] + w), a[1] + w, a[2] + t
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] for p in pools])


class Model:
    """Lexicon, trees and calibration, fitted to texts and labels."""

    def __init__(self, texts: list[str | None], toxic: list[int]):
        y = np.array(toxic, float)
        self.trees, self.constant = None, float(y.mean()) if len(y) else 0.0
        if not 0 < y.sum() < len(y):
            return
        fold = np.arange(len(y)) % FOLDS
        sample = Sample(texts, y, fold)
        rows = [np.flatnonzero(fold == k) for k in range(FOLDS)]
        x, apart = np.zeros((len(y), len(NAMES))), np.zeros(len(y))
        for k in range(FOLDS):
            x[rows[k]] = sample.features(rows[k], sample.lexicon(k))
        for k in range(FOLDS):
            rest = [j for j in range(FOLDS) if j != k]
            seen = np.concatenate([sample.features(rows[j], sample.lexicon(j, k)) for j in rest])
            apart[rows[k]] = Trees(seen, np.concatenate([y[rows[j]] for j in rest])).score(x[rows[k]])
        self.points = isotonic(apart, y)
        self.trees, self.lexicon = Trees(x, y), sample.lexicon()

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.constant)
        x = np.array([features(t, self.lexicon) for t in texts])
        return np.clip(np.interp(self.trees.score(x), *self.points), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE, chars: int = CHARS) -> Model:
    """The model of labelled documents that aren't held out, from at most `sample` of them and so many characters."""
    known = labels.select(named(id).alias("doc_id"), named(toxic).alias("toxic")).filter("toxic is not null")
    known = known.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample)
    texts = docs.select(named(id).alias("doc_id"), named(text).alias("text"))
    got = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    got = checkpointed(got.withColumn("r", F.xxhash64("doc_id", F.lit(3))))
    sizes = got.select("doc_id", "r", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy("r", "doc_id").collect()
    ids = within([(r["doc_id"], r["n"]) for r in sizes], chars)
    if len(ids) < len(sizes):
        own = got.sparkSession.createDataFrame([(i,) for i in ids], got.select("doc_id").schema)
        got = got.join(bounded(own), "doc_id")
    rows = got.orderBy("doc_id").select("text", "toxic").collect()
    return Model([r["text"] for r in rows], [int(r["toxic"] > 0) for r in rows])


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array(found >= threshold).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(named(id).alias("doc_id"), held_out(named(id)).alias("held_out"), named(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
