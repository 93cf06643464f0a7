"""Plain Python versions of what the operators return, over lists of rows in memory."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def deduplicate(docs, window=20):
    """{doc_id: (n_words, n_removed, kept_sha256)} of [(doc_id, text)] with different ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone.update(range(i, i + window))
            seen.add(k)
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[doc_id] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def fingerprint(text, n=3):
    w = words(lower(text))
    grams = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(prints, distance=2):
    """{doc_id: least id reachable} of {doc_id: fingerprint}, by comparing all pairs of fingerprints."""
    own = {}
    for d, f in prints.items():
        own[f] = min(d, own.get(f, d))
    parent = {f: f for f in own}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    fs = list(own)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    least = defaultdict(lambda: 1 << 62)
    for f, d in own.items():
        least[root(f)] = min(least[root(f)], d)
    return {d: least[root(f)] for d, f in prints.items()}


def leaks(docs, items, share=0.8, n=5):
    """{(doc_id, item_id): (shared, size)}."""

    def grams(text):
        w = words(lower(text))
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    out, found = {}, [(i, grams(t)) for i, t in items]
    for d, t in docs:
        g = grams(t)
        for i, s in found:
            if s and len(s & g) >= share * len(s) - 1e-9:
                out[d, i] = (len(s & g), len(s))
    return out


def targets(sizes, weights=(1, 2, 3), cap=3):
    """{source: target} of {source: size}: shares by weight, capped, the excess shared out again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return share | {s: float(cap * sizes[s]) for s in full}
        full |= over


def repeated(w, n=3):
    at = defaultdict(list)
    for i in range(len(w) - n + 1):
        at[tuple(w[i : i + n])].append(i)
    return len({i + k for p in at.values() if len(p) > 1 for i in p for k in range(n)})
