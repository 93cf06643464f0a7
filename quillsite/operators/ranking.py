"""Greedy feature ranking and thinning of centroids, on small matrices at the driver."""

from __future__ import annotations

import numpy as np

from ..sources.sites import SiteFrame
from . import stats


def greedy_features(train: SiteFrame, validation: SiteFrame, n: int | None = None, ridge: float = 1e-4, least_gain: float = 0.0) -> list[tuple[str, float]]:
    """(feature, validation error) in the order in which features lower the error of a ridge regression most.

    Two passes over the data in all: the errors of every choice follow from the cross products of both tables.
    """
    names = ["1", *train.features, "y"]
    r, v = (stats.matrix(stats.gram(sf, by_site=False), names) for sf in (train, validation))
    rows, y = max(v[0, 0], 1.0), len(names) - 1

    def error(s: list[int]) -> float:
        w = np.linalg.solve(r[np.ix_(s, s)] + ridge * np.eye(len(s)), r[s, y])
        return float((v[y, y] - 2 * w @ v[s, y] + w @ v[np.ix_(s, s)] @ w) / rows)

    chosen, out = [0], []
    last = error(chosen)
    while len(out) < (n or len(train.features)):
        tried = [(error([*chosen, k]), k) for k in range(1, y) if k not in chosen]
        best, k = min(tried)
        if least_gain and (last - best) / max(last, 1e-300) < least_gain:
            break
        chosen.append(k)
        out.append((names[k], best))
        last = best
    return out


def prune(centroids: np.ndarray, n: int) -> np.ndarray:
    """n of the centroids: again and again one of the two closest ones goes, the later one."""
    kept = list(range(len(centroids)))
    d = ((centroids[:, None] - centroids[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    while len(kept) > n:
        sub = d[np.ix_(kept, kept)]
        i, j = np.unravel_index(np.argmin(sub), sub.shape)
        kept.pop(max(i, j))
    return centroids[kept]


def merged(centroids: np.ndarray, n: int) -> np.ndarray:
    """n centroids: again and again the two closest ones are replaced by their mean."""
    c = np.array(centroids, float)
    while len(c) > n:
        d = ((c[:, None] - c[None]) ** 2).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        i, j = np.unravel_index(np.argmin(d), d.shape)
        c = np.vstack([np.delete(c, (i, j), axis=0), (c[i] + c[j]) / 2])
    return c
