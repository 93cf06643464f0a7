"""Small neural networks over sites: mean weights, mean gradients, or site after site.

A step of all sites is one job: each task sums gradients by site over Arrow batches, so no site must fit in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sites as tables
from ..sources.sites import SiteFrame, kept
from . import preprocess


class Network:
    """Dense layers with tanh, and a sigmoid, identity or softmax at the end; weights as one vector."""

    def __init__(self, sizes: tuple[int, ...], out: str = "sigmoid", seed: int = 0):
        self.sizes, self.out = sizes, out
        rng = np.random.default_rng(seed)
        self.w = np.concatenate([np.r_[rng.normal(0, 1 / np.sqrt(a), a * b), np.zeros(b)] for a, b in zip(sizes, sizes[1:])])

    def layers(self, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, x: np.ndarray, w: np.ndarray | None = None) -> list[np.ndarray]:
        acts, layers = [x], self.layers(self.w if w is None else w)
        for i, (m, b) in enumerate(layers):
            z = acts[-1] @ m + b
            if i < len(layers) - 1:
                z = np.tanh(z)
            elif self.out == "sigmoid":
                z = 1 / (1 + np.exp(-z))
            elif self.out == "softmax":
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
            acts.append(z)
        return acts

    def gradient(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The sum over rows of the loss's gradient: cross entropy, or half the squared error for the identity."""
        acts, layers, parts = self.forward(x, w), self.layers(w), []
        d = acts[-1] - y
        for i in range(len(layers) - 1, -1, -1):
            parts.append(np.r_[(acts[i].T @ d).ravel(), d.sum(axis=0)])
            if i:
                d = (d @ layers[i][0].T) * (1 - acts[i] ** 2)
        return np.concatenate(parts[::-1])


    def save(self, spark: SparkSession, path: str) -> None:
        tables.save_parts(spark, "network", {"sizes": list(self.sizes), "out": self.out, "w": self.w}, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Network:
        _, p = tables.load_parts(spark, path)
        net = cls(tuple(p["sizes"]), p["out"])
        net.w = p["w"]
        return net


def _targets(sf: SiteFrame, targets: tuple[str, ...] | None) -> list:
    return [F.col(t).cast("double").alias(f"_t{i}") for i, t in enumerate(targets or (sf.target,))]


def site_gradients(sf: SiteFrame, net: Network, weights: dict[int, np.ndarray], targets: tuple[str, ...] | None = None) -> dict[int, tuple[np.ndarray, int]]:
    """Each site's mean gradient at its own weights, and its number of rows. targets: a column for each output."""
    n_in = len(sf.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            site = b.column(0).to_numpy()
            x, y = (np.stack([b.column(i).to_numpy() for i in r], axis=1) for r in (range(1, n_in + 1), range(n_in + 1, b.num_columns)))
            for s in np.unique(site):
                k = site == s
                if int(s) in weights:
                    sums[int(s)] = sums.get(int(s), 0) + np.r_[net.gradient(x[k], y[k], weights[int(s)]), k.sum()]
        for s, g in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), s, np.int32)), pa.array(np.arange(len(g), dtype=np.int32)), pa.array(g)], ["site", "pos", "g"])

    rows = sf.df.select(F.col(sf.site).cast("int").alias("site"), *sf.features, *_targets(sf, targets))
    parts = rows.mapInArrow(run, "site int, pos int, g double").groupBy("site", "pos").agg(F.sum("g").alias("g")).collect()
    out: dict[int, np.ndarray] = {s: np.zeros(len(net.w) + 1) for s in weights}
    for r in parts:
        out[r["site"]][r["pos"]] = r["g"]
    return {s: (g[:-1] / max(g[-1], 1), int(g[-1])) for s, g in out.items()}


def processed(sf: SiteFrame, weights: dict[int, np.ndarray], process, targets: tuple[str, ...] | None = None) -> dict[int, np.ndarray]:
    """Each site's weights after its own function: process(weights, x, y) -> weights, on all rows of the site at once.

    So a site must fit in a task here, which built-in training doesn't need.
    """
    n_in, site = len(sf.features), F.col(sf.site).cast("int")

    def run(key, pdf):
        import pandas as pd

        x, y = pdf.iloc[:, 1 : n_in + 1].to_numpy(float), pdf.iloc[:, n_in + 1 :].to_numpy(float)
        w = process(weights[int(key[0])], x, y)
        return pd.DataFrame({"site": int(key[0]), "pos": np.arange(len(w)), "w": w})

    rows = sf.df.select(site.alias("site"), *sf.features, *_targets(sf, targets)).groupBy("site").applyInPandas(run, "site int, pos int, w double").collect()
    out = {s: np.zeros(len(w)) for s, w in weights.items()}
    for r in rows:
        out[r["site"]][r["pos"]] = r["w"]
    return out


def train(
    sf: SiteFrame, net: Network, how: str = "mean_weights", rounds: int = 3, epochs: int = 2, rate: float = 0.1, momentum: float = 0.0, nesterov: bool = False, minibatch: float = 1.0, seed: int = 0,
    targets: tuple[str, ...] | None = None, process=None,
) -> Network:
    """net, trained: mean_weights, median_weights, mean_gradients (with momentum), or sequential.

    minibatch: the share of each site's rows that a step sees, others at each step. targets: a column for each output.
    process: a function that trains on a site instead, see processed().
    """
    w, acc, step = net.w, np.zeros(len(net.w)), seed

    def batch(part: SiteFrame) -> SiteFrame:
        nonlocal step
        step += 1
        return preprocess.minibatch(part, minibatch, step) if minibatch < 1 else part

    with kept(sf.df):
        sites = sorted(r[0] for r in sf.df.select(sf.site).distinct().collect())
        for _ in range(rounds):
            if how == "mean_gradients":
                g = np.mean([x for x, _ in site_gradients(batch(sf), net, {s: w for s in sites}, targets).values()], axis=0)
                w, acc = server_step(w, g, acc, rate, momentum, nesterov)
                continue
            for group in [[s] for s in sites] if how == "sequential" else [sites]:
                own, part = {s: w for s in group}, sf.only(group)
                if process:
                    own = processed(part, own, process, targets)
                else:
                    for _ in range(epochs):
                        own = {s: own[s] - rate * g for s, (g, _) in site_gradients(batch(part), net, own, targets).items()}
                w = np.median(list(own.values()), axis=0) if how == "median_weights" else np.mean(list(own.values()), axis=0)
    net.w = w
    return net


def server_step(w: np.ndarray, g: np.ndarray, acc: np.ndarray, rate: float, momentum: float = 0.0, nesterov: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Weights and velocity after a step of gradient descent at the server."""
    acc = momentum * acc - rate * g
    return (w + momentum * acc - rate * g if nesterov else w + acc), acc


def predict(sf: SiteFrame, net: Network, name: str = "score", every: bool = False) -> DataFrame:
    """sf.df with the first output of the network; with every, an array of all outputs."""

    def outputs(*columns):
        return net.forward(np.stack([c.to_numpy(dtype=float) for c in columns], axis=1))[-1]

    @F.pandas_udf("array<double>" if every else "double")
    def of(*columns):
        import pandas as pd

        found = outputs(*columns)
        return pd.Series(list(found) if every else found[:, 0])

    return sf.df.withColumn(name, of(*sf.features))


def averaged(weights, how: str = "mean"):
    """(class, pos, w) of a table (site, class, pos, w): the mean or the median over sites."""
    return weights.groupBy("class", "pos").agg((F.avg("w") if how == "mean" else F.percentile("w", F.lit(0.5))).alias("w"))
