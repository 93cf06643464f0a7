"""Linear, logistic and ridge models over sites.

A training step is one aggregation: a gradient for each site, met by `combine`. `site_mean` gives each site the same
weight, `rows` each row. Momentum, stopping and the weights stay at the driver and enter the next job as literals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import dot, first_greatest, sigmoid
from ..sources import sites
from ..sources.sites import SiteFrame, kept
from . import preprocess, stats

#: Rows times rates that are held at once.
AT_ONCE = 1 << 20


def linear(score: Column) -> Column:
    return score


def gradients(sf: SiteFrame, weights: dict[str, np.ndarray], link, target=None, weight: Column | None = None, error=None) -> DataFrame:
    """(site, n, one column g_class_pos for each weight): sums of (link(score) - y) times 1 and the features.

    weight: what a row counts, also in n. error: a function of score and target instead of their difference.
    """
    target = target or (lambda c: F.col(sf.target))
    sums, own = [], F.lit(1.0) if weight is None else weight
    for k, (c, w) in enumerate(weights.items()):
        s = link(dot(sf.features, w))
        e = own * (error(s, target(c)) if error else s - target(c))
        sums += [F.sum(e * v).alias(f"g_{k}_{j}") for j, v in enumerate([F.lit(1.0), *map(F.col, sf.features)])]
    n = F.count("*") if weight is None else F.sum(weight)
    return sf.df.groupBy(F.col(sf.site).alias("site")).agg(n.alias("n"), *sums)


def combined(parts: DataFrame, how: str = "site_mean") -> DataFrame:
    """One row: the mean (site_mean) or sum (site_sum) of the sites' mean gradients, or the mean over all rows (rows)."""
    names = [c for c in parts.columns if c.startswith("g_")]
    one = {"site_mean": lambda c: F.avg(F.col(c) / F.col("n")), "site_sum": lambda c: F.sum(F.col(c) / F.col("n")), "rows": lambda c: F.sum(c) / F.sum("n")}[how]
    return parts.agg(*(one(c).alias(c) for c in names))


@dataclass
class Linear:
    """Weights by class (one class, '', unless there are many), the intercept first; errors: what was seen on the way."""

    weights: dict[str, np.ndarray]
    features: tuple[str, ...]
    link: str = "linear"
    errors: list[float] = field(default_factory=list)

    def score(self, c: str = "") -> Column:
        s = dot(self.features, self.weights[c])
        return sigmoid(s) if self.link == "sigmoid" else s

    def predict(self, df: DataFrame, name: str = "score") -> DataFrame:
        """df with the score, or with the class of the greatest score, the first of equals."""
        if list(self.weights) == [""]:
            return df.withColumn(name, self.score())
        classes = list(self.weights)
        at = first_greatest([self.score(c) for c in classes])
        return df.withColumn(name, F.get(F.array(*map(F.lit, classes)), at))

    def predict_with(self, df: DataFrame, increments: list[np.ndarray], name: str = "score") -> DataFrame:
        """What scores would be if the increments were added to the weights."""
        moved = Linear({"": self.weights[""] + np.sum(increments, axis=0)}, self.features, self.link)
        return moved.predict(df, name)

    def predict_with_products(self, df: DataFrame, products: list[np.ndarray], penalty: float = 1e-2, blend: float = 1.0, name: str = "score") -> DataFrame:
        """What scores would be if a ridge regression of summed cross products of sites were blended with the weights.

        products: of 1, the features and y, as value.site_matrices() gives them.
        """
        m = np.sum(products, axis=0)
        new = np.linalg.solve(m[:-1, :-1] + penalty * np.eye(len(m) - 1), m[:-1, -1])
        return Linear({"": (1 - blend) * self.weights[""] + blend * new}, self.features, self.link).predict(df, name)

    def save(self, spark: SparkSession, path: str) -> None:
        sites.save_parts(spark, "linear", {"classes": list(self.weights), "features": list(self.features), "link": self.link, "weights": np.array(list(self.weights.values()))}, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Linear:
        _, p = sites.load_parts(spark, path)
        return cls(dict(zip(p["classes"], p["weights"])), tuple(p["features"]), p["link"])


def descend(
    sf: SiteFrame, link: str = "linear", classes: list[str] | None = None, label: str = "class", rate: float = 0.1, momentum: float = 0.0, steps: int = 10, stop: float = 1e-3, combine: str = "site_mean",
    validation: SiteFrame | None = None, aggregate=None, start: dict[str, np.ndarray] | None = None, minibatch: float = 1.0, seed: int = 0, weight: Column | None = None, noise: float = 0.0, error=None,
) -> Linear:
    """Gradient descent for a linear or logistic model, one against the rest with classes.

    validation: rates from 0.01 to 9.99 are tried on it, and the best one is taken, at each step. aggregate: a function
    of the table of site gradients that gives one row, instead of combined(). minibatch: the share of each site's rows
    that a step sees, others at each step. weight: what a row counts, such as stats.balancing(). noise: the deviation of
    normal noise on gradients. error: see gradients().
    """
    names = classes or [""]
    target = (lambda c: (F.col(label) == c).cast("double")) if classes else None
    w = start or {c: np.zeros(len(sf.features) + 1) for c in names}
    out, v = Linear(w, sf.features, link), {c: np.zeros(len(sf.features) + 1) for c in names}
    rng = np.random.default_rng(seed)
    with kept(sf.df):
        for step in range(steps):
            batch = preprocess.minibatch(sf, minibatch, seed + step) if minibatch < 1 else sf
            parts = gradients(batch, out.weights, sigmoid if link == "sigmoid" else linear, target, weight, error)
            row = (aggregate or (lambda p: combined(p, combine)))(parts).first()
            old, new = out.weights, {}
            for k, c in enumerate(names):
                g = np.array([row[f"g_{k}_{j}"] for j in range(len(sf.features) + 1)])
                g = g + rng.normal(0, noise, len(g)) if noise else g
                r = line_search(validation, old[c], g) if validation is not None and not classes and link == "sigmoid" else rate
                v[c] = momentum * v[c] + r * g
                new[c] = old[c] - v[c]
            out = Linear(new, sf.features, link, out.errors)
            moved = sum(np.sum((new[c] - old[c]) ** 2) for c in names) ** 0.5
            size = sum(np.sum(old[c] ** 2) for c in names) ** 0.5
            out.errors.append(moved)
            if size and moved / size < stop:
                break
    return out


def line_search_errors(validation: SiteFrame, w: np.ndarray, g: np.ndarray) -> DataFrame:
    """(rate, error): the mean cross entropy of weights w - rate * g for rates 0.01 to 9.99.

    Two dot products a row; all rates are tried on Arrow batches, and each task gives one sum for each rate.
    """
    a, b = dot(validation.features, w), dot(validation.features, g)
    rows = validation.df.select(a.alias("a"), b.alias("b"), F.col(validation.target).cast("double").alias("y"))
    rates = np.arange(1, 1000) / 100.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(rates)), 0
        for batch in batches:
            x, z, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for at in range(0, len(x), max(AT_ONCE // len(rates), 1)):
                k = slice(at, at + max(AT_ONCE // len(rates), 1))
                o = 1 / (1 + np.exp(z[k, None] * rates - x[k, None])) * (1 - 2e-6) + 1e-6
                sums += np.where(y[k, None] == 1, -np.log(o), np.where(y[k, None] == 0, -np.log(1 - o), -y[k, None] * np.log(o) - (1 - y[k, None]) * np.log(1 - o))).sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(rates), pa.array(sums), pa.array(np.full(len(rates), n))], ["rate", "s", "n"])

    parts = rows.mapInArrow(run, "rate double, s double, n bigint")
    return parts.groupBy("rate").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("error"))


def line_search(validation: SiteFrame, w: np.ndarray, g: np.ndarray) -> float:
    return line_search_errors(validation, w, g).agg(F.min_by("rate", F.struct("error", "rate"))).first()[0]


def ridge_of(products: DataFrame, features: tuple[str, ...], ridge: float) -> np.ndarray:
    """(XᵀX + λI)⁻¹ Xᵀy of a gram() table, the intercept included in I."""
    m = stats.matrix(products, ["1", *features, "y"])
    return np.linalg.solve(m[:-1, :-1] + ridge * np.eye(len(m) - 1), m[:-1, -1])


def ridge(sf: SiteFrame, penalty: float = 1e-2) -> Linear:
    """Ridge regression in one pass."""
    return Linear({"": ridge_of(stats.gram(sf, by_site=False), sf.features, penalty)}, sf.features)
