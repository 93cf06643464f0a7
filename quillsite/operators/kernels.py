"""Models over Gaussian kernels of a few centroids: kernel regression, support vector machines and their budgets.

Kernel columns are made once and kept; a step is one aggregation over them, of gradients or of weighted cross products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import WIDE, dot, first_greatest, gaussian, squared_distances
from ..sources import sites as tables
from ..sources.sites import SiteFrame, kept
from . import linear, metrics, stats

#: Bins of scores by which blends are first told apart.
BINS = 8192


def width(n_features: int, factor: float = 1.0) -> float:
    return n_features**0.5 * factor


def features(sf: SiteFrame, centroids, sigma: float, halved: bool = True) -> SiteFrame:
    """sf with columns k1, k2, … instead of its features."""
    if len(sf.features) <= WIDE:
        made = {f"k{i + 1}": gaussian(sf.features, c, sigma, halved) for i, c in enumerate(centroids)}
        return sf.having(sf.df.withColumns(made), tuple(made))
    size = F.lit((2.0 if halved else 1.0) * sigma * sigma)
    made = {f"k{i + 1}": F.exp(-F.get("_d", F.lit(i)) / size) for i in range(len(centroids))}
    return sf.having(sf.df.withColumn("_d", squared_distances(sf.features, centroids)).withColumns(made).drop("_d"), tuple(made))


def own_kernel(centroids: np.ndarray, sigma: float, corner: float = 1e-5, halved: bool = True) -> np.ndarray:
    """Kernels among the centroids, with a row and a column for the intercept."""
    d = ((centroids[:, None] - centroids[None]) ** 2).sum(axis=2)
    out = np.zeros((len(centroids) + 1,) * 2)
    out[1:, 1:], out[0, 0] = np.exp(-d / ((2.0 if halved else 1.0) * sigma**2)), corner
    return out


def centroid_scores(sf: SiteFrame, centroids, sigma: float, how: str = "sum") -> DataFrame:
    """(centroid, score): the sum of its kernels, or the number of rows it is the nearest to."""
    kf = features(sf, centroids, sigma)
    ks = [F.col(k) for k in kf.features]
    if how == "winners":
        return kf.df.groupBy(first_greatest(ks).alias("centroid")).agg(F.count("*").cast("double").alias("score"))
    sums = kf.df.agg(*(F.sum(k).alias(f"s{i}") for i, k in enumerate(ks)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(i).alias("centroid"), F.col(f"s{i}").alias("score")) for i in range(len(ks))))).alias("r")).select("r.*")


@dataclass
class Kernel:
    """Weights over kernels of centroids; by class if there are several."""

    weights: dict[str, np.ndarray]
    centroids: np.ndarray
    sigma: float
    halved: bool = True
    intercept: bool = True

    def scores(self, sf: SiteFrame) -> tuple[SiteFrame, dict[str, Column]]:
        kf = features(sf, self.centroids, self.sigma, self.halved)
        return kf, {c: dot(kf.features, w, self.intercept) for c, w in self.weights.items()}

    def predict(self, sf: SiteFrame, name: str = "score", hard: bool = False) -> DataFrame:
        """Scores; with hard their signs; with several classes the one of the greatest score, the first of equals."""
        kf, s = self.scores(sf)
        if list(s) == [""]:
            value = F.when(s[""] >= 0, 1.0).otherwise(-1.0) if hard else s[""]
        else:
            value = F.get(F.array(*map(F.lit, s)), first_greatest(list(s.values())))
        return kf.df.withColumn(name, value).drop(*kf.features)


    def predict_soft(self, sf: SiteFrame, name: str = "scores") -> DataFrame:
        """A map from each class to its score."""
        kf, s = self.scores(sf)
        return kf.df.withColumn(name, F.create_map(*(x for c, v in s.items() for x in (F.lit(c), v)))).drop(*kf.features)

    def save(self, spark: SparkSession, path: str) -> None:
        parts = {"classes": list(self.weights), "weights": np.array(list(self.weights.values())), "centroids": self.centroids, "sigma": self.sigma, "halved": self.halved, "intercept": self.intercept}
        tables.save_parts(spark, "kernel", parts, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Kernel:
        _, p = tables.load_parts(spark, path)
        return cls(dict(zip(p["classes"], p["weights"])), p["centroids"], p["sigma"], p["halved"], p["intercept"])


def validation_start(vf: SiteFrame, penalty: float) -> np.ndarray:
    """Weights of a ridge regression on the kernel columns of the validation rows, all sums divided by their number."""
    m = stats.matrix(stats.gram(vf, by_site=False), ["1", *vf.features, "y"])
    m = m / max(m[0, 0], 1.0)
    return np.linalg.solve(m[:-1, :-1] + penalty * np.eye(len(m) - 1), m[:-1, -1])


def regress(
    sf: SiteFrame, centroids: np.ndarray, sigma: float, penalty: float = 1e-2, steps: int = 0, rate: float = 0.1, momentum: float = 0.0, validation: SiteFrame | None = None, **how,
) -> Kernel:
    """Kernel regression: closed form, or so many steps of gradient descent; how: see linear.descend().

    validation: gradient descent starts from a ridge regression on its rows instead of zero.
    """
    kf = features(sf, centroids, sigma)
    if not steps:
        return Kernel({"": linear.ridge_of(stats.gram(kf, by_site=False), kf.features, penalty)}, centroids, sigma)
    if validation is not None:
        how["start"] = {"": validation_start(features(validation, centroids, sigma), penalty)}
    return Kernel({"": linear.descend(kf, steps=steps, rate=rate, momentum=momentum, **how).weights[""]}, centroids, sigma)


def beyond_margin(s: Column, y: Column) -> Column:
    """The error of a score, or 0 where the row is on the right side of its margin: y (y - s) not above 0."""
    return F.when(y * (y - s) > 0, s - y).otherwise(0.0)


def sign_svm(sf: SiteFrame, centroids: np.ndarray, sigma: float, penalty: float = 1e-2, validation: SiteFrame | None = None, **how) -> Kernel:
    """A support vector machine by gradient steps along the errors of rows inside their margin; how: see descend()."""
    signed = lambda f: SiteFrame(f.df.withColumn("_y", sign_target(f)), f.features, "_y", f.site, f.id)
    kf = signed(features(sf, centroids, sigma))
    if validation is not None:
        how["start"] = {"": validation_start(signed(features(validation, centroids, sigma)), penalty)}
    return Kernel({"": linear.descend(kf, error=beyond_margin, **how).weights[""]}, centroids, sigma)


def sign_target(sf: SiteFrame, c: str = "", label: str = "class") -> Column:
    """The target as -1 and 1: of a class, or of 0 and 1."""
    return (F.when(F.col(label) == c, 1.0).otherwise(-1.0)) if c else F.col(sf.target) * 2.0 - 1.0


def hinge_gradients(kf: SiteFrame, w: np.ndarray, cost: float, y: Column) -> DataFrame:
    """(site, g0, g1, …): sums of -C y k(x) over the rows with y s < 1; no intercept."""
    inside = y * dot(kf.features, w, False) < 1
    return kf.df.groupBy(F.col(kf.site).alias("site")).agg(*(F.sum(F.when(inside, -F.lit(cost) * y * F.col(k)).otherwise(0.0)).alias(f"g{i}") for i, k in enumerate(kf.features)))


def svm(sf: SiteFrame, centroids: np.ndarray, sigma: float, cost: float = 1.0, rate: float = 1e-3, steps: int = 10, combine: str = "mean") -> Kernel:
    """A support vector machine by gradient steps: gradients of sites are averaged, summed, or taken one by one."""
    kf = features(sf, centroids, sigma, halved=False)
    y, w = sign_target(sf), np.zeros(len(centroids))
    with kept(kf.df):
        sites = sorted(r[0] for r in kf.df.select(kf.site).distinct().collect()) if combine == "sequential" else [None]
        for _ in range(steps):
            for s in sites:
                part = kf if s is None else kf.only([s])
                g = hinge_gradients(part, w, cost, y)
                how = F.avg if combine == "mean" else F.sum
                row = g.agg(*(how(f"g{i}") for i in range(len(w)))).first()
                w = w - rate * np.array([v or 0.0 for v in row])
    return Kernel({"": w}, centroids, sigma, halved=False, intercept=False)


def irwls_weight(e: Column, cost: float, eps: float) -> Column:
    """The weight of a row of margin error e = 1 - y s: 0 if negative, 2C / e down to eps, 2C / eps below."""
    return F.when(e < 0, 0.0).when(e >= eps, F.lit(2 * cost) / e).otherwise(F.lit(2 * cost / eps))


def weighted_gram(kf: SiteFrame, w: np.ndarray, y: Column, cost: float, eps: float, by_site: bool = False, weight: Column | None = None) -> DataFrame:
    """KᵀAK and KᵀAy at weights w as a gram() table; weight: what a row counts besides."""
    a = irwls_weight(F.lit(1.0) - y * dot(kf.features, w), cost, eps)
    a = a if weight is None else a * weight
    return stats.gram(SiteFrame(kf.df.withColumn("_y", y), kf.features, "_y", kf.site, kf.id), by_site, weight=a)


def solved(products: DataFrame, names: tuple[str, ...], kcc: np.ndarray) -> np.ndarray:
    m = stats.matrix(products, ["1", *names, "y"])
    return np.linalg.solve(m[:-1, :-1] + kcc, m[:-1, -1])


def budget_svm(
    sf: SiteFrame, centroids: np.ndarray, sigma: float, cost: float = 1.0, eps: float = 1e-4, steps: int = 10, blend: float = 1.0, stop: float = 1e-3, corner: float = 1e-5, classes: list[str] | None = None, label: str = "class",
    validation: SiteFrame | None = None, search: bool = False, weight: Column | None = None,
) -> Kernel:
    """A support vector machine with given centroids by reweighted least squares over the rows of all sites.

    classes: one against the rest. validation: stops when its accuracy no longer rises. search: instead, the blend of old
    and new weights from -1 to 2 with the best area under the curve on it is taken at each step. weight: what a row
    counts, such as stats.balancing().
    """
    kf, kcc = features(sf, centroids, sigma), own_kernel(centroids, sigma, corner)
    names = classes or [""]
    w = {c: np.zeros(len(centroids) + 1) for c in names}
    best, good = -1.0, w
    with kept(kf.df):
        for _ in range(steps):
            old, w = w, {}
            for c in names:
                new = solved(weighted_gram(kf, old[c], sign_target(sf, c, label), cost, eps, weight=weight), kf.features, kcc)
                lam = best_blend(validation, centroids, sigma, old[c], new) if search and validation is not None else blend
                w[c] = (1 - lam) * old[c] + lam * new
            moved = sum(np.sum((w[c] - old[c]) ** 2) for c in names) ** 0.5 / (sum(np.sum(old[c] ** 2) for c in names) ** 0.5 or 1.0)
            if validation is not None and not search:
                model = Kernel(w, centroids, sigma)
                found = model.predict(validation, "_p", hard=not classes).withColumn("_t", F.col(label) if classes else sign_target(validation))
                acc = metrics.accuracy(found, "_p", "_t").first()[0]
                if acc <= best:
                    w = good
                    break
                best, good = acc, w
            if moved < stop:
                break
    return Kernel(w, centroids, sigma)


def blend_bounds(rows: DataFrame, steps: range) -> DataFrame:
    """(k, low, high): bounds of the area under the curve of scores (1 - k / 100) a + k / 100 b on rows (a, b, y).

    Scores are counted in BINS bins on Arrow batches, all blends at once; within a bin the order is left open.
    """
    lam = np.array(steps) / 100.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, len(lam) * BINS), np.int64)
        for batch in batches:
            a, b, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for at in range(0, len(a), 4096):
                k = slice(at, at + 4096)
                s = a[k, None] * (1 - lam) + b[k, None] * lam
                bin_ = np.clip(((0.5 + np.arctan(s) / np.pi) * BINS).astype(np.int64), 0, BINS - 1) + np.arange(len(lam)) * BINS
                for v in (0, 1):
                    counts[v] += np.bincount(bin_[(y[k] > 0.5) == v].ravel(), minlength=counts.shape[1])
        seen = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen // BINS), pa.array(seen % BINS), pa.array(counts[0, seen]), pa.array(counts[1, seen])], ["i", "bin", "n", "p"])

    sums = rows.mapInArrow(run, "i bigint, bin bigint, n bigint, p bigint").groupBy("i", "bin").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("i").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    area = lambda x: F.sum(F.col("p") * x) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))
    found = sums.withColumn("below", below).groupBy("i").agg(area(F.col("below")).alias("low"), area(F.col("below") + F.col("n")).alias("high"))
    return found.select((F.col("i") + steps.start).cast("int").alias("k"), "low", "high")


def best_blend(validation: SiteFrame, centroids: np.ndarray, sigma: float, old: np.ndarray, new: np.ndarray) -> float:
    """The share of new weights, -1 to 1.99 in steps of 0.01, with the best area under the curve on the validation rows.

    Of equally good ones the one next to 1 is taken, below 1 if there are two. Only blends whose bounds reach the best
    lower bound are ranked exactly.
    """
    kf = features(validation, centroids, sigma)
    rows = kf.df.select(dot(kf.features, old).alias("a"), dot(kf.features, new).alias("b"), F.col(validation.target).cast("double").alias("y"))
    with kept(rows):
        bounds = blend_bounds(rows, range(-100, 200)).filter("low IS NOT NULL").collect()
        if not bounds:
            return 1.0
        least = max(r["low"] for r in bounds)
        ks = sorted(r["k"] for r in bounds if r["high"] >= least - 1e-12)
        if len(ks) > 1:
            lam = F.col("k") / F.lit(100.0)
            tried = rows.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).select("k", "y", ((F.lit(1.0) - lam) * F.col("a") + lam * F.col("b")).alias("s"))
            areas = {r["k"]: r["auc"] for r in metrics.auc(tried, "s", "y", ["k"]).collect()}
            ks = sorted(ks, key=lambda k: (-areas[k], abs(k - 100), k))
    return ks[0] / 100


def federated_svm(sf: SiteFrame, centroids: np.ndarray, sigma: float, cost: float = 1.0, eps: float = 1e-4, rounds: int = 3, epochs: int = 3, rate: float = 1.0, sequential: bool = False) -> Kernel:
    """Each site reweights and solves on its own rows from the shared weights; these then move towards the sites' mean.

    All sites' cross products of an epoch come from one job: each row is scored with its own site's weights.
    """
    kf, kcc = features(sf, centroids, sigma), own_kernel(centroids, sigma)
    y, w = sign_target(sf), np.zeros(len(centroids) + 1)
    with kept(kf.df):
        sites = sorted(r[0] for r in kf.df.select(kf.site).distinct().collect())
        for _ in range(rounds):
            for group in [[s] for s in sites] if sequential else [sites]:
                own = {s: w for s in group}
                for _ in range(epochs):
                    own = _site_solutions(kf.only(group), own, y, cost, eps, kcc)
                w = w + rate * (np.mean(list(own.values()), axis=0) - w)
    return Kernel({"": w}, centroids, sigma)


def _site_solutions(kf: SiteFrame, own: dict[int, np.ndarray], y: Column, cost: float, eps: float, kcc: np.ndarray) -> dict[int, np.ndarray]:
    spark, n = kf.df.sparkSession, len(kcc)
    table = spark.createDataFrame([(int(s), *map(float, w)) for s, w in own.items()], f"{kf.site} int, " + ", ".join(f"_w{j} double" for j in range(n)))
    df = kf.df.join(F.broadcast(table), kf.site)
    score = F.col("_w0")
    for j, k in enumerate(kf.features):
        score = score + F.col(k) * F.col(f"_w{j + 1}")
    sf = SiteFrame(df.withColumn("_y", y), kf.features, "_y", kf.site, kf.id)
    rows = stats.gram(sf, True, weight=irwls_weight(F.lit(1.0) - y * score, cost, eps)).collect()
    at = {x: i for i, x in enumerate(["1", *kf.features, "y"])}
    out = {}
    for s in own:
        m = np.zeros((n + 1, n + 1))
        for r in rows:
            if r[kf.site] == s:
                m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["value"]
        out[s] = np.linalg.solve(m[:-1, :-1] + kcc, m[:-1, -1])
    return out
