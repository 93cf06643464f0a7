"""What each site's data are worth for a task: alignment, coalition utilities, Shapley values, greedy choice."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import sigmoid
from ..sources.sites import SiteFrame
from . import linear, metrics, stats

#: All coalitions are listed up to this many sites.
MOST_SITES = 12


def _bit() -> Column:
    """The bit of column site in a coalition's mask."""
    return F.expr("shiftleft(1L, site)")


def _correlations(sf: SiteFrame, by_site: bool, y: Column) -> DataFrame:
    keys = [F.col(sf.site).alias("site")] if by_site else []
    return sf.df.groupBy(*keys).agg(*(F.sum(F.col(x) * y).alias(x) for x in sf.features))


def _norm(xs, prefix: str = "") -> Column:
    return F.sqrt(sum((F.col(prefix + x) ** 2 for x in xs), F.lit(0.0)))


def task_alignment(train: SiteFrame, reference: SiteFrame) -> DataFrame:
    """(site, alignment): the cosine of each site's Xᵀy and that of the reference rows."""
    y = F.col(train.target)
    ref = _correlations(reference, False, y).select(*(F.col(x).alias(f"r_{x}") for x in train.features))
    met = _correlations(train, True, y).join(F.broadcast(ref))
    dot = sum((F.col(x) * F.col(f"r_{x}") for x in train.features), F.lit(0.0))
    return met.select("site", (dot / F.nullif(_norm(train.features) * _norm(train.features, "r_"), F.lit(0.0))).alias("alignment"))


def coalitions(spark: SparkSession, sites: int, empty: bool = False) -> DataFrame:
    """(mask, site): the members of each coalition of sites 0 to sites - 1, a bit each."""
    if sites > MOST_SITES:
        raise ValueError(f"more than {MOST_SITES} sites have too many coalitions")
    masks = spark.range(0 if empty else 1, 1 << sites).withColumnRenamed("id", "mask")
    site = F.explode(F.sequence(F.lit(0), F.lit(sites - 1))).alias("site")
    return masks.select("mask", site).filter(F.col("mask").bitwiseAND(_bit()) != 0)


def rxy_span(train: SiteFrame, reference: SiteFrame, sites: int, steps: int = 100) -> DataFrame:
    """(mask, utility) of each coalition: the greatest cosine of its summed Xᵀy and a mix of the reference's classes.

    y counts as -1 and 1; the reference has a vector for each class, and mixes go from one to the other in steps.
    """
    sign = F.col(train.target) * 2 - 1
    xs = train.features
    own = _correlations(train, True, sign)
    sums = coalitions(train.df.sparkSession, sites).join(F.broadcast(own), "site").groupBy("mask").agg(*(F.sum(x).alias(x) for x in xs))
    ref = reference.df.agg(*(F.sum(F.when(F.col(reference.target) == c, F.col(x) * (2 * c - 1))).alias(f"r{c}_{x}") for c in (0, 1) for x in xs))
    unit = ref.select(*((F.col(f"r{c}_{x}") / _norm(xs, f"r{c}_")).alias(f"r{c}_{x}") for c in (0, 1) for x in xs))
    at = unit.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k")).withColumn("a", F.col("k") / F.lit(float(steps)))
    mixes = at.select(*((F.col("a") * F.col(f"r0_{x}") + (F.lit(1.0) - F.col("a")) * F.col(f"r1_{x}")).alias(f"m_{x}") for x in xs))
    dot = sum((F.col(x) * F.col(f"m_{x}") for x in xs), F.lit(0.0))
    met = sums.join(F.broadcast(mixes))
    return met.groupBy("mask").agg(F.max(dot / (_norm(xs) * _norm(xs, "m_"))).alias("utility"))


def shapley(utilities: DataFrame, sites: int, empty: float = 0.0) -> DataFrame:
    """(site, score) of utilities (mask, utility); the empty coalition has the given utility, a NaN counts as 0."""
    spark = utilities.sparkSession
    clean = utilities.select("mask", F.coalesce(F.nanvl("utility", F.lit(0.0)), F.lit(0.0)).alias("utility"))
    known = clean.filter("mask > 0").unionByName(spark.range(1).select(F.lit(0).cast("bigint").alias("mask"), F.lit(float(empty)).alias("utility")))
    weight = F.array(*(F.lit(math.factorial(k) * math.factorial(sites - 1 - k) / math.factorial(sites)) for k in range(sites)))
    without = known.withColumn("site", F.explode(F.sequence(F.lit(0), F.lit(sites - 1)))).filter(F.col("mask").bitwiseAND(_bit()) == 0)
    met = without.withColumn("with", F.col("mask").bitwiseOR(_bit())).join(F.broadcast(known.select(F.col("mask").alias("with"), F.col("utility").alias("u1"))), "with")
    return met.groupBy("site").agg(F.sum(F.get(weight, F.bit_count("mask")) * (F.col("u1") - F.col("utility"))).alias("score"))


def shares(scores: DataFrame, shift: bool = False) -> DataFrame:
    """(site, value): scores below 0 become 0 and all are divided by their sum.

    shift: if none is above 0, all are first moved up by twice the least one, so that they can be told apart.
    """
    known = scores.agg(F.max("score").alias("high"), F.min("score").alias("low"))
    moved = F.when((F.col("high") <= 0) & F.lit(shift), F.col("score") - 2 * F.col("low")).otherwise(F.col("score"))
    met = scores.join(F.broadcast(known)).select("site", F.greatest(moved, F.lit(0.0)).alias("s"))
    return met.join(F.broadcast(met.agg(F.sum("s").alias("all")))).select("site", F.coalesce(F.col("s") / F.nullif(F.col("all"), F.lit(0.0)), F.lit(0.0)).alias("value"))


def decayed(history: DataFrame, decay: float = 0.5, newest_first: bool = False) -> DataFrame:
    """(site, value) of history (step, site, value): a sum over steps, the k-th one weighing decay ** k."""
    from pyspark.sql.window import Window

    order = F.desc("step") if newest_first else F.asc("step")
    k = F.row_number().over(Window.partitionBy("site").orderBy(order)) - 1
    return history.withColumn("w", F.pow(F.lit(decay), k)).groupBy("site").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def greedy_sites(sites: list[int], utility: Callable[[list[int]], float]) -> list[tuple[int, float]]:
    """(site, gain) in the order in which sites raise the utility of the chosen ones most; gains add up to one."""
    chosen: list[tuple[int, float]] = []
    last = 0.0
    while len(chosen) < len(sites):
        tried = [(utility([*(s for s, _ in chosen), s]), -s) for s in sites if s not in {c for c, _ in chosen}]
        best, s = max(tried)
        chosen.append((-s, max(best - last, 0.0)))
        last = max(best, last)
    whole = sum(g for _, g in chosen) or 1.0
    return [(s, g / whole) for s, g in chosen]


def site_matrices(sf: SiteFrame) -> dict[int, np.ndarray]:
    """The cross-product matrix of 1, the features and y of each site, on the driver."""
    at = {n: i for i, n in enumerate(["1", *sf.features, "y"])}
    out: dict[int, np.ndarray] = {}
    for r in stats.gram(sf).collect():
        m = out.setdefault(r[sf.site], np.zeros((len(at),) * 2))
        m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["value"]
    return out


def ridge_utility(own: dict[int, np.ndarray], validation: np.ndarray, sites: list[int], ridge: float = 1e-2) -> float:
    """1 minus the share of y² that a ridge regression of the sites' summed products leaves on the validation products."""
    g, v = sum(own[s] for s in sites), validation
    w = np.linalg.solve(g[:-1, :-1] + ridge * np.eye(len(g) - 1), g[:-1, -1])
    return float(1 - (v[-1, -1] - 2 * w @ v[:-1, -1] + w @ v[:-1, :-1] @ w) / v[-1, -1])


def coalition_errors(validation: SiteFrame, weights: dict[int, np.ndarray]) -> DataFrame:
    """(mask, error): the mean cross entropy of the logistic weights of each coalition on the validation rows, in one job.

    All coalitions, 2 ** MOST_SITES at most, are scored at once on Arrow batches; each task gives one sum for each.
    """
    masks = np.array(sorted(weights), np.int64)
    w = np.array([weights[int(m)] for m in masks], float).T
    rows = validation.df.select(*(F.col(x).cast("double") for x in validation.features), F.col(validation.target).cast("double").alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(masks)), 0
        for batch in batches:
            x = np.stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False) for c in batch.columns)], axis=1)
            for at in range(0, len(x), 256):
                part, y = x[at : at + 256, :-1], x[at : at + 256, -1:]
                o = 1 / (1 + np.exp(-part @ w)) * (1 - 2e-6) + 1e-6
                sums += (-y * np.log(o) - (1 - y) * np.log(1 - o)).sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(masks), pa.array(sums), pa.array(np.full(len(masks), n))], ["mask", "s", "n"])

    return rows.mapInArrow(run, "mask bigint, s double, n bigint").groupBy("mask").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("error"))


def coalition_value(spark: SparkSession, utility: dict[int, float], order: list[int]) -> DataFrame:
    """(site, value) of the utilities of all coalitions of the sites in order, the empty one (0) included."""
    if len(order) > MOST_SITES:
        raise ValueError(f"more than {MOST_SITES} sites have too many coalitions")
    known = spark.createDataFrame([(int(m), float(u)) for m, u in utility.items() if m], "mask bigint, utility double")
    found = shares(shapley(known, len(order), float(utility.get(0, 0.0))), shift=True)
    return found.select(F.element_at(F.array(*map(F.lit, order)), (F.col("site") + 1).cast("int")).alias("site"), "value")


def members(order: list[int]) -> dict[int, list[int]]:
    """The sites of each coalition by its mask, a bit for each place in order."""
    if len(order) > MOST_SITES:
        raise ValueError(f"more than {MOST_SITES} sites have too many coalitions")
    return {m: [s for i, s in enumerate(order) if m >> i & 1] for m in range(1 << len(order))}


def value_of_models(validation: SiteFrame, models: dict[int, np.ndarray], start: np.ndarray) -> DataFrame:
    """(site, value): what the logistic weights of each site are worth; a coalition has its members' mean weights.

    The empty coalition has the start weights; utilities are what is lost of the validation error by then.
    """
    order = sorted(models)
    weights = {m: np.mean([models[s] for s in g], axis=0) if g else start for m, g in members(order).items()}
    errors = {r["mask"]: r["error"] for r in coalition_errors(validation, weights).collect()}
    return coalition_value(validation.df.sparkSession, {m: errors[0] - e for m, e in errors.items()}, order)


def value_of_products(train: SiteFrame, validation: SiteFrame, ridge: float = 1e-2) -> DataFrame:
    """(site, value): what the cross products of each site are worth to a ridge regression; two jobs in all."""
    own = site_matrices(train)
    v, order = stats.matrix(stats.gram(validation, by_site=False), ["1", *train.features, "y"]), sorted(own)
    utility = {m: ridge_utility(own, v, g, ridge) if g else 0.0 for m, g in members(order).items()}
    return coalition_value(train.df.sparkSession, utility, order)


def greedy_auc(train: SiteFrame, validation: SiteFrame, fit: Callable[[SiteFrame], object], baseline: float = 0.0) -> list[tuple[int, float, float]]:
    """(site, area, value) in the order in which sites give the model with the greatest area under the curve.

    fit: trains on the rows of the chosen sites and gives a model that can predict(). A site's value is what the area
    rose by when it was added, as a share of all rises; the first one's rise is counted from the baseline. The area is 0
    where the validation rows are all of one class.
    """
    left = sorted(r[0] for r in train.df.select(train.site).distinct().collect())
    chosen: list[int] = []
    areas: list[float] = []
    while left:
        tried = []
        for s in left:
            model = fit(train.only([*chosen, s]))
            scored = model.predict(validation.df if isinstance(model, linear.Linear) else validation, "_score")
            tried.append((metrics.auc(scored, "_score", validation.target).first()[0] or 0.0, s))
        area, s = max(tried, key=lambda x: (x[0], -x[1]))
        chosen.append(s)
        areas.append(area)
        left.remove(s)
    rises = [max(a - b, 0.0) for a, b in zip(areas, [baseline, *areas])]
    whole = sum(rises) or 1.0
    return [(s, a, r / whole) for s, a, r in zip(chosen, areas, rises)]


def online(train: SiteFrame, validation: SiteFrame, steps: int = 3, rate: float = 0.5) -> tuple[DataFrame, linear.Linear]:
    """(step, site, value) of the steps of a logistic regression, and the model.

    At each step every coalition's weights are the old ones moved by its members' mean gradients; what they lower the
    validation error by is shared out by Shapley values.
    """
    spark = train.df.sparkSession
    w, history = np.zeros(len(train.features) + 1), None
    for step in range(steps):
        rows = linear.gradients(train, {"": w}, sigmoid).collect()
        own = {r["site"]: np.array([r[f"g_0_{j}"] for j in range(len(w))]) / r["n"] for r in rows}
        groups = members(sorted(own))
        weights = {m: w - rate * np.mean([own[s] for s in g], axis=0) if g else w for m, g in groups.items()}
        errors = {r["mask"]: r["error"] for r in coalition_errors(validation, weights).collect()}
        found = coalition_value(spark, {m: errors[0] - e for m, e in errors.items()}, sorted(own)).collect()
        part = spark.createDataFrame([(step, int(r["site"]), float(r["value"])) for r in found], "step int, site int, value double")
        history, w = part if history is None else history.unionByName(part), weights[len(groups) - 1]
    return history, linear.Linear({"": w}, train.features, "sigmoid")
