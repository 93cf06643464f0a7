"""Aggregates over sites: moments, extremes, counts, cross products and per-site statistics.

Each is one aggregation with partial sums per task, so only a row for each site crosses the network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.sites import SiteFrame

#: With more features than this, cross products are summed as matrices in Arrow batches rather than as generated sums.
WIDE = 30
#: Bins in which values are counted to find those of given ranks.
BINS = 4096


def terms(sf: SiteFrame, intercept: bool = True, target: bool = True) -> list[tuple[str, Column]]:
    """Names and columns of a cross-product matrix: 1, the features, y."""
    out = [("1", F.lit(1.0))] * intercept + [(x, F.col(x)) for x in sf.features]
    return out + [("y", F.col(sf.target))] * bool(target and sf.target)


def gram(sf: SiteFrame, by_site: bool = True, intercept: bool = True, weight: Column | None = None) -> DataFrame:
    """(site, a, b, value): sums of products of each pair of 1, the features and y, each pair once.

    weight: a factor of each row. Sums of all sites have no site column.
    """
    cols = terms(sf, intercept)
    keys = [sf.site] if by_site else []
    if len(cols) > WIDE:
        return _wide_gram(sf, cols, keys, weight)
    w = F.lit(1.0) if weight is None else weight
    pairs = [(a, b, x * y) for i, (a, x) in enumerate(cols) for b, y in cols[i:]]
    sums = sf.df.groupBy(*keys).agg(*(F.sum(w * v).alias(f"p{k}") for k, (_, _, v) in enumerate(pairs)))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{k}").alias("value")) for k, (a, b, _) in enumerate(pairs))))
    return sums.select(*keys, rows.alias("r")).select(*keys, "r.a", "r.b", "r.value")


def _wide_gram(sf: SiteFrame, cols, keys, weight) -> DataFrame:
    names = [n for n, _ in cols]
    df = sf.df.select(*([F.col(sf.site).cast("int").alias("site")] if keys else [F.lit(0).alias("site")]), *(c.cast("double").alias(f"c{i}") for i, (_, c) in enumerate(cols)), (F.lit(1.0) if weight is None else weight).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            site = batch.column(0).to_numpy()
            x = np.stack([batch.column(1 + i).to_numpy() for i in range(len(names))], axis=1)
            w = batch.column(1 + len(names)).to_numpy()
            for s in np.unique(site):
                k = site == s
                sums[s] = sums.get(s, 0) + (x[k] * w[k, None]).T @ x[k]
        for s, m in sums.items():
            i, j = np.triu_indices(len(names))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), s, np.int32)), pa.array([names[k] for k in i]), pa.array([names[k] for k in j]), pa.array(m[i, j])], ["site", "a", "b", "value"])

    parts = df.mapInArrow(run, "site int, a string, b string, value double")
    return parts.groupBy(*(["site"] if keys else []), "a", "b").agg(F.sum("value").alias("value"))


def matrix(products: DataFrame, names: list[str]) -> np.ndarray:
    """A gram() of all sites as a symmetric matrix on the driver; it has a row for each of names."""
    at = {n: i for i, n in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for r in products.collect():
        if r["a"] in at and r["b"] in at:
            out[at[r["a"]], at[r["b"]]] = out[at[r["b"]], at[r["a"]]] = r["value"] or 0.0
    return out


def moments(sf: SiteFrame, by_site: bool = False) -> DataFrame:
    """(site, feature, n, mean, std) over the rows where a feature is known; std of the population."""
    keys = [sf.site] if by_site else []
    sums = sf.df.groupBy(*keys).agg(*(f(x).alias(f"{k}_{x}") for x in sf.features for k, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_pop))))
    rows = F.explode(F.array(*(F.struct(F.lit(x).alias("feature"), F.col(f"n_{x}").alias("n"), F.col(f"mean_{x}").alias("mean"), F.col(f"std_{x}").alias("std")) for x in sf.features)))
    return sums.select(*keys, rows.alias("r")).select(*keys, "r.*")


def two_pass_std(sf: SiteFrame) -> DataFrame:
    """(feature, std) by a second pass over the squared distances from the global mean."""
    means = sf.df.agg(*(F.avg(x).alias(x) for x in sf.features)).first()
    sums = sf.df.agg(*(F.sqrt(F.avg((F.col(x) - F.lit(means[x])) ** 2)).alias(x) for x in sf.features))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(x).alias("feature"), F.col(x).alias("std")) for x in sf.features))).alias("r")).select("r.*")


def weighted_site_mean(sf: SiteFrame) -> DataFrame:
    """(feature, mean, variance): site means and variances around the global mean, weighted by site sizes."""
    sites = moments(sf, by_site=True)
    mean = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    means = sites.groupBy("feature").agg(mean.alias("g"))
    near = F.col("std") ** 2 + (F.col("mean") - F.col("g")) ** 2
    return sites.join(F.broadcast(means), "feature").groupBy("feature").agg(mean.alias("mean"), (F.sum(F.col("n") * near) / F.sum("n")).alias("variance"))


def extremes(sf: SiteFrame) -> DataFrame:
    """(feature, low, high)."""
    sums = sf.df.agg(*(f(x).alias(f"{k}_{x}") for x in sf.features for k, f in (("low", F.min), ("high", F.max))))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(x).alias("feature"), F.col(f"low_{x}").alias("low"), F.col(f"high_{x}").alias("high")) for x in sf.features))).alias("r")).select("r.*")


def class_counts(sf: SiteFrame, label: str) -> DataFrame:
    """(site, class, n) with the totals of sites, of classes left null."""
    return sf.df.rollup(sf.site, label).agg(F.count("*").alias("n")).withColumnRenamed(label, "class")


def class_weights(sf: SiteFrame, label: str) -> DataFrame:
    """(class, n, weight): what balances classes, rows / (classes * rows of the class)."""
    counts = sf.df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    return counts.join(F.broadcast(whole)).select("class", "n", (F.col("rows") / (F.col("classes") * F.col("n"))).alias("weight"))


def balancing(sf: SiteFrame, label: str) -> Column:
    """The weight of a row's class, as class_weights() has it."""
    out = F.lit(None).cast("double")
    for r in class_weights(sf, label).collect():
        out = F.when(F.col(label) == r["class"], F.lit(r["weight"])).otherwise(out)
    return out


def long_form(sf: SiteFrame) -> DataFrame:
    """(site, feature, x) of the values that are known."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in sf.features)))
    return sf.df.select(F.col(sf.site).alias("site"), each.alias("r")).select("site", "r.*").filter("x IS NOT NULL")


def order_statistics(long: DataFrame, ranks: Callable[[Column], Column], keys: tuple[str, ...] = ("site", "feature")) -> DataFrame:
    """(keys, n, rank, x): the values of long (keys, x) that have the given ranks, from 0, among those of equal keys.

    ranks: the ranks wanted of n values, as an array. Values are counted in BINS equal bins between the least and the
    greatest one; only those in the bins of the wanted ranks are then sorted. So no task sorts or holds all values of a
    key, and what is shuffled are counts and different values of those bins.
    """
    facts = F.broadcast(long.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))
    share = F.when(F.col("high") > F.col("low"), (F.col("x") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    binned = long.join(facts, list(keys)).withColumn("bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int"))
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    before = lambda *by: F.coalesce(F.sum("c").over(Window.partitionBy(*keys, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = lambda r: (F.col(r) >= F.col("before")) & (F.col(r) < F.col("before") + F.col("c"))
    wanted = counts.withColumn("before", before("bin")).withColumn("rank", F.explode(F.array_distinct(ranks(F.col("n"))))).filter(held("rank"))
    # A row for each bin with its ranks, so that the bins are counted once; n comes from the facts again, whose broadcast is reused.
    bins = wanted.groupBy(*keys, "bin").agg(F.collect_list(F.struct("rank", (F.col("rank") - F.col("before")).alias("own"))).alias("wants"))
    near = binned.join(F.broadcast(bins), [*keys, "bin"]).groupBy(*keys, "bin", "x").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("wants").alias("wants"))
    placed = near.withColumn("before", before("bin", "x")).select(*keys, "n", "x", "c", "before", F.explode("wants").alias("w"))
    return placed.select(*keys, "n", "x", "c", "before", "w.*").filter(held("own")).select(*keys, "n", "rank", "x")


def quantiles(sf: SiteFrame, shares: tuple[float, ...]) -> DataFrame:
    """(site, feature, share, value): exact quantiles, between two neighbours in proportion."""
    position = lambda n, q: F.lit(q) * (n - 1)
    ranks = lambda n: F.array(*(f(position(n, q)).cast("bigint") for q in shares for f in (F.floor, F.ceil)))
    found = order_statistics(long_form(sf), ranks).groupBy("site", "feature", "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))
    of = lambda q, f: F.element_at("at", f(position(F.col("n"), q)).cast("bigint"))
    value = lambda q: of(q, F.floor) + (position(F.col("n"), q) - F.floor(position(F.col("n"), q))) * (of(q, F.ceil) - of(q, F.floor))
    rows = found.select("site", "feature", F.explode(F.array(*(F.struct(F.lit(q).alias("share"), value(q).alias("value")) for q in shares))).alias("r"))
    return rows.select("site", "feature", "r.*")


def site_statistics(sf: SiteFrame, normalised: bool = False) -> DataFrame:
    """(site, stat, pos, value): rxy, meanx, medianx, stdx, skewx, kurx, perc25, perc75 by feature; npatterns; staty.

    normalised: each site's vector of a statistic is divided by its length unless that is 0.
    """
    y = F.col(sf.target)
    by_feature = {"rxy": lambda x: F.sum(x * y), "meanx": F.avg, "stdx": F.stddev_pop, "skewx": F.skewness, "kurx": F.kurtosis}
    found = [(s, i, f(F.col(x))) for s, f in by_feature.items() for i, x in enumerate(sf.features)]
    found += [("npatterns", 0, F.count("*").cast("double")), *(("staty", i, f(y)) for i, f in enumerate((F.avg, F.stddev_pop, F.skewness, F.kurtosis)))]
    sums = sf.df.groupBy(sf.site).agg(*(v.alias(f"v{k}") for k, (_, _, v) in enumerate(found)))
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.lit(i).alias("pos"), F.col(f"v{k}").alias("value")) for k, (s, i, _) in enumerate(found))))
    out = sums.select(F.col(sf.site).alias("site"), rows.alias("r")).select("site", "r.*")
    names = {0.25: "perc25", 0.5: "medianx", 0.75: "perc75"}
    stat = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("share"))
    pos = (F.array_position(F.array(*map(F.lit, sf.features)), F.col("feature")) - 1).cast("int")
    out = out.unionByName(quantiles(sf, tuple(names)).select("site", stat.alias("stat"), pos.alias("pos"), "value"))
    # A site where a feature isn't known at all has no quantiles of it.
    every = sums.select(F.col(sf.site).alias("site")).join(F.broadcast(sums.sparkSession.createDataFrame([(s, i) for s in names.values() for i in range(len(sf.features))], "stat string, pos int")))
    out = out.unionByName(every.join(F.broadcast(out.select("site", "stat", "pos")), ["site", "stat", "pos"], "left_anti").withColumn("value", F.lit(None).cast("double")))
    if not normalised:
        return out
    norm = F.sqrt(F.sum(F.col("value") ** 2).over(Window.partitionBy("site", "stat")))
    return out.withColumn("value", F.when(norm > 0, F.col("value") / norm).otherwise(F.col("value")))


def feature_counts(sf: SiteFrame) -> DataFrame:
    """(feature, n): rows where a feature is above zero; a NaN isn't."""
    sums = sf.df.agg(*(F.count_if((F.col(x) > 0) & ~F.isnan(x)).alias(x) for x in sf.features))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(x).alias("feature"), F.col(x).alias("n")) for x in sf.features))).alias("r")).select("r.*")
