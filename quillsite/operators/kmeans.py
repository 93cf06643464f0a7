"""K-means over sites: sharded start, assignment, sums by site and cluster, moving of thin clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import squared_distances
from ..sources.sites import SiteFrame, kept
from . import stats


def naive_sharding(sf: SiteFrame, k: int) -> DataFrame:
    """(site, shard, feature, value): each feature of a site sorted by itself, cut into k runs of floor(m / k) rows and
    averaged; the last run takes the rest but is divided by floor(m / k) all the same.

    Nothing is sorted whole: the runs' first values are found as order statistics, and a run's sum is that of what lies
    between them, plus its part of the rows that equal them. With fewer than k rows there is no run to speak of, and
    values are null.
    """
    size = lambda n: F.floor(n / k).cast("bigint")
    long = stats.long_form(sf)
    starts = stats.order_statistics(long, lambda n: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.least(j * size(n), n - 1)))
    cuts = starts.groupBy("site", "feature").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))
    first = lambda j: F.element_at("at", F.least(j * size(F.col("n")), F.col("n") - 1))
    met = long.join(F.broadcast(cuts.select("site", "feature", "n", *(first(F.lit(j)).alias(f"b{j}") for j in range(k)))), ["site", "feature"])
    less = lambda j: F.col("x") < F.col(f"b{j}")
    sums = [f.alias(f"{name}{j}") for j in range(k) for name, f in (("s", F.sum(F.when(less(j), F.col("x")).otherwise(0.0))), ("c", F.count_if(less(j))), ("e", F.first(f"b{j}")))]
    found = met.groupBy("site", "feature").agg(F.first("n").alias("n"), F.sum("x").alias("all"), *sums)
    # The sum of the first j runs: what is below the next one's first value, and of its equals as many as are missing.
    upto = [F.col(f"s{j}") + (j * size(F.col("n")) - F.col(f"c{j}")) * F.col(f"e{j}") for j in range(k)] + [F.col("all")]
    runs = F.array(*(F.struct(F.lit(j).alias("shard"), F.try_divide(upto[j + 1] - upto[j], size(F.col("n"))).alias("value")) for j in range(k)))
    return found.select("site", "feature", F.explode(runs).alias("r")).select("site", "r.shard", "feature", "r.value")


def sharded_start(sf: SiteFrame, k: int) -> np.ndarray:
    """The mean over sites of their sharded centroids, as k rows on the driver."""
    rows = naive_sharding(sf, k).groupBy("shard", "feature").agg(F.avg("value").alias("value")).collect()
    out = np.zeros((k, len(sf.features)))
    for r in rows:
        out[r["shard"], sf.features.index(r["feature"])] = r["value"] or 0.0
    return out


def assign(sf: SiteFrame, centroids, name: str = "cluster") -> DataFrame:
    """sf.df with the nearest centroid of each row, the first of equals, and the distance to it."""
    nearest = (F.array_position("_d", F.array_min("_d")) - 1).cast("int")
    return sf.df.withColumn("_d", squared_distances(sf.features, centroids)).withColumn(name, nearest).withColumn("distance", F.sqrt(F.array_min("_d"))).drop("_d")


def transform(sf: SiteFrame, centroids) -> DataFrame:
    """sf.df with the distances to all centroids."""
    return sf.df.withColumn("_d", squared_distances(sf.features, centroids)).withColumns({f"d{i}": F.sqrt(F.get("_d", F.lit(i))) for i in range(len(centroids))}).drop("_d")


def site_sums(sf: SiteFrame, centroids, least_rows: int = 1) -> DataFrame:
    """(site, cluster, n, distance, sums of features) of each site's clusters with at least so many rows."""
    rows = assign(sf.having(sf.df.select(F.col(sf.site).alias("site"), *sf.features)), centroids)
    return rows.groupBy("site", "cluster").agg(F.count("*").alias("n"), F.avg("distance").alias("distance"), *(F.sum(x).alias(x) for x in sf.features)).filter(F.col("n") >= least_rows)


def step(sf: SiteFrame, centroids, least_rows: int = 1) -> DataFrame:
    """(cluster, n, distance, features): the new centroids, sums over counts; a cluster without rows has none."""
    sums = site_sums(sf, centroids, least_rows)
    new = [(F.sum(x) / F.sum("n")).alias(x) for x in sf.features]
    return sums.groupBy("cluster").agg(F.sum("n").alias("n"), (F.sum(F.col("distance") * F.col("n")) / F.sum("n")).alias("distance"), *new)


def relocated(centroids: np.ndarray, counts: np.ndarray, seed: int = 0, thin: float = 0.3, fat: float = 1.5) -> np.ndarray:
    """Centroids of clusters under thin times the mean size go next to those over fat times it (or to the largest)."""
    out, rng = centroids.copy(), np.random.default_rng(seed)
    mean = counts.mean()
    large = [i for i in np.argsort(-counts, kind="stable") if counts[i] > fat * mean] or [int(np.argmax(counts))]
    for n, i in enumerate(np.flatnonzero(counts < thin * mean)):
        out[i] = out[large[n % len(large)]] + rng.normal(0, 0.01, out.shape[1])
    return out


def random_start(sf: SiteFrame, k: int, seed: int = 0, deviation: float = 0.1) -> np.ndarray:
    """k centroids of normal numbers, for features of mean 0."""
    return np.random.default_rng(seed).normal(0, deviation, (k, len(sf.features)))


def running(sums: list, features: tuple[str, ...], k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Centroids, counts and mean distance of site_sums() rows when sites are visited one by one, in order.

    Each site moves what it is handed towards its own means, by its share of the rows so far. A cluster without rows
    stays where all start, at zero.
    """
    centroids, counts, mean = np.zeros((k, len(features))), np.zeros(k), 0.0
    for site in sorted({r["site"] for r in sums}):
        before, own, distance = counts.sum(), 0, 0.0
        for r in (r for r in sums if r["site"] == site):
            c, n = r["cluster"], r["n"]
            centroids[c] += (np.array([r[x] for x in features]) / n - centroids[c]) * n / (counts[c] + n)
            counts[c] += n
            own, distance = own + n, distance + n * r["distance"]
        mean = (mean * before + distance) / (before + own)
    return centroids, counts, mean


def fit(
    sf: SiteFrame, k: int, iterations: int = 20, tolerance: float = 1e-4, least_rows: int = 1, start: np.ndarray | None = None, relocate: bool = False, aggregate=None, sequential: bool = False,
) -> tuple[np.ndarray, list[float]]:
    """Centroids, and the mean distance at each iteration; ends when that hardly changes. One job an iteration.

    aggregate: a function of the table of site_sums() that gives the table of step(), instead of sums over counts.
    sequential: sites are visited one by one, see running(); a cluster without rows then goes to zero.
    """
    centroids, seen = sharded_start(sf, k) if start is None else np.array(start, float), []
    with kept(sf.df.select(sf.site, *sf.features)) as df:
        own = sf.having(df)
        for i in range(iterations):
            if sequential:
                centroids, counts, mean = running(site_sums(own, centroids, least_rows).collect(), sf.features, k)
            else:
                rows = (aggregate(site_sums(own, centroids, least_rows)) if aggregate else step(own, centroids, least_rows)).collect()
                counts, mean = np.zeros(k), 0.0
                for r in rows:
                    centroids[r["cluster"]] = [r[x] for x in sf.features]
                    counts[r["cluster"]] = r["n"]
                    mean += r["n"] * r["distance"]
                mean /= max(counts.sum(), 1)
            done = bool(seen) and abs(seen[-1] - mean) < tolerance * max(seen[-1], 1e-300)
            seen.append(mean)
            if done:
                break
            if relocate and i + 1 < iterations:
                centroids = relocated(centroids, counts, i)
    return centroids, seen
