"""How well scores meet targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import cross_entropy

#: Different scores in a range that one task sorts, about, and the most ranges.
RANGE, MOST_RANGES = 1_000_000, 1024


def cut_by(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are at most the value, by halving."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value >= F.lit(cuts[mid]), among(mid + 1, high)).otherwise(among(low, mid))

    return among(0, len(cuts))


def auc(df: DataFrame, score: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by, auc): the area under the curve from ranks, ties at their mean rank.

    Rows are first summed by distinct score, so only these are sorted; if there are many, in ranges of scores, so that no
    task gets all of them.
    """
    by = by or []
    at = df.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("p"))
    ranges = at.count() // RANGE
    cuts = sorted(set(at.approxQuantile(score, [i / ranges for i in range(1, min(ranges, MOST_RANGES))], 0.2 / ranges))) if ranges > 1 else []
    cut = at.withColumn("_r", cut_by(F.col(score), cuts))
    sizes = cut.groupBy(*by, "_r").agg(F.sum("n").alias("_n"))
    so_far = F.sum("_n").over(Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    ahead = sizes.select(*(F.col(b).alias(f"_b{i}") for i, b in enumerate(by)), F.col("_r").alias("_q"), F.coalesce(so_far, F.lit(0)).alias("ahead"))
    same = F.col("_r") == F.col("_q")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_b{i}"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "_r").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(F.broadcast(ahead), same).withColumn("rank", F.col("ahead") + before + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("p") * F.col("rank")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    value = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0.0))
    return sums.select(*by, value.alias("auc"))


def accuracy(df: DataFrame, predicted: str, y: str) -> DataFrame:
    return df.agg(F.avg((F.col(predicted) == F.col(y)).cast("double")).alias("accuracy"))


def errors(df: DataFrame, score: str, y: str) -> DataFrame:
    """(mse, r2)."""
    sq = (F.col(y) - F.col(score)) ** 2
    return df.agg(F.avg(sq).alias("mse"), (1 - F.sum(sq) / F.nullif(F.count("*") * F.var_pop(y), F.lit(0.0))).alias("r2"))


def mean_cross_entropy(df: DataFrame, score: str, y: str, eps: float = 1e-6) -> DataFrame:
    return df.agg(F.avg(cross_entropy(F.col(score), F.col(y), eps)).alias("cross_entropy"))
