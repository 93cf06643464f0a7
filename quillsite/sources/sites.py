"""Tables that are split by site: where rows come from, which columns are features, and model tables."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SiteFrame:
    """A DataFrame with one row for each pattern, a site column, feature columns and perhaps a target."""

    df: DataFrame
    features: tuple[str, ...]
    target: str | None = "y"
    site: str = "site"
    id: str = "row_id"

    def having(self, df: DataFrame, features: tuple[str, ...] | None = None) -> SiteFrame:
        return replace(self, df=df, features=self.features if features is None else features)

    def only(self, sites: list[int]) -> SiteFrame:
        """The rows of the selected sites."""
        return self.having(self.df.filter(F.col(self.site).isin(sites)))

    def halves(self, validation) -> tuple[SiteFrame, SiteFrame]:
        """Training and validation rows; validation is a condition."""
        return self.having(self.df.filter(~validation)), self.having(self.df.filter(validation))


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """df, cached meanwhile unless its owner has cached it already; the owner's cache stays."""
    level = df.storageLevel
    own = not (level.useMemory or level.useDisk)
    if own:
        df.persist()
    try:
        yield df
    finally:
        if own:
            df.unpersist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site_of(column, sites: int = 4):
    return (column % sites).cast("int")


def union_sites(frames: dict[int, DataFrame]) -> DataFrame:
    """One DataFrame of several sites' own ones, which must have the same columns."""
    out = None
    for site, df in sorted(frames.items()):
        df = df.withColumn("site", F.lit(site))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no sites")
    return out


def lineitem(spark: SparkSession, sf_dir: str) -> SiteFrame:
    """Four numeric features of comparable size, a yes-or-no target and three classes."""
    df = table(spark, sf_dir, "lineitem").select(
        site_of(F.col("l_suppkey")).alias("site"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
        (F.col("l_quantity") / 50).alias("x1"),
        (F.col("l_extendedprice") / 1e5).alias("x2"),
        (F.col("l_discount") * 10 + 0.0).alias("x3"),
        (F.col("l_tax") * 10 + 0.0).alias("x4"),
        (F.col("l_returnflag") == "R").cast("double").alias("y"),
        F.col("l_returnflag").alias("class"),
    )
    return SiteFrame(df, ("x1", "x2", "x3", "x4"))


def embeddings(spark: SparkSession, sf_dir: str, dims: int = 64) -> SiteFrame:
    """All components of the vectors as features e1, e2, …, a label of ten classes, and whether it is one of the first five."""
    df = table(spark, sf_dir, "embeddings").select(
        site_of(F.col("vec_id")).alias("site"),
        F.col("vec_id").alias("row_id"),
        *(F.col("embedding")[i].cast("double").alias(f"e{i + 1}") for i in range(dims)),
        F.col("label"),
        (F.col("label") < 5).cast("double").alias("y"),
    )
    return SiteFrame(df, tuple(f"e{i + 1}" for i in range(dims)))


def customers(spark: SparkSession, sf_dir: str) -> SiteFrame:
    """One number, one yes-or-no and one category; values are missing where the key divides by seven."""
    missing = F.col("c_custkey") % 7 == 0
    df = table(spark, sf_dir, "customer").select(
        site_of(F.col("c_nationkey")).alias("site"),
        F.col("c_custkey").alias("row_id"),
        F.when(~missing, F.col("c_acctbal")).alias("bal"),
        (F.col("c_acctbal") > 5000).cast("double").alias("rich"),
        F.when(~missing, F.col("c_mktsegment")).alias("segment"),
    )
    return SiteFrame(df, ("bal", "rich"), target=None)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, doc_id, token) of documents: runs of a-z in the lower-cased text."""
    docs = table(spark, sf_dir, "documents").select(
        site_of(F.regexp_extract("source", r"(\d+)$", 1).cast("int")).alias("site"), "doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token")
    )
    return docs.filter("token <> ''")


def save_model(spark: SparkSession, name: str, weights: dict[str, list[float]], path: str) -> None:
    """Weights by class as a table: (model, class, pos, w)."""
    rows = [(name, c, i, float(w)) for c, ws in weights.items() for i, w in enumerate(ws)]
    spark.createDataFrame(rows, "model string, class string, pos int, w double").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> dict[str, list[float]]:
    out: dict[str, list[float]] = {}
    for r in spark.read.parquet(path).orderBy("class", "pos").collect():
        out.setdefault(r["class"], []).append(r["w"])
    return out


def save_parts(spark: SparkSession, kind: str, parts: dict, path: str) -> None:
    """A model or preprocessor as a table (kind, part, value, at, x): arrays as rows of numbers, all else as JSON."""
    rows = [(kind, "kind", json.dumps(kind), None, None)]
    for part, value in parts.items():
        if isinstance(value, np.ndarray):
            rows.append((kind, part, json.dumps({"shape": value.shape}), None, None))
            rows += [(kind, part, None, i, float(x)) for i, x in enumerate(value.ravel())]
        else:
            rows.append((kind, part, json.dumps(value), None, None))
    spark.createDataFrame(rows, "kind string, part string, value string, at bigint, x double").write.mode("overwrite").parquet(path)


def load_parts(spark: SparkSession, path: str) -> tuple[str, dict]:
    """The kind and parts that save_parts() wrote."""
    heads: dict = {}
    numbers: dict[str, list[tuple[int, float]]] = {}
    for r in spark.read.parquet(path).collect():
        if r["value"] is not None:
            heads[r["part"]] = json.loads(r["value"])
        else:
            numbers.setdefault(r["part"], []).append((r["at"], r["x"]))
    kind, out = heads.pop("kind"), {}
    for part, head in heads.items():
        array = isinstance(head, dict) and set(head) == {"shape"}
        out[part] = np.array([x for _, x in sorted(numbers.get(part, []))]).reshape(head["shape"]) if array else head
    return kind, out
