"""Record linkage: rows of several sites that hold different columns of the same entities, met by hashed ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import hashed_id


def hash_ids(frames: dict[int, DataFrame], id: str) -> DataFrame:
    """(site, h): the hashed ids of each site, each once."""
    parts = [df.select(F.lit(s).alias("site"), hashed_id(F.col(id)).alias("h")).distinct() for s, df in sorted(frames.items())]
    return reduce(DataFrame.unionByName, parts)


def link(hashes: DataFrame, sites: int, how: str = "full") -> DataFrame:
    """(h): the ids that are at every site ('full'), or at any ('join')."""
    if how == "join":
        return hashes.select("h").distinct()
    if how != "full":
        raise ValueError(how)
    return hashes.distinct().groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") == sites).select("h")


def align(ids: DataFrame, df: DataFrame, id: str, order: str, missing: str | None = None) -> DataFrame:
    """(h, columns of df without its id) for each of ids: the first row by `order`; nulls, or `missing`, where none is."""
    columns = [c for c in df.columns if c not in (id, order)]
    first = df.select(hashed_id(F.col(id)).alias("h"), F.struct(*columns).alias("row"), F.col(order).alias("_order")).groupBy("h").agg(F.min_by("row", "_order").alias("row"))
    out = ids.select("h").join(first, "h", "left").select("h", *(F.col(f"row.{c}").alias(c) for c in columns))
    return out if missing is None else out.select("h", *(F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in columns))


def vertical_concat(ids: DataFrame, frames: dict[int, tuple[DataFrame, str, str]]) -> DataFrame:
    """(h, all sites' columns in site order), prefixed by s and the site; frames: site -> (rows, id, order)."""
    out = ids.select("h")
    for s, (df, id, order) in sorted(frames.items()):
        part = align(ids, df, id, order)
        out = out.join(part.select("h", *(F.col(c).alias(f"s{s}_{c}") for c in part.columns[1:])), "h")
    return out
