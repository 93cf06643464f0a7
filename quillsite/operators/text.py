"""Vocabulary, document frequency and TF-IDF over token tables (site, doc_id, token)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sites import SiteFrame
from . import stats


def term_counts(tokens: DataFrame) -> DataFrame:
    """(site, doc_id, token, n): the bag of words of each document in long form. A table that is one already stays as it is.

    The functions below take either; given the same bag, they share its one aggregation.
    """
    return tokens if "n" in tokens.columns else tokens.groupBy("site", "doc_id", "token").agg(F.count("*").alias("n"))


def vocabulary(tokens: DataFrame, more_than: int = 10, less_than: int = 5000) -> DataFrame:
    """(token, tf) of the tokens with a total strictly between the bounds."""
    return term_counts(tokens).groupBy("token").agg(F.sum("n").alias("tf")).filter((F.col("tf") > more_than) & (F.col("tf") < less_than))


def document_frequency(tokens: DataFrame, vocab: DataFrame, more_than: int = 10) -> DataFrame:
    """(token, df) of vocabulary tokens that are in more documents than the bound. A document has one site."""
    counts = term_counts(tokens).groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") > more_than)
    return counts.join(vocab.select("token"), "token", "left_semi")


def tf_idf(tokens: DataFrame, df: DataFrame) -> DataFrame:
    """(doc_id, token, value): count in the document by document frequency, without logarithm."""
    return term_counts(tokens).join(df, "token").select("doc_id", "token", (F.col("n") / F.col("df")).alias("value"))


def tf_idf_dense(tokens: DataFrame, df: DataFrame) -> DataFrame:
    """(doc_id, vector): the values over the sorted vocabulary; the vocabulary must be small enough for one row."""
    rows = tf_idf(tokens, df).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("m"))
    words = df.agg(F.sort_array(F.collect_set("token")).alias("words"))
    return rows.join(F.broadcast(words)).select("doc_id", F.transform("words", lambda w: F.coalesce(F.col("m")[w], F.lit(0.0))).alias("vector"))


def top_features(sf: SiteFrame, n: int, most: float = 1.0) -> DataFrame:
    """(pos, feature, freq) of the n features that are most often above zero; those above `most` count as 0."""
    rows = sf.df.count()
    freq = F.col("n") / F.lit(float(max(rows, 1)))
    pos = F.array_position(F.array(*map(F.lit, sf.features)), F.col("feature")) - 1
    found = stats.feature_counts(sf).select(pos.cast("int").alias("pos"), "feature", F.when(freq > most, 0.0).otherwise(freq).alias("freq"))
    return found.orderBy(F.desc("freq"), "pos").limit(n)
