"""Quality rules by host: what a document fails, and what its host's documents fail.

Every document is measured by itself. Failures are then counted per host, a host's failure rate is shrunk towards the
mean of all hosts by a beta prior that is fitted to the rates, and the host's verdict goes back to its documents:
documents of a rejected host go, and a document that fails a rule stays only if its host is trusted.

Only DataFrame functions run here. The windows of one text never leave its row, so nothing but the measures is shuffled.

Cases: a null or blank text has no words and fails. A null host is a host of its own. Equal rows are judged alike; ids
play no part, and may be null or equal. A text of any length is measured whole, in its row. An empty table gives an empty
result. Other columns of the input are ignored by judge() and carried along by keep_good(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, SPACES, checkpointed, join_back, key_of, let, named, words_of, written

SYMBOLS = "#*$%&|<>"
#: A host whose shrunk failure rate is above the first is rejected; below the second, it is trusted.
REJECT_RATE, TRUST_RATE = 0.5, 0.02


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more.

    Windows are told apart by a 64-bit hash of the three words, compared within one text only.
    """
    def marked(s: Column) -> Column:
        here = lambda x, j: (F.get(s, j - 1)["k"] == x["k"]) | (F.get(s, j + 1)["k"] == x["k"])
        return F.transform(F.filter(s, lambda x, j: F.coalesce(here(x, j), F.lit(False))), lambda x: x["i"])

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, j: F.coalesce(F.least(F.get(p, j + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x
        )

    def of(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        pairs = lambda k: F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(let(pairs(k), lambda s: let(F.sort_array(marked(s)), covered))))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(words, of)).cast("bigint")


def measures(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", carry: bool = False) -> DataFrame:
    """Of every row: doc_id, host, n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines, n_repeat_words,
    base_failed, failed (some rule), and with carry the whole row as a struct."""
    t = F.coalesce(named(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    less = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("bigint")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rules = (20 * F.col("n_symbols") > F.col("word_chars")) | (2 * F.col("n_dup_lines") > F.col("n_lines")) | (2 * F.col("n_upper") > F.col("word_chars"))
    row = [F.struct(*map(named, docs.columns)).alias("row")] * carry
    n_chars = lambda c: F.length(c).cast("bigint")
    parts = docs.select(
        *row, named(id).alias("doc_id"), key_of(named(host)).alias("host"), words_of(t).alias("w"), lines.alias("l"),
        n_chars(F.translate(t, SPACES, "")).alias("word_chars"), less(SYMBOLS).alias("n_symbols"), less(LETTERS).alias("n_upper"),
    )
    size = lambda c: F.size(c).cast("bigint")
    counts = parts.select(
        *["row"] * carry, "doc_id", "host", size("w").alias("n_words"), "word_chars", "n_symbols", "n_upper",
        size("l").alias("n_lines"), (size("l") - size(F.array_distinct("l"))).alias("n_dup_lines"), repeated_words(F.col("w")).alias("n_repeat_words"),
    )
    return counts.withColumn("base_failed", base).withColumn("failed", base | rules)


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, n_docs, rate): the failure rate of each host, shrunk by the beta prior that fits all hosts' rates best.

    The prior's mean is the overall rate; its weight comes from how far the rates spread beyond chance (moments).
    """
    hosts = checkpointed(judged.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("bigint")).alias("n_failed")))
    n, f, k, sq = hosts.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_failed"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")), F.lit(0.0))).first()
    mean = f / n if n else 0.0
    chance = mean * (1 - mean)
    spread = max((sq / n - mean * mean if n else 0.0) - chance * k / max(n, 1), 1e-6)
    weight = min(max(chance / spread - 1, 1.0), 1000.0)
    return hosts.select("host", "n_docs", ((F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)).alias("rate"))


def verdict(reject_rate: float, trust_rate: float) -> Column:
    """Whether a document is kept. It is one case rather than several conditions: these would be pushed below the join
    with the hosts one by one, and each would measure the text again."""
    fine = ~F.col("base_failed") & (~F.col("failed") | (F.col("host_rate") < trust_rate))
    return F.when(F.col("host_rate") <= reject_rate, fine).otherwise(F.lit(False))


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", reject_rate: float = REJECT_RATE, trust_rate: float = TRUST_RATE) -> DataFrame:
    """The measures of every document, with base_failed, failed (some rule), host_rate and kept."""
    seen = checkpointed(measures(docs, id, text, host))
    out = join_back(seen, host_rates(seen), "host", "n_docs").withColumnRenamed("rate", "host_rate")
    return out.withColumn("kept", verdict(reject_rate, trust_rate))


def keep_good(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", reject_rate: float = REJECT_RATE, trust_rate: float = TRUST_RATE) -> DataFrame:
    """The rows of docs that judge() keeps, whole. Texts are measured once: the rows that pass the base rules are written
    with their verdict, the others without their texts, and read again once the hosts are known."""
    seen = measures(docs, id, text, host, carry=True)
    seen = written(seen.select("host", "base_failed", "failed", F.when(~F.col("base_failed"), F.col("row")).alias("row")))
    out = join_back(seen, host_rates(seen), "host", "n_docs").withColumnRenamed("rate", "host_rate")
    return out.filter(verdict(reject_rate, trust_rate)).select("row.*")
