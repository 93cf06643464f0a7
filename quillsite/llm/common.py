"""Helpers that the operators of this folder share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: ASCII white space, which parts words; all other characters belong to words.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A table of keys may be broadcast up to so many rows and bytes; beyond it, see join_back and picked.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Of tables that have a row for each document or fingerprint, only this part of that: while one is gathered, built, cut
#: into blocks and sent, the driver holds several times its size.
GROWING = 8
#: A key is heavy if more than one row in so many has it, so at most this many keys are.
HEAVY = 1000
#: Repeats of one row are numbered in runs of so many.
RUN = 100_000
#: The bits of a map that tells which keys may be in a table that is too large to broadcast. It is broadcast in words of 64,
#: so many in a row (a power of two): 8 MB in all.
BITS, WORDS = 1 << 26, 512

_made: ContextVar[list | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share.

    Where that is unset, a local master gets a folder of its own; on a cluster it is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    if (made := _made.get()) is not None:
        made.append((df.sparkSession, _file(out)))
    return out


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: for whole texts, of which a checkpoint would keep every byte."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append((df.sparkSession, path))
    return df.sparkSession.read.parquet(path)


def _file(checkpoint: DataFrame) -> str:
    return checkpoint._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any store that Spark can write to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(checkpoint: DataFrame) -> None:
    """Deletes the files of a checkpoint that nothing needs any more."""
    remove(checkpoint.sparkSession, _file(checkpoint))


@contextmanager
def tidied() -> Iterator[None]:
    """Deletes at its end what checkpointed() and written() kept meanwhile; what is made of it must be stored by then."""
    made: list = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for spark, path in made:
            remove(spark, path)


def named(name: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(*columns: Column) -> tuple[Column, Column]:
    """128 bits that stand for the values of some columns; null differs from all else."""
    both = [x for c in columns for x in (c.isNull(), c)]
    return F.xxhash64(*both), F.xxhash64(F.lit("second"), *both)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once although body names it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text, as an array; none for null and for blank texts."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def lowered(text: Column) -> Column:
    """text with A-Z in lower case and all else as it was."""
    return F.translate(text, LETTERS, LETTERS.lower())


def key_of(column: Column) -> Column:
    """A string that is never null and differs for different values, null included."""
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), column.cast("string")))


def fits(df: DataFrame, part: int = 1) -> bool:
    """Whether a table may be broadcast: it is counted, and its texts are measured. It should be checkpointed.

    part: the bounds are divided by it.
    """
    texts = [F.coalesce(F.octet_length(named(f.name)), F.lit(0)) for f in df.schema if isinstance(f.dataType, (StringType, BinaryType))]
    n, chars = df.agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0))).first()
    return n * part <= BROADCAST_ROWS and (n * (32 + 24 * len(df.columns)) + chars) * part <= BROADCAST_BYTES


def bounded(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it fits."""
    return F.broadcast(df) if fits(df) else df


def join_back(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined (inner) with the one row of facts that has their key.

    count is the column of facts that tells how many rows have the key; it isn't returned. A small facts is
    broadcast. Otherwise the heavy keys, of which there are at most HEAVY by their definition, are broadcast and
    their rows stay where they are; the other rows are shuffled, and no key holds more than one in HEAVY of them.
    rows is read twice then, so it should be checkpointed.
    """
    if fits(facts, GROWING):
        return rows.join(F.broadcast(facts.drop(count)), key)
    total = facts.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.col(count) * HEAVY > total
    heavy, light = F.broadcast(facts.filter(hot).drop(count)), facts.filter(~hot).drop(count)
    return rows.join(heavy, key).unionByName(rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key))


def _bit(key: str) -> Column:
    return F.pmod(F.col(key), F.lit(BITS))


def bit_map(keys: DataFrame, key: str) -> DataFrame:
    """(block, bits): a bit for each remainder of a bigint key, WORDS words of 64 in a row; BITS / 64 words, whatever keys has."""
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(key).bitwiseAND(F.lit(63)).cast("int"))
    none = keys.sparkSession.range(-(-BITS // 64)).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = keys.select(F.shiftright(_bit(key), 6).alias("word"), mask.alias("bits")).unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    held = F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"]
    return words.groupBy(F.shiftright("word", WORDS.bit_length() - 1).alias("block")).agg(held.alias("bits"))


def may_have(rows: DataFrame, bits: DataFrame, key: str, name: str) -> DataFrame:
    """rows with a boolean column of this name: false only if no key of the map's table equals theirs."""
    block, held = fresh([*rows.columns, name], "block", "bits")
    maps, word = F.broadcast(bits.toDF(block, held)), F.shiftright(_bit(key), 6)
    met = rows.join(maps, F.shiftright(word, WORDS.bit_length() - 1) == F.col(block), "left")
    found = F.getbit(F.get(F.col(held), word.bitwiseAND(F.lit(WORDS - 1)).cast("int")), _bit(key).bitwiseAND(F.lit(63)).cast("int")) == 1
    return met.withColumn(name, F.coalesce(found, F.lit(False))).drop(block, held)


def picked(rows: DataFrame, keys: DataFrame, key: tuple[Column, Column], keep: bool) -> DataFrame:
    """The rows whose key is in keys (k1, k2: distinct, checkpointed); without keep, those whose key isn't.

    key: what row_key() gives for the rows. A small table of keys is broadcast. Of a large one a bit map is, so that only
    the rows that it may hold are shuffled, not the others with their texts; rows is read twice then.
    """
    k1, k2, may = fresh(rows.columns, "k1", "k2", "may")
    keyed, other, how = rows.withColumns({k1: key[0], k2: key[1]}), keys.select("k1", "k2").toDF(k1, k2), "left_semi" if keep else "left_anti"
    if fits(keys, GROWING):
        return keyed.join(F.broadcast(other), [k1, k2], how).drop(k1, k2)
    told = may_have(keyed, checkpointed(bit_map(keys, "k1")), k1, may)
    met = told.filter(F.col(may)).join(other, [k1, k2], how).drop(k1, k2, may)
    return met if keep else told.filter(~F.col(may)).drop(k1, k2, may).union(met)


def numbered(rows: DataFrame, count: str, name: str) -> DataFrame:
    """rows (k1, k2, …), each as often as column count says, numbered from 0. Large counts are dealt out in runs, not in one task."""
    if (rows.agg(F.max(count)).first()[0] or 0) <= RUN:
        return rows.filter(F.col(count) > 0).withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1)))
    runs = rows.filter(F.col(count) > 0).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(count) - 1) / RUN))))
    first = F.col("_run") * RUN
    dealt = runs.repartition(rows.sparkSession.sparkContext.defaultParallelism, "k1", "k2", "_run")
    return dealt.withColumn(name, F.explode(F.sequence(first, F.least(first + RUN, F.col(count)) - 1))).drop("_run")


def components(links: DataFrame) -> DataFrame:
    """The connected components of links (u, v: bigint, not null): (node, root), root being the least node.

    Alternates large-star and small-star, both joins and minima over edges, until nothing changes; nothing is
    collected, and each round is checkpointed and the one before deleted, so the lineage stays short. Minima are combined
    before they are shuffled; the joins are plain sort-merge joins, in which adaptive execution splits the edges of a hub.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = checkpointed(edges), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        old, edges = edges, checkpointed(small)
        forget(old)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
