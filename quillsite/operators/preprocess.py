"""Row-wise preprocessing: checks, encodings, scalings and projections.

What a step must know of the data is aggregated first and enters the projection as literals, so steps fuse into one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import total, uniform
from ..sources.sites import SiteFrame
from . import stats


def data_check(df: DataFrame, kinds: dict[str, tuple], site: str = "site") -> DataFrame:
    """(site, column, kind, n_rows, n_bad) for declared columns: ('num',), ('bin',) or ('cat', values).

    Numbers must be castable, yes-or-no values 0 or 1, categories among the values; a missing value is no error.
    """
    bad = {}
    for c, (kind, *values) in kinds.items():
        text = F.col(c).cast("string")
        known = F.col(c).isNotNull() & (text != "")
        number = text.try_cast("double")
        wrong = number.isNull() if kind == "num" else ~F.coalesce(number.isin(0.0, 1.0), F.lit(False)) if kind == "bin" else ~text.isin(*values[0])
        bad[c] = F.count_if(known & wrong)
    sums = df.groupBy(site).agg(F.count("*").alias("n_rows"), *(v.alias(f"bad_{c}") for c, v in bad.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kinds[c][0]).alias("kind"), F.col(f"bad_{c}").alias("n_bad")) for c in kinds)))
    return sums.select(site, "n_rows", rows.alias("r")).select(site, "r.column", "r.kind", "n_rows", "r.n_bad")


def check_report(found: DataFrame, site: str = "site") -> DataFrame:
    """(site, report) of a data_check() table: one line for each column with errors; empty where all is well."""
    line = F.when(F.col("n_bad") > 0, F.concat_ws(" ", "column", F.lit("("), "kind", F.lit(")"), F.col("n_bad").cast("string"), F.lit("of"), F.col("n_rows").cast("string"), F.lit("wrong")))
    return found.groupBy(site).agg(F.array_join(F.sort_array(F.collect_list(line)), "; ").alias("report"))


def unknown_categories(df: DataFrame, column: str, values: list[str], site: str = "site") -> DataFrame:
    """(site, unknown): the sorted values of each site that aren't declared."""
    seen = df.filter(F.col(column).isNotNull()).groupBy(site).agg(F.collect_set(column).alias("seen"))
    return seen.select(site, F.sort_array(F.array_except("seen", F.array(*map(F.lit, values)))).alias("unknown"))


def numeric(column: Column) -> Column:
    """A number of a text; missing for the empty text; what is no number raises."""
    return F.nullif(column.cast("string"), F.lit("")).cast("double")


def one_hot(df: DataFrame, column: str, values: list[str], strict: bool = True) -> DataFrame:
    """column replaced by one 0/1 column for each value in lexicographic order; missing stays missing.

    strict: a value that isn't among values raises.
    """
    values, c = sorted(values), F.nullif(F.col(column), F.lit(""))
    known = c.isin(*values)
    if strict:
        known = F.when(c.isNull() | known, known).otherwise(F.raise_error(F.concat(F.lit(f"unknown category in {column}: "), c)).cast("boolean"))
    made = [F.when(known, (c == v).cast("double")).alias(f"{column}_{v}") for v in values]
    keep = [F.col(f"`{x}`") for x in df.columns]
    at = df.columns.index(column)
    return df.select(*keep[:at], *made, *keep[at + 1 :])


def one_hot_all(sf: SiteFrame, kinds: dict[str, tuple], strict: bool = True) -> SiteFrame:
    """Every declared category of a whole schema replaced by its columns; without one, sf as it is.

    kinds: as data_check() takes them, ("num",), ("bin",) or ("cat", values).
    """
    df, names = sf.df, list(sf.features)
    for column, (kind, *values) in kinds.items():
        if kind == "cat":
            df = one_hot(df, column, values[0], strict)
            made = [f"{column}_{v}" for v in sorted(values[0])]
            names = [y for x in names for y in (made if x == column else [x])]
    return sf.having(df, tuple(names))


def standardise(sf: SiteFrame, keep: tuple[str, ...] = ()) -> SiteFrame:
    """(x - mean) / std of all sites; features in keep (yes-or-no ones) and constant ones stay."""
    known = {r["feature"]: r for r in stats.moments(sf).collect()}
    scaled = {x: (F.col(x) - F.lit(known[x]["mean"])) / F.lit(known[x]["std"]) for x in sf.features if x not in keep and known[x]["std"]}
    return sf.having(sf.df.withColumns(scaled))


def min_max(sf: SiteFrame, keep: tuple[str, ...] = ()) -> SiteFrame:
    """(x - least) / range; only shifted where the range is 0."""
    known = {r["feature"]: r for r in stats.extremes(sf).collect()}
    scaled = {x: (F.col(x) - F.lit(known[x]["low"])) / F.lit((known[x]["high"] - known[x]["low"]) or 1.0) for x in sf.features if x not in keep and known[x]["low"] is not None}
    return sf.having(sf.df.withColumns(scaled))


def _own(sf: SiteFrame, *aggregates: tuple[str, Column]) -> DataFrame:
    """sf.df with aggregates of each row's site: a row for each site is broadcast, rows aren't shuffled."""
    facts = sf.df.groupBy(sf.site).agg(*(v.alias(n) for n, v in aggregates))
    return sf.df.join(F.broadcast(facts), sf.site)


def impute(sf: SiteFrame) -> SiteFrame:
    """Missing and NaN values become the mean of the site."""
    clean = {x: F.when(F.isnan(x), None).otherwise(F.col(x)) for x in sf.features}
    df = _own(sf.having(sf.df.withColumns(clean)), *((f"_{x}", F.avg(x)) for x in sf.features))
    return sf.having(df.withColumns({x: F.coalesce(F.col(x), F.col(f"_{x}")) for x in sf.features}).drop(*(f"_{x}" for x in sf.features)))


def clip(sf: SiteFrame, times: float = 2.0, keep: tuple[str, ...] = ()) -> SiteFrame:
    """Values beyond the site's mean ± times its standard deviation become that bound."""
    xs = [x for x in sf.features if x not in keep]
    df = _own(sf, *((f"_{k}{x}", f(x)) for x in xs for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    bound = lambda x, sign: F.col(f"_m{x}") + F.lit(sign * times) * F.col(f"_s{x}")
    clipped = {x: F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), bound(x, -1)), bound(x, 1))) for x in xs}
    return sf.having(df.withColumns(clipped).drop(*(f"_{k}{x}" for x in xs for k in "ms")))


def log_scale(sf: SiteFrame, keep: tuple[str, ...] = ()) -> SiteFrame:
    """ln(1 + x) above zero and -ln(1 - x) below."""
    return sf.having(sf.df.withColumns({x: F.signum(x) * F.log1p(F.abs(x)) for x in sf.features if x not in keep}))


def add_noise(sf: SiteFrame, share: float, seed: int = 0) -> SiteFrame:
    """Normal noise of share times the site's standard deviation, made of two numbers that depend on the row's id."""
    df = _own(sf, *((f"_{x}", F.stddev_pop(x)) for x in sf.features))
    noise = lambda k: F.sqrt(-2 * F.log(F.lit(1.0) - uniform(F.col(sf.id), seed + 2 * k))) * F.cos(F.lit(2 * np.pi) * uniform(F.col(sf.id) * 31 + 7, seed + 2 * k + 1))
    return sf.having(df.withColumns({x: F.col(x) + noise(k) * F.lit(share) * F.col(f"_{x}") for k, x in enumerate(sf.features)}).drop(*(f"_{x}" for x in sf.features)))


def add_bias(sf: SiteFrame, name: str = "x0") -> SiteFrame:
    return sf.having(sf.df.withColumn(name, F.lit(1.0)), (name, *sf.features))


def select(sf: SiteFrame, indices: list[int]) -> SiteFrame:
    """The features at the indices, in that order."""
    names = tuple(sf.features[i] for i in indices)
    return sf.having(sf.df.drop(*(x for x in sf.features if x not in names)), names)


def project(sf: SiteFrame, matrix: np.ndarray, prefix: str = "p") -> SiteFrame:
    """features · matrix, one new feature for each column."""
    made = {f"{prefix}{j + 1}": total([F.col(x) * F.lit(float(m)) for x, m in zip(sf.features, col, strict=True)]) for j, col in enumerate(matrix.T)}
    return sf.having(sf.df.withColumns(made).drop(*sf.features), tuple(made))


def random_matrix(n_in: int, n_out: int, seed: int = 0, sparse: bool = False) -> np.ndarray:
    """Entries of a projection that depend on place and seed only; about n_in ** -0.5 of them are kept if sparse.

    Normal with deviation n_out ** -0.5, by the sum of twelve uniform numbers.
    """
    u = lambda k: ((k * 1103515245 + 12345 + seed * 7919) % 2147483648) / 2147483648.0
    place = np.arange(n_in * n_out).reshape(n_in, n_out)
    m = sum(u(12 * place + k + 1) for k in range(12)) - 6.0
    return np.where(u(place * 48271 + 11) < n_in**-0.5, m, 0.0) / np.sqrt(n_out) if sparse else m / np.sqrt(n_out)


def bucket_matrix(n_in: int, n_out: int, seed: int = 0) -> np.ndarray:
    """Each input goes to exactly one output: shuffled identities on top of each other."""
    order = np.random.default_rng(seed).permutation(n_in)
    m = np.zeros((n_in, n_out))
    m[order, np.arange(n_in) % n_out] = 1.0
    return m


def pca_matrix(sf: SiteFrame, n: int) -> np.ndarray:
    """The first n eigenvectors of the second moments (not centred), the largest entry of each positive."""
    names = list(sf.features)
    r = stats.matrix(stats.gram(sf, by_site=False), ["1", *names])
    values, vectors = np.linalg.eigh(r[1:, 1:] / r[0, 0])
    vectors = vectors[:, np.argsort(-values, kind="stable")[:n]]
    return vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)])


def minibatch(sf: SiteFrame, share: float, seed: int = 0) -> SiteFrame:
    """int(share * rows) rows of each site, those with the least hashes of their ids; rows without an id come last.

    The last row that is in is sought among the few whose hash is near the share; rows aren't shuffled or sorted. Of rows
    with equal ids those with the least hash of all columns come first, so that a batch ends within them and reruns agree.
    """
    if share >= 1:
        return sf
    u, site, id = F.coalesce(uniform(F.col(sf.id), seed), F.lit(1.0)), F.col(sf.site), F.col(sf.id)
    place, tie = F.struct(u.alias("u"), id.alias("id")), F.xxhash64(*(F.col(c) for c, kind in sf.df.dtypes if "map<" not in kind))
    sizes = sf.df.groupBy(site.alias("_s")).agg(F.count("*").alias("n")).withColumn("_want", F.floor(F.col("n") * F.lit(share)))
    margin = 6 * F.sqrt(F.lit(share * (1 - share)) / F.col("n")) + 6 / F.col("n")
    band = F.broadcast(sizes.select("_s", "_want", (F.lit(share) - margin).alias("_low"), (F.lit(share) + margin).alias("_high")))
    near = sf.df.join(band, site.eqNullSafe(F.col("_s")))
    below = near.groupBy(F.col("_s").alias("_t")).agg(F.count_if(u < F.col("_low")).alias("_below"), F.count_if(u < F.col("_high")).alias("_upto"))
    # Beyond six deviations a hash would have to be bad; then the whole site is sorted.
    met = near.join(F.broadcast(below), F.col("_s").eqNullSafe(F.col("_t"))).withColumn("_fine", (F.col("_below") < F.col("_want")) & (F.col("_upto") >= F.col("_want")))
    met = met.filter(~F.col("_fine") | ((u >= F.col("_low")) & (u < F.col("_high"))))
    met = met.select("_s", "_want", F.when(F.col("_fine"), F.col("_below")).otherwise(0).alias("_before"), place.alias("_last"), tie.alias("_tie"))
    order = Window.partitionBy("_s").orderBy("_last", "_tie")
    met = met.withColumn("_k", F.row_number().over(order) + F.col("_before")).withColumn("_equal", F.row_number().over(order) - F.rank().over(order) + 1)
    last = F.broadcast(met.filter(F.col("_k") == F.col("_want")).select("_s", "_last", "_tie", "_equal"))
    kept = sf.df.join(last, site.eqNullSafe(F.col("_s")))
    at = place == F.col("_last")
    whole = kept.filter((place < F.col("_last")) | (at & (tie < F.col("_tie"))))
    # Rows that are the same in all columns: as many of them as are still wanted.
    same = kept.filter(at & (tie == F.col("_tie"))).withColumn("_k", F.row_number().over(Window.partitionBy("_s").orderBy("_s"))).filter(F.col("_k") <= F.col("_equal"))
    return sf.having(whole.select(*sf.df.columns).unionByName(same.select(*sf.df.columns)))


def cyclic_batch(sf: SiteFrame, size: int, step: int) -> SiteFrame:
    """The step-th run of size rows of each site in id order, going round. Ids are numbers, different within a site."""
    first = lambda n: F.pmod(F.lit(step * size).cast("bigint"), n)
    last = lambda n: F.pmod(first(n) + F.least(F.lit(size).cast("bigint"), n) - 1, n)
    long = sf.df.select(F.col(sf.site).alias("_s"), F.col(sf.id).alias("x"))
    ends = stats.order_statistics(long, lambda n: F.array(first(n), last(n)), ("_s",)).groupBy("_s", "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))
    n = F.col("n")
    ends = ends.select("_s", F.element_at("at", first(n)).alias("_a"), F.element_at("at", last(n)).alias("_b"), (first(n) > last(n)).alias("_round"))
    met, id = sf.df.join(F.broadcast(ends), F.col(sf.site) == F.col("_s")), F.col(sf.id)
    inside = F.when(F.col("_round"), (id >= F.col("_a")) | (id <= F.col("_b"))).otherwise((id >= F.col("_a")) & (id <= F.col("_b")))
    return sf.having(met.filter(inside).drop("_s", "_a", "_b", "_round"))


def to_long(sf: SiteFrame) -> DataFrame:
    """(site, row_id, pos, value) of the features that aren't zero: the form for sparse tables."""
    rows = sf.df.select(F.col(sf.site).alias("site"), F.col(sf.id).alias("row_id"), F.posexplode(F.array(*sf.features)).alias("pos", "value"))
    return rows.filter("value <> 0")


def project_long(long: DataFrame, matrix: np.ndarray) -> DataFrame:
    """(site, row_id, out, value): sparse rows times a matrix, whose entries other than zero are broadcast."""
    i, j = np.nonzero(matrix)
    entries = long.sparkSession.createDataFrame([(int(a), int(b), float(matrix[a, b])) for a, b in zip(i, j)], "pos int, out int, coef double")
    return long.join(F.broadcast(entries), "pos").groupBy("site", "row_id", "out").agg(F.sum(F.col("value") * F.col("coef")).alias("value"))
