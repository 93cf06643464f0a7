"""The query catalogue: name -> (spark, sf_dir) -> DataFrame, and the SQL that must agree.

Sums of floating-point numbers depend on the order of rows, so values are rounded on both sides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..operators import images, kernels, kmeans, linear, linkage, metrics, networks, preprocess, ranking, stats, text, value
from ..sources import sites

QUERIES: dict = {}
SQL: dict[str, str] = {}

LI = """f AS (SELECT CAST(l_suppkey % 4 AS INT) AS site, l_orderkey * 8 + l_linenumber AS row_id, l_quantity / 50 AS x1, l_extendedprice / 1e5 AS x2, l_discount * 10 + 0.0 AS x3, l_tax * 10 + 0.0 AS x4,
 CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END AS y, l_returnflag AS class FROM lineitem)"""
XS = ("x1", "x2", "x3", "x4")
CU = """f AS (SELECT CAST(c_nationkey % 4 AS INT) AS site, c_custkey AS row_id, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS bal, CASE WHEN c_acctbal > 5000 THEN 1e0 ELSE 0e0 END AS rich,
 CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment FROM customer)"""
TOK = r"""t AS (SELECT * FROM (SELECT CAST(CAST(regexp_extract(source, '(\d+)$', 1) AS INT) % 4 AS INT) AS site, doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS token FROM documents) WHERE token <> '')"""
VOCAB = "v AS (SELECT token, count(*) AS tf FROM t GROUP BY token HAVING count(*) > 10 AND count(*) < 5000)"
DF = "d AS (SELECT token, count(DISTINCT doc_id) AS df FROM t WHERE token IN (SELECT token FROM v) GROUP BY token HAVING count(DISTINCT doc_id) > 10)"
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def em(dims: int = 64) -> str:
    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i + 1}" for i in range(dims))
    return f"f AS (SELECT CAST(vec_id % 4 AS INT) AS site, vec_id AS row_id, {cols}, label, CASE WHEN label < 5 THEN 1e0 ELSE 0e0 END AS y FROM embeddings)"


def es(dims: int = 64) -> tuple[str, ...]:
    return tuple(f"e{i + 1}" for i in range(dims))


def r(x: str, k: int = 6) -> str:
    return f"round({x}, {k}) + 0e0"


def rounded(df: DataFrame, *columns: str, k: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, k) + F.lit(0.0) for c in columns})


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table_of(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small result of the driver as a DataFrame."""
    return spark.createDataFrame(rows, schema)


def union(parts) -> str:
    return " UNION ALL ".join(parts)


# Cross products and moments.


def _gram_sql(names, by_site=True, weight="1e0", k=4, frm="f"):
    names = ["1", *names, "y"]
    sql = {"1": "1e0"}
    key, group = ("site, ", " GROUP BY site") if by_site else ("", "")
    return union(f"SELECT {key}'{a}' AS a, '{b}' AS b, {r(f'sum({weight} * {sql.get(a, a)} * {sql.get(b, b)})', k)} AS value FROM {frm}{group}" for i, a in enumerate(names) for b in names[i:])


@query(f"WITH {LI} {_gram_sql(XS)}")
def gram_per_site(spark, d):
    return rounded(stats.gram(sites.lineitem(spark, d)), "value", k=4)


@query(f"WITH {LI} {_gram_sql(XS, False)}")
def gram_global(spark, d):
    return rounded(stats.gram(sites.lineitem(spark, d), by_site=False), "value", k=4)


def _long_gram_sql(by_site=True, k=4):
    """As _gram_sql, by a join of the values of a row in long form."""
    names, key = ["1", *es(), "y"], "site, " if by_site else ""
    values = ", ".join(["1e0", *es(), "y"])
    listed = ", ".join(f"'{n}'" for n in names)
    return f"""WITH {em()}, l AS (SELECT site, row_id, unnest(range(1, {len(names) + 1})) AS i, unnest([{values}]) AS v FROM f), g AS (SELECT {'a.site, ' if by_site else ''}a.i AS i, b.i AS j, sum(a.v * b.v) AS value
 FROM l AS a JOIN l AS b ON a.row_id = b.row_id AND a.i <= b.i GROUP BY {'a.site, ' if by_site else ''}a.i, b.i) SELECT {key}[{listed}][i] AS a, [{listed}][j] AS b, {r('value', k)} AS value FROM g"""


@query(_long_gram_sql())
def gram_wide(spark, d):
    return rounded(stats.gram(sites.embeddings(spark, d)), "value", k=4)


@query(f"WITH {LI} " + union(f"SELECT site, '{x}' AS feature, {r(f'sum({x} * y)', 4)} AS value FROM f GROUP BY site" for x in XS))
def cross_corr(spark, d):
    g = stats.gram(sites.lineitem(spark, d)).filter("b = 'y' AND a NOT IN ('1', 'y')")
    return rounded(g.select("site", F.col("a").alias("feature"), "value"), "value", k=4)


def _moments_sql(key=""):
    return union(f"SELECT {key}'{x}' AS feature, count({x}) AS n, {r(f'avg({x})')} AS mean, {r(f'stddev_pop({x})')} AS std FROM f" + (" GROUP BY site" if key else "") for x in XS)


@query(f"WITH {LI} {_moments_sql('site, ')}")
def site_moments(spark, d):
    return rounded(stats.moments(sites.lineitem(spark, d), by_site=True), "mean", "std")


@query(f"WITH {LI} {_moments_sql()}")
def global_mean_std(spark, d):
    return rounded(stats.moments(sites.lineitem(spark, d)), "mean", "std")


@query(f"WITH {LI} " + union(f"SELECT '{x}' AS feature, {r(f'sqrt(avg(({x} - m) * ({x} - m)))')} AS std FROM f, (SELECT avg({x}) AS m FROM f)" for x in XS))
def two_pass_variance(spark, d):
    return rounded(stats.two_pass_std(sites.lineitem(spark, d)), "std")


@query(f"WITH {LI} " + union(f"SELECT '{x}' AS feature, {r(f'avg({x})')} AS mean, {r(f'var_pop({x})')} AS variance FROM f" for x in XS))
def weighted_site_mean(spark, d):
    return rounded(stats.weighted_site_mean(sites.lineitem(spark, d)), "mean", "variance")


@query(f"WITH {LI} " + union(f"SELECT '{x}' AS feature, min({x}) AS low, max({x}) AS high FROM f" for x in XS))
def global_min_max(spark, d):
    return stats.extremes(sites.lineitem(spark, d))


@query(f"WITH {LI} SELECT site, row_id, {', '.join(f'{r(f'({x} - (SELECT avg({x}) FROM f)) / (SELECT stddev_pop({x}) FROM f)', 5)} AS {x}' for x in XS)} FROM f")
def standardise(spark, d):
    return rounded(preprocess.standardise(sites.lineitem(spark, d)).df, *XS, k=5).select("site", "row_id", *XS)


@query(f"WITH {LI} SELECT site, row_id, {', '.join(f'{r(f'({x} - (SELECT min({x}) FROM f)) / (SELECT max({x}) - min({x}) FROM f)', 5)} AS {x}' for x in XS)} FROM f")
def minmax_scale(spark, d):
    return rounded(preprocess.min_max(sites.lineitem(spark, d)).df, *XS, k=5).select("site", "row_id", *XS)


def _stats_sql():
    m = lambda x, p: f"(avg(({x}) ** {p}))"

    def central(x):
        m1, m2, m3, m4 = (m(x, p) for p in (1, 2, 3, 4))
        var = f"({m2} - {m1} ** 2)"
        return f"({m3} - 3 * {m1} * {m2} + 2 * {m1} ** 3) / {var} ** 1.5", f"({m4} - 4 * {m1} * {m3} + 6 * {m1} ** 2 * {m2} - 3 * {m1} ** 4) / {var} ** 2 - 3"

    out = []
    for i, x in enumerate(XS):
        skew, kur = central(x)
        for s, e in (("rxy", f"sum({x} * y)"), ("meanx", f"avg({x})"), ("medianx", f"quantile_cont({x}, 0.5)"), ("stdx", f"stddev_pop({x})"), ("skewx", skew), ("kurx", kur), ("perc25", f"quantile_cont({x}, 0.25)"), ("perc75", f"quantile_cont({x}, 0.75)")):
            out.append(f"SELECT site, '{s}' AS stat, {i} AS pos, CAST({e} AS DOUBLE) AS value FROM f GROUP BY site")
    out.append("SELECT site, 'npatterns', 0, CAST(count(*) AS DOUBLE) FROM f GROUP BY site")
    skew, kur = central("y")
    out += [f"SELECT site, 'staty', {i}, {e} FROM f GROUP BY site" for i, e in enumerate(("avg(y)", "stddev_pop(y)", skew, kur))]
    return union(out)


@query(f"WITH {LI}, s AS ({_stats_sql()}) SELECT site, stat, pos, {r('value', 4)} AS value FROM s")
def site_stats_long(spark, d):
    return rounded(stats.site_statistics(sites.lineitem(spark, d)), "value", k=4)


@query(f"WITH {LI}, s AS ({_stats_sql()}) SELECT site, stat, pos, {r('value / sqrt(sum(value * value) OVER (PARTITION BY site, stat))', 4)} AS value FROM s")
def site_stats_normalised(spark, d):
    return rounded(stats.site_statistics(sites.lineitem(spark, d), normalised=True), "value", k=4)


@query(f"WITH {LI} SELECT coalesce(site, -1) AS site, coalesce(class, 'all') AS class, count(*) AS n FROM f GROUP BY ROLLUP (site, class)")
def class_counts_rollup(spark, d):
    return stats.class_counts(sites.lineitem(spark, d), "class").select(F.coalesce("site", F.lit(-1)).alias("site"), F.coalesce("class", F.lit("all")).alias("class"), "n")


# Preprocessing.


@query(f"""WITH c AS (SELECT CAST(c_nationkey % 4 AS INT) AS site, CAST(c_acctbal AS VARCHAR) AS bal, CASE WHEN c_custkey % 97 = 0 THEN 'BAD' ELSE c_mktsegment END AS segment,
 CASE WHEN c_custkey % 89 = 0 THEN 2e0 WHEN c_acctbal > 5000 THEN 1e0 ELSE 0e0 END AS rich, CASE WHEN c_custkey % 101 = 0 THEN 'x1' ELSE CAST(c_custkey AS VARCHAR) END AS code FROM customer)
 SELECT site, 'bal' AS "column", 'num' AS kind, count(*) AS n_rows, CAST(count_if(try_cast(bal AS DOUBLE) IS NULL) AS BIGINT) AS n_bad FROM c GROUP BY site
 UNION ALL SELECT site, 'code', 'num', count(*), CAST(count_if(try_cast(code AS DOUBLE) IS NULL) AS BIGINT) FROM c GROUP BY site
 UNION ALL SELECT site, 'rich', 'bin', count(*), CAST(count_if(rich NOT IN (0, 1)) AS BIGINT) FROM c GROUP BY site
 UNION ALL SELECT site, 'segment', 'cat', count(*), CAST(count_if(segment NOT IN ({', '.join(f"'{s}'" for s in SEGMENTS)})) AS BIGINT) FROM c GROUP BY site""")
def data_check(spark, d):
    key, seg = F.col("c_custkey"), F.col("c_mktsegment")
    df = sites.table(spark, d, "customer").select(
        sites.site_of(F.col("c_nationkey")).alias("site"), F.col("c_acctbal").cast("string").alias("bal"), F.when(key % 97 == 0, "BAD").otherwise(seg).alias("segment"),
        F.when(key % 89 == 0, 2.0).when(F.col("c_acctbal") > 5000, 1.0).otherwise(0.0).alias("rich"), F.when(key % 101 == 0, "x1").otherwise(key.cast("string")).alias("code"),
    )
    return preprocess.data_check(df, {"bal": ("num",), "code": ("num",), "rich": ("bin",), "segment": ("cat", SEGMENTS)})


@query(SQL["data_check"].join(["WITH z AS (", ") SELECT site, coalesce(string_agg(CASE WHEN n_bad > 0 THEN concat_ws(' ', \"column\", '(', kind, ')', n_bad, 'of', n_rows, 'wrong') END, '; ' ORDER BY \"column\"), '') AS report FROM z GROUP BY site"]))
def data_check_report(spark, d):
    return preprocess.check_report(data_check(spark, d))


@query(f"SELECT CAST(c_nationkey % 4 AS INT) AS site, coalesce(string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FILTER (c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING')), '') AS unknown FROM customer GROUP BY 1")
def unknown_categories(spark, d):
    df = sites.table(spark, d, "customer").withColumn("site", sites.site_of(F.col("c_nationkey")))
    return preprocess.unknown_categories(df, "c_mktsegment", SEGMENTS[:2]).select("site", F.array_join("unknown", ",").alias("unknown"))


@query(f"WITH {LI} SELECT class, count(*) AS n, {r('(SELECT count(*) FROM f) / ((SELECT count(DISTINCT class) FROM f) * count(*))')} AS weight FROM f GROUP BY class")
def class_weights(spark, d):
    return rounded(stats.class_weights(sites.lineitem(spark, d), "class"), "weight")


def _one_hot_sql(c, values):
    return ", ".join(f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} = '{v}' THEN 1e0 ELSE 0e0 END AS \"{c}_{v}\"" for v in values)


@query(f"SELECT o_orderkey, {_one_hot_sql('o_orderstatus', 'FOP')} FROM orders")
def one_hot(spark, d):
    return preprocess.one_hot(sites.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["P", "O", "F"])


@query(f"WITH {CU} SELECT site, row_id, {_one_hot_sql('segment', SEGMENTS)} FROM f")
def one_hot_missing(spark, d):
    return preprocess.one_hot(sites.customers(spark, d).df.select("site", "row_id", "segment"), "segment", SEGMENTS)


@query(f"WITH {CU} SELECT site, row_id, {r('coalesce(bal, avg(bal) OVER (PARTITION BY site))', 4)} AS bal FROM f")
def impute_mean(spark, d):
    return rounded(preprocess.impute(sites.customers(spark, d)).df, "bal", k=4).select("site", "row_id", "bal")


EV = "f AS (SELECT CAST(user_id % 4 AS INT) AS site, event_id AS row_id, value AS x FROM events)"


def _events(spark, d):
    df = sites.table(spark, d, "events").select(sites.site_of(F.col("user_id")).alias("site"), F.col("event_id").alias("row_id"), F.col("value").alias("x"))
    return sites.SiteFrame(df, ("x",), None)


@query(f"WITH {EV}, m AS (SELECT site, avg(x) AS m, stddev_pop(x) AS s FROM f GROUP BY site) SELECT f.site, row_id, {r('least(greatest(x, m - 2 * s), m + 2 * s)', 5)} AS x FROM f JOIN m ON m.site = f.site")
def clip_outliers(spark, d):
    return rounded(preprocess.clip(_events(spark, d)).df, "x", k=5).select("site", "row_id", "x")


@query(f"WITH {CU} SELECT site, row_id, {r('sign(bal) * ln(1 + abs(bal))')} AS bal FROM f")
def log_scale(spark, d):
    return rounded(preprocess.log_scale(sites.customers(spark, d), keep=("rich",)).df, "bal").select("site", "row_id", "bal")


@query(f"""WITH {EV}, s AS (SELECT site, stddev_pop(x) AS s FROM f GROUP BY site), u AS (SELECT f.*, s, ((row_id * 1103515245 + 12345) % 2147483648) / 2147483648e0 AS u1, (((row_id * 31 + 7) * 1103515245 + 12345 + 7919) % 2147483648) / 2147483648e0 AS u2 FROM f JOIN s ON s.site = f.site)
 SELECT site, row_id, {r('x + sqrt(-2 * ln(1 - u1)) * cos(6.283185307179586e0 * u2) * 0.1e0 * s', 5)} AS x FROM u""")
def noise_seeded(spark, d):
    return rounded(preprocess.add_noise(_events(spark, d), 0.1).df, "x", k=5).select("site", "row_id", "x")


@query(f"WITH {LI} SELECT site, row_id, 1e0 AS x0, x1 FROM f")
def add_bias(spark, d):
    return preprocess.add_bias(sites.lineitem(spark, d)).df.select("site", "row_id", "x0", "x1")


@query(f"WITH {LI} SELECT site, row_id, x3, x1 FROM f")
def feature_select(spark, d):
    sf = preprocess.select(sites.lineitem(spark, d), [2, 0])
    return sf.df.select("site", "row_id", *sf.features)


def _proj_sql(m, k=6):
    cols = [f"{r(' + '.join(f'e{i + 1} * {float(v)!r}e0' if 'e' not in repr(float(v)) else f'e{i + 1} * {float(v)!r}' for i, v in enumerate(c)), k)} AS p{j + 1}" for j, c in enumerate(m.T)]
    return f"WITH {em()} SELECT row_id, {', '.join(cols)} FROM f"


def _projected(spark, d, m):
    sf = preprocess.project(sites.embeddings(spark, d), m)
    return rounded(sf.df, *sf.features).select("row_id", *sf.features)


_FULL, _SPARSE, _BUCKET = preprocess.random_matrix(64, 3, 1), preprocess.random_matrix(64, 3, 2, sparse=True), preprocess.bucket_matrix(64, 3)


@query(_proj_sql(_FULL))
def proj_full_seeded(spark, d):
    return _projected(spark, d, _FULL)


@query(_proj_sql(_SPARSE))
def proj_sparse_seeded(spark, d):
    return _projected(spark, d, _SPARSE)


@query(_proj_sql(_BUCKET))
def proj_bucket(spark, d):
    return _projected(spark, d, _BUCKET)


@query(f"WITH {em()}, l AS ({union(f"SELECT site, row_id, {i} AS pos, {x} AS value FROM f WHERE abs({x}) > 0.2e0" for i, x in enumerate(es()))}), m AS ({union(f"SELECT {a} AS pos, {b} AS o" for a, b in zip(*np.nonzero(_BUCKET)))}) SELECT site, row_id, o AS out, {r('sum(value)')} AS value FROM l JOIN m ON m.pos = l.pos GROUP BY site, row_id, o")
def proj_sparse_long(spark, d):
    """Sparse rows (values beyond 0.2) added up into buckets."""
    long = preprocess.to_long(sites.embeddings(spark, d)).filter("abs(value) > 0.2")
    return rounded(preprocess.project_long(long, _BUCKET), "value")


@query(_long_gram_sql(False))
def pca_gram(spark, d):
    return rounded(stats.gram(sites.embeddings(spark, d), by_site=False), "value", k=4)


@query()
def pca_transform(spark, d):
    sf = sites.embeddings(spark, d)
    out = preprocess.project(sf, preprocess.pca_matrix(sf, 3))
    return rounded(out.df, *out.features).select("row_id", *out.features)


@query(f"WITH {LI}, k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ((row_id * 1103515245 + 12345) % 2147483648), row_id) AS n, count(*) OVER (PARTITION BY site) AS c FROM f) SELECT site, row_id, {r('x1')} AS x1 FROM k WHERE n <= floor(c * 0.1e0)")
def minibatch_seeded(spark, d):
    return rounded(preprocess.minibatch(sites.lineitem(spark, d), 0.1).df, "x1").select("site", "row_id", "x1")


@query(f"WITH {em()}, k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY row_id) - 1 AS n, count(*) OVER (PARTITION BY site) AS c FROM f) SELECT site, row_id FROM k WHERE (n - 3 * 50 + 10 * c) % c < 50")
def cyclic_batch(spark, d):
    return preprocess.cyclic_batch(sites.embeddings(spark, d), 50, 3).df.select("site", "row_id")


@query(f"WITH {em()} SELECT class, count(*) AS n, {r('sum(e1)')} AS e1 FROM (SELECT *, CASE WHEN y = 1 THEN 'one' ELSE 'zero' END AS class FROM f) GROUP BY class")
def class_subsets(spark, d):
    df = sites.embeddings(spark, d).df
    one, zero = (df.filter(F.col("y") == v).agg(F.lit(n).alias("class"), F.count("*").alias("n"), F.sum("e1").alias("e1")) for v, n in ((1.0, "one"), (0.0, "zero")))
    return rounded(one.unionByName(zero), "e1")


@query(f"SELECT vec_id AS row_id, {', '.join(f'CAST(embedding[{((2 * i + 1) * 8 // 8) * 8 + (2 * j + 1) + 1}] AS DOUBLE) AS p{i * 4 + j}' for i in range(4) for j in range(4))} FROM embeddings")
def image_resize(spark, d):
    """The 64 numbers of a vector as an 8 by 8 image, resized to 4 by 4 and flattened."""
    flat = F.transform("embedding", lambda x: x.cast("double"))
    small = images.to_vector(images.resize(images.as_matrix(flat, 8, 8), 8, 8, 4, 4))
    return sites.table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), small.alias("v")).select("row_id", *(F.col("v")[k].alias(f"p{k}") for k in range(16)))


def _halved(j):
    """Half as many pixels: weights 1/8, 3/8, 3/8, 1/8 of the four around each; at the ends of the three there are."""
    around = [(k, w) for k, w in zip(range(2 * j - 1, 2 * j + 3), (1, 3, 3, 1)) if 0 <= k < 8]
    return [(k, w / sum(x for _, x in around)) for k, w in around]


@query("SELECT vec_id AS row_id, " + ", ".join(r(" + ".join(f"CAST(embedding[{8 * a + b + 1}] AS DOUBLE) * {u * v!r}" for a, u in _halved(i) for b, v in _halved(j))) + f" AS p{i * 4 + j}" for i in range(4) for j in range(4)) + " FROM embeddings")
def image_bilinear(spark, d):
    """As image_resize, each pixel a mean of those around it."""
    flat = F.transform("embedding", lambda x: x.cast("double"))
    small = images.to_vector(images.bilinear(images.as_matrix(flat, 8, 8), 8, 8, 4, 4))
    out = sites.table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), small.alias("v")).select("row_id", *(F.col("v")[k].alias(f"p{k}") for k in range(16)))
    return rounded(out, *(f"p{k}" for k in range(16)))


# Text.


@query(f"WITH {TOK} SELECT token, count(*) AS tf FROM t GROUP BY token HAVING count(*) > 10 AND count(*) < 5000")
def vocabulary(spark, d):
    return text.vocabulary(sites.tokens(spark, d))


@query(f"WITH {TOK}, {VOCAB} SELECT token, count(DISTINCT doc_id) AS df FROM t WHERE token IN (SELECT token FROM v) GROUP BY token HAVING count(DISTINCT doc_id) > 10")
def doc_frequency(spark, d):
    t = sites.tokens(spark, d)
    return text.document_frequency(t, text.vocabulary(t))


@query(f"WITH {TOK}, {VOCAB}, {DF} SELECT doc_id, t.token, {r('count(*) / any_value(df)')} AS value FROM t JOIN d ON d.token = t.token GROUP BY doc_id, t.token")
def tfidf(spark, d):
    bag = text.term_counts(sites.tokens(spark, d))
    return rounded(text.tf_idf(bag, text.document_frequency(bag, text.vocabulary(bag))), "value")


@query(f"WITH {em()} " + union(f"SELECT '{x}' AS feature, CAST(count_if({x} > 0) AS BIGINT) AS n FROM f" for x in es()))
def feature_count(spark, d):
    return stats.feature_counts(sites.embeddings(spark, d))


@query(f"WITH {em()}, c AS (" + union(f"SELECT {i} AS pos, '{x}' AS feature, count_if({x} > 0) / count(*) AS q FROM f" for i, x in enumerate(es())) + f"), z AS (SELECT pos, feature, CASE WHEN q > 0.55e0 THEN 0e0 ELSE q END AS q FROM c) SELECT pos, feature, {r('q')} AS freq FROM z ORDER BY q DESC, pos LIMIT 5")
def top_features(spark, d):
    return rounded(text.top_features(sites.embeddings(spark, d), 5, 0.55), "freq")


# Linkage.

_OWN = {0: (3, "c_acctbal"), 1: (5, "c_mktsegment"), 2: (7, "c_nationkey")}


def _vertical(spark, d):
    c = sites.table(spark, d, "customer")
    return {s: c.filter(F.col("c_custkey") % n != 0).select("c_custkey", F.col(x).cast("string").alias("x"), F.monotonically_increasing_id().alias("_o")) for s, (n, x) in _OWN.items()}


_HASHES = "h AS (" + union(f"SELECT DISTINCT {s} AS site, sha256(CAST(c_custkey AS VARCHAR)) AS h FROM customer WHERE c_custkey % {n} <> 0" for s, (n, _) in _OWN.items()) + ")"


@query(f"WITH {_HASHES} SELECT site, h FROM h")
def hash_ids(spark, d):
    return linkage.hash_ids(_vertical(spark, d), "c_custkey")


@query(f"WITH {_HASHES} SELECT h FROM h GROUP BY h HAVING count(DISTINCT site) = 3")
def link_full(spark, d):
    return linkage.link(linkage.hash_ids(_vertical(spark, d), "c_custkey"), 3)


@query(f"WITH {_HASHES} SELECT DISTINCT h FROM h")
def link_join(spark, d):
    return linkage.link(linkage.hash_ids(_vertical(spark, d), "c_custkey"), 3, "join")


@query(f"WITH {_HASHES} SELECT i.h, coalesce(c.c_mktsegment, '') AS x FROM (SELECT DISTINCT h FROM h) AS i LEFT JOIN customer AS c ON sha256(CAST(c_custkey AS VARCHAR)) = i.h AND c_custkey % 5 <> 0")
def link_aligned(spark, d):
    frames = _vertical(spark, d)
    return linkage.align(linkage.link(linkage.hash_ids(frames, "c_custkey"), 3, "join"), frames[1], "c_custkey", "_o", missing="")


@query("SELECT sha256(CAST(d.doc_id AS VARCHAR)) AS h, d.lang AS s0_lang, CAST(l.quality AS BIGINT) AS s1_quality FROM documents AS d JOIN labels AS l ON l.doc_id = d.doc_id")
def vertical_concat(spark, d):
    docs = sites.table(spark, d, "documents").select("doc_id", "lang", F.lit(0).alias("o"))
    labels = sites.table(spark, d, "labels").select("doc_id", F.col("quality").cast("bigint").alias("quality"), F.lit(0).alias("o"))
    ids = linkage.link(linkage.hash_ids({0: docs, 1: labels}, "doc_id"), 2)
    return linkage.vertical_concat(ids, {0: (docs, "doc_id", "o"), 1: (labels, "doc_id", "o")})


@query("SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS md5, sha256(CAST(c_custkey AS VARCHAR)) AS sha256 FROM customer")
def digests(spark, d):
    key = F.col("c_custkey")
    return sites.table(spark, d, "customer").select("c_custkey", ex.digest(key, "md5").alias("md5"), ex.digest(key, "sha256").alias("sha256"))


# K-means and kernels. The centroids are the vectors 0 to 3.


#: Vectors have unit length, so a width of one tells them apart.
WIDTH = kernels.width(64, 0.125)


def _centroids(sf, k: int = 4) -> np.ndarray:
    rows = sf.df.filter((F.col("row_id") >= 0) & (F.col("row_id") < k)).orderBy("row_id").select(*sf.features).collect()
    return np.array([list(x) for x in rows])


ES = es()
_D = " + ".join(f"(f.{x} - c.{x}) * (f.{x} - c.{x})" for x in ES)
CD = f"c AS (SELECT * FROM f WHERE row_id < 4), p AS (SELECT f.*, c.row_id AS cid, {_D} AS dist FROM f, c), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, cid) AS rn FROM p) WHERE rn = 1)"


@query(f"""WITH {em()}, l AS ({union(f"SELECT site, '{x}' AS feature, {x} AS value FROM f" for x in ES)}), n AS (SELECT *, row_number() OVER (PARTITION BY site, feature ORDER BY value) AS rn, count(*) OVER (PARTITION BY site, feature) AS m FROM l)
 SELECT site, CAST(least((rn - 1) // (m // 4), 3) AS INT) AS shard, feature, {r('sum(value) / any_value(m // 4)')} AS value FROM n GROUP BY site, least((rn - 1) // (m // 4), 3), feature""")
def naive_sharding(spark, d):
    return rounded(kmeans.naive_sharding(sites.embeddings(spark, d), 4), "value")


@query(f"WITH {em()}, {CD} SELECT row_id, CAST(cid AS INT) AS cluster, {r('sqrt(dist)')} AS distance FROM a")
def kmeans_assign(spark, d):
    sf = sites.embeddings(spark, d)
    return rounded(kmeans.assign(sf, _centroids(sf)), "distance").select("row_id", "cluster", "distance")


@query(f"WITH {em()}, {CD} SELECT row_id, {', '.join(f'{r(f'max(CASE WHEN cid = {i} THEN sqrt(dist) END)')} AS d{i}' for i in range(4))} FROM p GROUP BY row_id")
def kmeans_distances(spark, d):
    sf = sites.embeddings(spark, d)
    return rounded(kmeans.transform(sf, _centroids(sf)), *(f"d{i}" for i in range(4))).select("row_id", *(f"d{i}" for i in range(4)))


def _step_sql(least):
    own = f"s AS (SELECT site, cid, count(*) AS n, avg(sqrt(dist)) AS dist, {', '.join(f'sum({x}) AS {x}' for x in ES)} FROM a GROUP BY site, cid HAVING count(*) >= {least})"
    return f"WITH {em()}, {CD}, {own} SELECT CAST(cid AS INT) AS cluster, CAST(sum(n) AS BIGINT) AS n, {r('sum(dist * n) / sum(n)')} AS distance, {', '.join(f'{r(f'sum({x}) / sum(n)')} AS {x}' for x in ES)} FROM s GROUP BY cid"


@query(_step_sql(1))
def kmeans_step(spark, d):
    sf = sites.embeddings(spark, d)
    return rounded(kmeans.step(sf, _centroids(sf)), "distance", *ES)


@query(_step_sql(3))
def kmeans_step_min3(spark, d):
    """Clusters of one or two rows of a site aren't shown."""
    sf = sites.embeddings(spark, d)
    return rounded(kmeans.step(sf, _centroids(sf), 3), "distance", *ES)


_D2 = " + ".join(f"(f.{x} - c2.{x}) * (f.{x} - c2.{x})" for x in ES)


@query(f"""WITH {em()}, {CD}, c2 AS (SELECT cid, {', '.join(f'avg({x}) AS {x}' for x in ES)} FROM a GROUP BY cid), p2 AS (SELECT f.*, c2.cid, {_D2} AS dist FROM f, c2),
 a2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, cid) AS rn FROM p2) WHERE rn = 1) SELECT CAST(cid AS INT) AS cluster, count(*) AS n, {', '.join(f'{r(f'avg({x})')} AS {x}' for x in ES)} FROM a2 GROUP BY cid""")
def kmeans_2iter(spark, d):
    sf = sites.embeddings(spark, d)
    c, _ = kmeans.fit(sf, 4, iterations=1, start=_centroids(sf))
    return rounded(kmeans.step(sf, c).drop("distance"), *ES)


def _kmeans_fit_sql(steps=8, k=4):
    """Every step in turn; the first one whose mean distance hardly differs from the one before is the last."""
    starts = f"""l AS ({union(f"SELECT site, '{x}' AS feature, {x} AS value FROM f" for x in ES)}), n AS (SELECT *, row_number() OVER (PARTITION BY site, feature ORDER BY value) AS rn, count(*) OVER (PARTITION BY site, feature) AS m FROM l),
 sh AS (SELECT site, least((rn - 1) // (m // {k}), {k - 1}) AS cid, feature, sum(value) / any_value(m // {k}) AS value FROM n GROUP BY site, least((rn - 1) // (m // {k}), {k - 1}), feature),
 sm AS (SELECT cid, feature, avg(value) AS value FROM sh GROUP BY cid, feature), c0 AS MATERIALIZED (SELECT cid, {', '.join(f"max(CASE WHEN feature = '{x}' THEN value END) AS {x}" for x in ES)} FROM sm GROUP BY cid)"""
    parts = []
    for t in range(1, steps + 1):
        near = f"SELECT f.*, c.cid, {' + '.join(f'(f.{x} - c.{x}) * (f.{x} - c.{x})' for x in ES)} AS dist FROM f, c{t - 1} AS c"
        parts.append(f"a{t} AS MATERIALIZED (SELECT * FROM ({near}) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY dist, cid) = 1)")
        parts.append(f"g{t} AS (SELECT cid, {', '.join(f'avg({x}) AS {x}' for x in ES)} FROM a{t} GROUP BY cid)")
        parts.append(f"c{t} AS MATERIALIZED (SELECT o.cid, {', '.join(f'coalesce(g.{x}, o.{x}) AS {x}' for x in ES)} FROM c{t - 1} AS o LEFT JOIN g{t} AS g ON g.cid = o.cid)")
        parts.append(f"d{t} AS MATERIALIZED (SELECT avg(sqrt(dist)) AS d FROM a{t})")
    stop = " ".join(f"WHEN abs((SELECT d FROM d{t - 1}) - (SELECT d FROM d{t})) < 1e-4 * (SELECT d FROM d{t - 1}) THEN {t}" for t in range(2, steps + 1))
    last = union(f"SELECT CAST(cid AS INT) AS cluster, {', '.join(f'{r(x)} AS {x}' for x in ES)} FROM c{t} WHERE (SELECT t FROM z) = {t}" for t in range(1, steps + 1))
    return f"WITH {em()}, {starts}, {', '.join(parts)}, z AS MATERIALIZED (SELECT CASE {stop} ELSE {steps} END AS t) {last}"


_FAR = f"c AS (SELECT row_id, {', '.join(ES)} FROM f WHERE row_id < 4 UNION ALL SELECT 4, {', '.join('1e3' for _ in ES)}), p AS (SELECT f.*, c.row_id AS cid, {_D} AS dist FROM f, c), a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY p.row_id ORDER BY dist, cid) = 1)"


@query(f"""WITH {em()}, {_FAR}, s AS (SELECT cid, count(*) AS n, {', '.join(f'avg({x}) AS {x}' for x in ES)} FROM a GROUP BY cid)
 SELECT CAST(c.row_id AS INT) AS cluster, {', '.join(f'{r(f'coalesce(s.{x}, 0)')} AS {x}' for x in ES)} FROM c LEFT JOIN s ON s.cid = c.row_id""")
def kmeans_step_sequential(spark, d):
    """Sites one by one; the fifth centroid is far from all rows and goes to zero."""
    sf = sites.embeddings(spark, d)
    start = np.vstack([_centroids(sf), np.full(len(ES), 1e3)])
    c, _ = kmeans.fit(sf, 5, iterations=1, start=start, sequential=True)
    return table_of(spark, [(i, *(round(float(v), 6) + 0.0 for v in x)) for i, x in enumerate(c)], "cluster int, " + ", ".join(f"{x} double" for x in ES))


@query(_kmeans_fit_sql())
def kmeans_fit(spark, d):
    sf = sites.embeddings(spark, d)
    c, seen = kmeans.fit(sf, 4, iterations=8, relocate=False)
    return table_of(spark, [(i, *(round(float(v), 6) + 0.0 for v in x)) for i, x in enumerate(c)], "cluster int, " + ", ".join(f"{x} double" for x in ES))


@query(f"WITH {em()}, {CD} SELECT row_id, {', '.join(f'{r(f'max(CASE WHEN cid = {i} THEN exp(-dist / 2e0) END)')} AS k{i + 1}' for i in range(4))} FROM p GROUP BY row_id")
def rbf_features(spark, d):
    sf = sites.embeddings(spark, d)
    kf = kernels.features(sf, _centroids(sf), WIDTH)
    return rounded(kf.df, *kf.features).select("row_id", *kf.features)


KF = "k AS (SELECT any_value(site) AS site, row_id, any_value(y) AS y, any_value(label) AS label, " + ", ".join(f"max(CASE WHEN cid = {i} THEN exp(-dist / 2e0) END) AS k{i + 1}" for i in range(4)) + " FROM p GROUP BY row_id)"
KS = ("k1", "k2", "k3", "k4")


@query(f"WITH {em()}, {CD}, {KF} {_gram_sql(KS, False, frm='k')}")
def kernel_gram(spark, d):
    sf = sites.embeddings(spark, d)
    return rounded(stats.gram(kernels.features(sf, _centroids(sf), WIDTH), by_site=False), "value", k=4)


@query(f"WITH {em()}, {CD} SELECT CAST(cid AS INT) AS centroid, {r('sum(exp(-dist / 2e0))', 5)} AS score FROM p GROUP BY cid")
def centroid_scores(spark, d):
    sf = sites.embeddings(spark, d)
    return rounded(kernels.centroid_scores(sf, _centroids(sf), WIDTH), "score", k=5)


@query(f"WITH {em()}, {CD} SELECT CAST(cid AS INT) AS centroid, CAST(count(*) AS DOUBLE) AS score FROM a GROUP BY cid")
def centroid_winners(spark, d):
    sf = sites.embeddings(spark, d)
    return kernels.centroid_scores(sf, _centroids(sf), WIDTH, "winners")


# Ridge systems solved in SQL by elimination, which their positive diagonals allow without pivots.


def _normal(terms, y, extra=lambda i, j: "0e0", weight="1e0"):
    """Columns of the normal equations of terms and y, with an addition to each entry; column n is the right side."""
    n = len(terms)
    cell = lambda i, j: f"sum({weight} * {terms[i]} * {terms[j]}) + {extra(i, j)} AS m{i}_{j}"
    return ", ".join([cell(i, j) for i in range(n) for j in range(n)] + [f"sum({weight} * {terms[i]} * {y}) AS m{i}_{n}" for i in range(n)])


def _ridge(penalty):
    return lambda i, j: repr(penalty) if i == j else "0e0"


def _solution(src, n, out, keys=""):
    """CTEs that end in out: keys, w0, w1, … of a CTE that has the columns of _normal()."""
    parts, cur = [], src
    for k in range(n):
        name = out if k == n - 1 else f"{out}_{k}"
        entry = lambda i, j, k=k: f"m{k}_{j} / m{k}_{k}" if i == k else f"m{i}_{j} - m{i}_{k} * m{k}_{j} / m{k}_{k}"
        cols = [f"{entry(i, j)} AS {f'w{i}' if k == n - 1 else f'm{i}_{j}'}" for i in range(n) for j in range(k + 1, n + 1)]
        parts.append(f"{name} AS MATERIALIZED (SELECT {keys + ', ' if keys else ''}{', '.join(cols)} FROM {cur})")
        cur = name
    return ", ".join(parts)


def _dot(terms, w="w"):
    return " + ".join(f"{w}.w{i} * {t}" for i, t in enumerate(terms))


# Linear models: so many steps from zero weights.


def _descent_sql(link, steps, rate=0.1, momentum=0.0, combine="site_mean", classes=None, frm=LI, xs=XS):
    """CTEs w0, w1, …: the weights after each step, a row for each class."""
    names = classes or [""]
    n = len(xs) + 1
    cols = ", ".join(f"0e0 AS w{j}, 0e0 AS v{j}" for j in range(n))
    out = [frm, "w0 AS (" + union(f"SELECT '{c}' AS cls, {cols}" for c in names) + ")"]
    terms_ = ["1e0", *xs]
    for t in range(1, steps + 1):
        s = "w.w0 + " + " + ".join(f"w.w{j + 1} * f.{x}" for j, x in enumerate(xs))
        s = f"1e0 / (1e0 + exp(-({s})))" if link == "sigmoid" else s
        y = "CASE WHEN f.class = w.cls THEN 1e0 ELSE 0e0 END" if classes else "f.y"
        f_ = lambda x: x if x == "1e0" else "f." + x
        if combine == "site_mean":
            g = f"SELECT cls, {', '.join(f'avg(g{j}) AS g{j}' for j in range(n))} FROM (SELECT w.cls, f.site, {', '.join(f'avg(({s} - {y}) * {f_(x)}) AS g{j}' for j, x in enumerate(terms_))} FROM f, w{t - 1} AS w GROUP BY w.cls, f.site) GROUP BY cls"
        else:
            g = f"SELECT w.cls, {', '.join(f'avg(({s} - {y}) * {f_(x)}) AS g{j}' for j, x in enumerate(terms_))} FROM f, w{t - 1} AS w GROUP BY w.cls"
        v = lambda j: f"({momentum!r} * w.v{j} + {rate!r} * g.g{j})"
        out.append(f"w{t} AS (SELECT w.cls, {', '.join(f'w.w{j} - {v(j)} AS w{j}, {v(j)} AS v{j}' for j in range(n))} FROM w{t - 1} AS w JOIN ({g}) AS g ON g.cls = w.cls)")
    return "WITH " + ", ".join(out)


def _weights_sql(n, t):
    return union(f"SELECT cls AS class, {j} AS pos, {r(f'w{j}')} AS w FROM w{t}" for j in range(n))


def _weights(spark, model):
    return table_of(spark, [(c, j, round(float(v), 6) + 0.0) for c, w in model.weights.items() for j, v in enumerate(w)], "class string, pos int, w double")


@query(_descent_sql("linear", 1) + _weights_sql(5, 1))
def lr_gd_step(spark, d):
    return _weights(spark, linear.descend(sites.lineitem(spark, d), steps=1))


@query(_descent_sql("linear", 3, 0.2, 0.5) + _weights_sql(5, 3))
def lr_gd_T3(spark, d):
    return _weights(spark, linear.descend(sites.lineitem(spark, d), steps=3, rate=0.2, momentum=0.5))


@query(_descent_sql("linear", 3, 0.2) + f"SELECT row_id, {r('w0 + w1 * x1 + w2 * x2 + w3 * x3 + w4 * x4', 5)} AS score FROM f, w3")
def lr_predict(spark, d):
    sf = sites.lineitem(spark, d)
    return rounded(linear.descend(sf, steps=3, rate=0.2).predict(sf.df), "score", k=5).select("row_id", "score")


@query(f"""WITH {LI}, s AS (SELECT count(*) + 0.01e0 AS a, sum(x1) AS b, sum(x1 * x1) + 0.01e0 AS c, sum(y) AS u, sum(x1 * y) AS v FROM f)
 SELECT '' AS class, 0 AS pos, {r('(u * c - b * v) / (a * c - b * b)')} AS w FROM s UNION ALL SELECT '', 1, {r('(a * v - b * u) / (a * c - b * b)')} FROM s""")
def rr_closed_form_1d(spark, d):
    return _weights(spark, linear.ridge(preprocess.select(sites.lineitem(spark, d), [0])))


@query(f"""WITH {LI}, s AS (SELECT count(*) + 0.01e0 AS a, sum(x1) AS b, sum(x1 * x1) + 0.01e0 AS c, sum(y) AS u, sum(x1 * y) AS v FROM f)
 SELECT row_id, {r('(u * c - b * v) / (a * c - b * b) + x1 * (a * v - b * u) / (a * c - b * b)', 5)} AS score FROM f, s""")
def rr_predict(spark, d):
    sf = preprocess.select(sites.lineitem(spark, d), [0])
    return rounded(linear.ridge(sf).predict(sf.df), "score", k=5).select("row_id", "score")


@query(f"WITH {LI}, m AS (SELECT {_normal(['1e0', *XS], 'y', _ridge(0.01))} FROM f), {_solution('m', 5, 'w')} " + union(f"SELECT '' AS class, {j} AS pos, {r(f'w{j}')} AS w FROM w" for j in range(5)))
def rr_fit(spark, d):
    return _weights(spark, linear.ridge(sites.lineitem(spark, d)))


_BATCH = LI.replace("f AS (", "f0 AS (", 1) + ", b AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ((row_id * 1103515245 + 12345) % 2147483648), row_id) AS bn, count(*) OVER (PARTITION BY site) AS bc FROM f0), f AS (SELECT * FROM b WHERE bn <= floor(bc * 0.25e0))"


@query(_descent_sql("linear", 1, frm=_BATCH) + _weights_sql(5, 1))
def lr_minibatch_step(spark, d):
    """A step on a quarter of each site's rows."""
    return _weights(spark, linear.descend(sites.lineitem(spark, d), steps=1, minibatch=0.25))


@query(
    f"WITH {LI}, q AS (SELECT class, (SELECT count(*) FROM f) / ((SELECT count(DISTINCT class) FROM f) * count(*)) AS q FROM f GROUP BY class), s AS (SELECT site, "
    + ", ".join(f"sum(q * (0.5e0 - y) * {x}) / sum(q) AS g{j}" for j, x in enumerate(("1e0", *XS)))
    + " FROM f JOIN q ON q.class = f.class GROUP BY site) "
    + union(f"SELECT '' AS class, {j} AS pos, {r(f'-0.5e0 * avg(g{j})')} AS w FROM s" for j in range(5))
)
def lc_balanced_step(spark, d):
    """A step in which the classes weigh alike."""
    sf = sites.lineitem(spark, d)
    return _weights(spark, linear.descend(sf, "sigmoid", steps=1, rate=0.5, weight=stats.balancing(sf, "class")))


_TWO = f"{LI}, m AS (SELECT {_normal(['1e0', *XS], 'y', _ridge(0.01))} FROM f WHERE site < 2), {_solution('m', 5, 'w')}"


@query(f"WITH {_TWO} SELECT row_id, {r('0.3e0 * (' + _dot(['1e0', *XS]) + ')', 5)} AS score FROM f, w")
def whatif_products(spark, d):
    """Zero weights, blended with three tenths of a ridge regression of the first two sites."""
    sf = sites.lineitem(spark, d)
    own = value.site_matrices(sf)
    model = linear.Linear({"": np.zeros(5)}, XS)
    return rounded(model.predict_with_products(sf.df, [own[0], own[1]], blend=0.3), "score", k=5).select("row_id", "score")


@query(_descent_sql("sigmoid", 1, 0.5, combine="rows") + _weights_sql(5, 1))
def lc_step_global(spark, d):
    return _weights(spark, linear.descend(sites.lineitem(spark, d), "sigmoid", steps=1, rate=0.5, combine="rows"))


@query(_descent_sql("sigmoid", 1, 0.5) + _weights_sql(5, 1))
def lc_step_sitemean(spark, d):
    return _weights(spark, linear.descend(sites.lineitem(spark, d), "sigmoid", steps=1, rate=0.5))


@query(_descent_sql("sigmoid", 2, 0.5, 0.9) + _weights_sql(5, 2))
def lc_T2(spark, d):
    return _weights(spark, linear.descend(sites.lineitem(spark, d), "sigmoid", steps=2, rate=0.5, momentum=0.9))


@query(_descent_sql("sigmoid", 2, 0.5, 0.9) + f"SELECT row_id, {r('1e0 / (1e0 + exp(-(w0 + w1 * x1 + w2 * x2 + w3 * x3 + w4 * x4)))', 5)} AS score FROM f, w2")
def lc_predict(spark, d):
    sf = sites.lineitem(spark, d)
    return rounded(linear.descend(sf, "sigmoid", steps=2, rate=0.5, momentum=0.9).predict(sf.df), "score", k=5).select("row_id", "score")


@query(
    _descent_sql("sigmoid", 1, 1.0, combine="rows", frm=em(), xs=ES)
    + f""", e AS (SELECT k / 1e2 AS rate, avg(-y * ln(o) - (1 - y) * ln(1 - o)) AS err FROM (SELECT k, y, (1e0 / (1e0 + exp({' + '.join(f'{x} * k / 1e2 * -w{j}' for j, x in enumerate(('1e0', *ES)))}))) * (1 - 2e-6) + 1e-6 AS o FROM f, w1, range(1, 1000) AS t(k)) GROUP BY k)
 SELECT rate, {r('err', 8)} AS error FROM e"""
)
def lc_linesearch(spark, d):
    """Errors of all rates along the first step's gradient."""
    sf = sites.embeddings(spark, d)
    w = linear.descend(sf, "sigmoid", steps=1, rate=1.0, combine="rows").weights[""]
    return rounded(linear.line_search_errors(sf, np.zeros(len(w)), -w), "error", k=8)


@query(_descent_sql("sigmoid", 1, 0.5, classes=["A", "N", "R"]) + _weights_sql(5, 1))
def mlc_step(spark, d):
    return _weights(spark, linear.descend(sites.lineitem(spark, d), "sigmoid", classes=["A", "N", "R"], steps=1, rate=0.5))


@query(
    _descent_sql("sigmoid", 3, 0.5, classes=["A", "N", "R"])
    + ", s AS (SELECT f.class, " + ", ".join(f"(SELECT 1e0 / (1e0 + exp(-(w0 + w1 * x1 + w2 * x2 + w3 * x3 + w4 * x4))) FROM w3 WHERE cls = '{c}') AS s{c}" for c in "ANR")
    + " FROM f) SELECT class, CASE WHEN sA >= sN AND sA >= sR THEN 'A' WHEN sN >= sR THEN 'N' ELSE 'R' END AS predicted, count(*) AS n FROM s GROUP BY ALL"
)
def mlc_predict(spark, d):
    sf = sites.lineitem(spark, d)
    return linear.descend(sf, "sigmoid", classes=["A", "N", "R"], steps=3, rate=0.5).predict(sf.df, "predicted").groupBy("class", "predicted").agg(F.count("*").alias("n"))


# Support vector machines, kernel regression.

_HF = "k AS (SELECT any_value(site) AS site, row_id, any_value(y) * 2 - 1 AS y, " + ", ".join(f"max(CASE WHEN cid = {i} THEN exp(-dist / 1e0) END) AS k{i + 1}" for i in range(4)) + " FROM p GROUP BY row_id)"
_W = (0.4, -0.2, 0.3, -0.5)


def _hinge_sql(how):
    s = " + ".join(f"k{i + 1} * {w!r}" for i, w in enumerate(_W))
    g = ", ".join(f"sum(CASE WHEN y * ({s}) < 1 THEN -2e0 * y * k{i + 1} ELSE 0e0 END) AS g{i}" for i in range(4))
    return f"WITH {em()}, {CD}, {_HF}, g AS (SELECT site, {g} FROM k GROUP BY site) " + union(f"SELECT {i} AS pos, {r(f'{how}(g{i})', 5)} AS g FROM g" for i in range(4))


def _hinge(spark, d, how):
    sf = sites.embeddings(spark, d)
    kf = kernels.features(sf, _centroids(sf), WIDTH, halved=False)
    g = kernels.hinge_gradients(kf, np.array(_W), 2.0, kernels.sign_target(sf)).agg(*(how(f"g{i}").alias(f"g{i}") for i in range(4)))
    return rounded(g.select(F.posexplode(F.array(*(f"g{i}" for i in range(4)))).alias("pos", "g")), "g", k=5)


@query(_hinge_sql("avg"))
def svm_grad_mean(spark, d):
    return _hinge(spark, d, F.avg)


@query(_hinge_sql("sum"))
def svm_grad_sum(spark, d):
    return _hinge(spark, d, F.sum)


@query(f"WITH {em()}, {CD}, {_HF} SELECT row_id, CASE WHEN {' + '.join(f'k{i + 1} * {w!r}' for i, w in enumerate(_W))} >= 0 THEN 1e0 ELSE -1e0 END AS predicted FROM k")
def svm_sign(spark, d):
    sf = sites.embeddings(spark, d)
    return kernels.Kernel({"": np.array(_W)}, _centroids(sf), WIDTH, halved=False, intercept=False).predict(sf, "predicted", hard=True).select("row_id", "predicted")


def _svm_fit_sql(steps=3, rate="1e-3"):
    """Weights after the steps of each way of combining sites; cost 1."""
    zero, out = ", ".join(f"0e0 AS w{i}" for i in range(4)), []
    s = " + ".join(f"k.{x} * w.w{i}" for i, x in enumerate(KS))
    g = ", ".join(f"sum(CASE WHEN y * ({s}) < 1 THEN -y * k.{x} ELSE 0e0 END) AS g{i}" for i, x in enumerate(KS))
    for how in ("mean", "sum", "sequential"):
        cur = f"{how}_0"
        out.append(f"{cur} AS (SELECT {zero})")
        for t in range(1, steps + 1):
            for site in range(4) if how == "sequential" else (None,):
                name = f"{how}_{t}" if site in (None, 3) else f"{how}_{t}_{site}"
                own = f"SELECT site, {g} FROM k, {cur} AS w" + (f" WHERE site = {site}" if site is not None else "") + " GROUP BY site"
                f_ = "avg" if how == "mean" else "sum"
                out.append(f"{name} AS MATERIALIZED (SELECT {', '.join(f'w.w{i} - {rate} * g.g{i} AS w{i}' for i in range(4))} FROM {cur} AS w, (SELECT {', '.join(f'coalesce({f_}(g{i}), 0) AS g{i}' for i in range(4))} FROM ({own})) AS g)")
                cur = name
    rows = union(f"SELECT '{how}' AS combine, {i} AS pos, {r(f'w{i}')} AS w FROM {how}_{steps}" for how in ("mean", "sum", "sequential") for i in range(4))
    return f"WITH {em()}, {CD}, {_HF.replace('k AS (', 'k AS MATERIALIZED (', 1)}, {', '.join(out)} {rows}"


@query(_svm_fit_sql())
def svm_fit(spark, d):
    sf = sites.embeddings(spark, d)
    rows = [(how, j, round(float(w), 6) + 0.0) for how in ("mean", "sum", "sequential") for j, w in enumerate(kernels.svm(sf, _centroids(sf), WIDTH, steps=3, combine=how).weights[""])]
    return table_of(spark, rows, "combine string, pos int, w double")


_IW = (0.1, 0.4, -0.2, 0.3, -0.5)
_IE = f"1e0 - (2 * y - 1) * ({_IW[0]!r} + " + " + ".join(f"k{i + 1} * {w!r}" for i, w in enumerate(_IW[1:])) + ")"
_IA = "CASE WHEN e < 0 THEN 0e0 WHEN e >= 0.01 THEN 2e0 / e ELSE 200e0 END"


@query(f"WITH {em()}, {CD}, {KF}, e AS (SELECT row_id, {_IE} AS e FROM k) SELECT row_id, {r(_IA, 5)} AS weight FROM e")
def irwls_weights(spark, d):
    sf = sites.embeddings(spark, d)
    kf = kernels.features(sf, _centroids(sf), WIDTH)
    e = F.lit(1.0) - kernels.sign_target(sf) * ex.dot(kf.features, _IW)
    return rounded(kf.df.select("row_id", kernels.irwls_weight(e, 1.0, 0.01).alias("weight")), "weight", k=5)


@query(f"WITH {em()}, {CD}, {KF}, e AS (SELECT *, {_IE} AS e FROM k), z AS (SELECT k1, k2, k3, k4, 2 * y - 1 AS y, {_IA} AS a_ FROM e) {_gram_sql(KS, False, 'a_', 3, 'z')}")
def weighted_gram(spark, d):
    sf = sites.embeddings(spark, d)
    kf = kernels.features(sf, _centroids(sf), WIDTH)
    g = kernels.weighted_gram(kf, np.array(_IW), kernels.sign_target(sf), 1.0, 0.01)
    return rounded(g, "value", k=3)


def _accuracy(spark, sf, model, label=None):
    found = model.predict(sf, "p", hard=label is None).withColumn("t", F.col(label) if label else kernels.sign_target(sf))
    return rounded(metrics.accuracy(found, "p", "t"), "accuracy")


_T = ("1e0", *KS)
#: Kernels among the centroids c, as one row of q1_1, q1_2, ….
_DCC = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in ES)
_KCC = "q AS MATERIALIZED (SELECT " + ", ".join(f"max(CASE WHEN a.row_id = {i} AND b.row_id = {j} THEN exp(-({_DCC}) / 2e0) END) AS q{i + 1}_{j + 1}" for i in range(4) for j in range(4)) + " FROM c AS a, c AS b)"
_KM = KF.replace("k AS (", "k AS MATERIALIZED (", 1)


def _kcc(i, j):
    return "1e-5" if i == j == 0 else f"any_value(q{i}_{j})" if i and j else "0e0"


def _reweighted(t, rows, y, keys="", eps="1e-4"):
    """CTEs v{t}: the solution that weights w{t - 1} lead to, by keys of both rows and weights."""
    e = f"1e0 - {y} * ({_dot(_T)})"
    a = f"CASE WHEN e < 0 THEN 0e0 WHEN e >= {eps} THEN 2e0 / e ELSE 2e0 / {eps} END"
    on = f"JOIN w{t - 1} AS w ON w.{keys} = r.{keys}" if keys else f", w{t - 1} AS w"
    inner = f"SELECT r.*, {y} AS t, {e} AS e FROM {rows} AS r {on}"
    group = f" GROUP BY {keys}" if keys else ""
    return f"m{t} AS (SELECT {keys + ', ' if keys else ''}{_normal(_T, 't', _kcc, 'a_')} FROM (SELECT *, {a} AS a_ FROM ({inner})), q{group}), " + _solution(f"m{t}", 5, f"v{t}", keys)


def _moved(t):
    return f"sqrt({' + '.join(f'(b.w{i} - a.w{i}) ** 2' for i in range(5))}) / CASE WHEN {' + '.join(f'a.w{i} ** 2' for i in range(5))} = 0 THEN 1e0 ELSE sqrt({' + '.join(f'a.w{i} ** 2' for i in range(5))}) END"


_ZERO5 = ", ".join(f"0e0 AS w{i}" for i in range(5))
_HIT = f"avg(CASE WHEN ({_dot(_T)} >= 0) = (y = 1) THEN 1e0 ELSE 0e0 END)"


def _bsvm_fit_sql(steps=4):
    """All steps, and the last one before the accuracy on the validation rows no longer rises."""
    parts = [f"tr AS MATERIALIZED (SELECT * FROM k WHERE row_id % 10 <> 0), w0 AS (SELECT {_ZERO5})"]
    for t in range(1, steps + 1):
        parts.append(_reweighted(t, "tr", "(2 * y - 1)"))
        parts.append(f"w{t} AS MATERIALIZED (SELECT * FROM v{t}), s{t} AS MATERIALIZED (SELECT (SELECT {_HIT} FROM k, w{t} AS w WHERE row_id % 10 = 0) AS acc, (SELECT {_HIT} FROM k, w{t} AS w) AS hit, (SELECT {_moved(t)} FROM w{t - 1} AS a, w{t} AS b) AS moved)")
    rules = []
    for t in range(1, steps + 1):
        if t > 1:
            rules.append(f"WHEN (SELECT acc FROM s{t}) <= (SELECT acc FROM s{t - 1}) THEN (SELECT hit FROM s{t - 1})")
        rules.append(f"WHEN (SELECT moved FROM s{t}) < 1e-3 THEN (SELECT hit FROM s{t})")
    return f"WITH {em()}, {CD}, {_KM}, {_KCC}, {', '.join(parts)} SELECT {r(f'CASE {" ".join(rules)} ELSE (SELECT hit FROM s{steps}) END')} AS accuracy"


@query(_bsvm_fit_sql())
def bsvm_fit(spark, d):
    sf = sites.embeddings(spark, d)
    train, val = sf.halves(F.col("row_id") % 10 == 0)
    return _accuracy(spark, sf, kernels.budget_svm(train, _centroids(sf), WIDTH, steps=4, validation=val))


def _mbsvm_fit_sql(steps=2):
    rows = "r3 AS MATERIALIZED (SELECT k.*, CAST(label % 3 AS VARCHAR) AS class, n.cls, CASE WHEN CAST(label % 3 AS VARCHAR) = n.cls THEN 1e0 ELSE -1e0 END AS s FROM k, (VALUES ('0'), ('1'), ('2')) AS n(cls))"
    parts = [rows, "w0 AS (" + union(f"SELECT '{c}' AS cls, {_ZERO5}" for c in "012") + ")"]
    for t in range(1, steps + 1):
        parts += [_reweighted(t, "r3", "r.s", "cls"), f"w{t} AS MATERIALIZED (SELECT * FROM v{t})"]
    best = f"SELECT * FROM (SELECT r3.row_id, class, r3.cls, {_dot(_T)} AS o FROM r3 JOIN w{steps} AS w ON w.cls = r3.cls) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY o DESC, cls) = 1"
    return f"WITH {em()}, {CD}, {_KM}, {_KCC}, {', '.join(parts)} SELECT {r('avg(CASE WHEN cls = class THEN 1e0 ELSE 0e0 END)')} AS accuracy FROM ({best})"


@query(_mbsvm_fit_sql())
def mbsvm_fit(spark, d):
    sf = sites.embeddings(spark, d)
    sf = sf.having(sf.df.withColumn("class", (F.col("label") % 3).cast("string")))
    return _accuracy(spark, sf, kernels.budget_svm(sf, _centroids(sf), WIDTH, steps=2, classes=["0", "1", "2"]), "class")


def _dsvm_fit_sql(steps=2):
    """At each step the blend of old and new weights with the best area under the curve on the validation rows."""
    parts = [f"tr AS MATERIALIZED (SELECT * FROM k WHERE row_id % 10 <> 0), w0 AS (SELECT {_ZERO5})"]
    for t in range(1, steps + 1):
        parts.append(_reweighted(t, "tr", "(2 * y - 1)"))
        scored = f"SELECT l, y, (1e0 - l / 1e2) * ({_dot(_T, 'a')}) + l / 1e2 * ({_dot(_T, 'b')}) AS s FROM k, w{t - 1} AS a, v{t} AS b, range(-100, 200) AS x(l) WHERE row_id % 10 = 0"
        ranked = f"SELECT l, y, rank() OVER (PARTITION BY l ORDER BY s) + (count(*) OVER (PARTITION BY l, s) - 1) / 2e0 AS rk FROM ({scored})"
        auc = "(sum(CASE WHEN y = 1 THEN rk END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2e0) / (count_if(y = 1) * count_if(y = 0))"
        parts.append(f"l{t} AS MATERIALIZED (SELECT l FROM (SELECT l, {auc} AS auc FROM ({ranked}) GROUP BY l) ORDER BY auc DESC, abs(l - 100), l LIMIT 1)")
        parts.append(f"w{t} AS MATERIALIZED (SELECT {', '.join(f'(1e0 - l / 1e2) * a.w{i} + l / 1e2 * b.w{i} AS w{i}' for i in range(5))} FROM w{t - 1} AS a, v{t} AS b, l{t})")
    return f"WITH {em()}, {CD}, {_KM}, {_KCC}, {', '.join(parts)} SELECT {r(_HIT)} AS accuracy FROM k, w{steps} AS w"


@query(_dsvm_fit_sql())
def dsvm_fit(spark, d):
    sf = sites.embeddings(spark, d)
    train, val = sf.halves(F.col("row_id") % 10 == 0)
    return _accuracy(spark, sf, kernels.budget_svm(train, _centroids(sf), WIDTH, steps=2, validation=val, search=True))


def _pruned(n, to):
    """CTEs that end in kept: the row_ids of the first n vectors without the later one of the closest two, until few are left."""
    parts = [f"z AS MATERIALIZED (SELECT a.row_id AS i, b.row_id AS j, {_DCC} AS d FROM f AS a, f AS b WHERE a.row_id < b.row_id AND b.row_id < {n})", f"o0 AS (SELECT row_id FROM f WHERE row_id < {n})"]
    for t in range(1, n - to + 1):
        name = "kept" if t == n - to else f"o{t}"
        parts.append(f"{name} AS MATERIALIZED (SELECT row_id FROM o{t - 1} WHERE row_id <> (SELECT j FROM z WHERE i IN (SELECT row_id FROM o{t - 1}) AND j IN (SELECT row_id FROM o{t - 1}) ORDER BY d, i, j LIMIT 1))")
    return ", ".join(parts)


def _fbsvm_fit_sql(rounds=2, epochs=2):
    c = f"c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, {', '.join(ES)} FROM f WHERE row_id IN (SELECT row_id FROM kept)), p AS (SELECT f.*, c.row_id AS cid, {_D} AS dist FROM f, c)"
    parts, w = ["w0 AS (" + union(f"SELECT {s} AS site, {_ZERO5}" for s in range(4)) + ")"], ", ".join(f"w{i}" for i in range(5))
    for t in range(1, rounds * epochs + 1):
        parts.append(_reweighted(t, "k", "(2 * y - 1)", "site"))
        shared = t % epochs == 0
        parts.append(f"w{t} AS MATERIALIZED (SELECT site, {', '.join(f'avg(w{i}) OVER () AS w{i}' for i in range(5)) if shared else w} FROM v{t})")
    return f"WITH {em()}, {_pruned(12, 4)}, {c}, {_KM}, {_KCC}, {', '.join(parts)} SELECT {r(_HIT)} AS accuracy FROM k JOIN w{rounds * epochs} AS w ON w.site = 0"


@query(_fbsvm_fit_sql())
def fbsvm_fit(spark, d):
    sf = sites.embeddings(spark, d)
    c = ranking.prune(_centroids(sf, 12), 4)
    return _accuracy(spark, sf, kernels.federated_svm(sf, c, WIDTH, rounds=2, epochs=2))


@query(_descent_sql("linear", 1, 0.1, frm=f"f0 AS ({'SELECT * FROM (' + em()[6:-1] + ')'}), " + CD.replace("FROM f WHERE", "FROM f0 AS f WHERE").replace("FROM f, c)", "FROM f0 AS f, c)") + ", " + KF.replace("k AS (", "f AS (", 1), xs=KS) + _weights_sql(5, 1))
def kr_gd_step(spark, d):
    sf = sites.embeddings(spark, d)
    model = kernels.regress(sf, _centroids(sf), WIDTH, steps=1)
    return _weights(spark, linear.Linear(model.weights, KS))


@query(
    f"WITH {em()}, {CD}, {_KM}, w0 AS (SELECT {_ZERO5}), "
    + ", ".join(
        f"g{t} AS (SELECT {', '.join(f'avg(g{j}) AS g{j}' for j in range(5))} FROM (SELECT site, {', '.join(f'avg(CASE WHEN t * (t - s) > 0 THEN (s - t) * {x} ELSE 0e0 END) AS g{j}' for j, x in enumerate(_T))} FROM (SELECT k.*, 2 * y - 1 AS t, {_dot(_T)} AS s FROM k, w{t - 1} AS w) GROUP BY site)), "
        f"w{t} AS MATERIALIZED (SELECT {', '.join(f'w.w{j} - 0.5e0 * g.g{j} AS w{j}' for j in range(5))} FROM w{t - 1} AS w, g{t} AS g)"
        for t in (1, 2, 3)
    )
    + " "
    + union(f"SELECT '' AS class, {j} AS pos, {r(f'w{j}')} AS w FROM w3" for j in range(5))
)
def bsvm_sign_steps(spark, d):
    """Three gradient steps along the errors of rows inside their margin."""
    sf = sites.embeddings(spark, d)
    return _weights(spark, linear.Linear(kernels.sign_svm(sf, _centroids(sf), WIDTH, steps=3, rate=0.5, stop=0.0).weights, KS))


@query(
    f"WITH {em()}, {CD}, {_KM}, m AS (SELECT {_normal(_T, 'y', lambda i, j: '0.01e0 * count(*)' if i == j else '0e0')} FROM k WHERE row_id % 10 = 0), {_solution('m', 5, 'w0')}, "
    f"g AS (SELECT {', '.join(f'avg(g{j}) AS g{j}' for j in range(5))} FROM (SELECT site, {', '.join(f'avg(({_dot(_T)} - y) * {x}) AS g{j}' for j, x in enumerate(_T))} FROM k, w0 AS w WHERE row_id % 10 <> 0 GROUP BY site)) "
    + union(f"SELECT '' AS class, {j} AS pos, {r(f'w.w{j} - 0.1e0 * g.g{j}')} AS w FROM w0 AS w, g" for j in range(5))
)
def kr_warm_step(spark, d):
    """A gradient step that starts from a ridge regression on the validation rows."""
    sf = sites.embeddings(spark, d)
    train, val = sf.halves(F.col("row_id") % 10 == 0)
    return _weights(spark, linear.Linear(kernels.regress(train, _centroids(sf), WIDTH, steps=1, validation=val).weights, KS))


@query(f"WITH {em()}, {CD}, {_KM}, m AS (SELECT {_normal(_T, 'y', _ridge(0.01))} FROM k), {_solution('m', 5, 'w')}, o AS (SELECT y, {_dot(_T)} AS s FROM k, w) SELECT {r('avg((y - s) * (y - s))')} AS mse, {r('1 - sum((y - s) * (y - s)) / (count(*) * var_pop(y))')} AS r2 FROM o")
def kr_closed_form(spark, d):
    sf = sites.embeddings(spark, d)
    out = kernels.regress(sf, _centroids(sf), WIDTH).predict(sf)
    return rounded(metrics.errors(out, "score", "y"), "mse", "r2")


# Ranking and metrics.


def _subset_sql(n, frm, penalty, keys_of_mask):
    """CTE m: the normal equations of each mask; what a mask leaves out has a row and column of the identity instead."""
    inside = lambda i: "TRUE" if i == 0 else keys_of_mask(i)
    cell = lambda i, j: f"CASE WHEN {inside(i)} AND {inside(j)} THEN g{min(i, j)}_{max(i, j)} ELSE 0e0 END + {f'CASE WHEN {inside(i)} THEN {penalty!r} ELSE 1e0 END' if i == j else '0e0'} AS m{i}_{j}"
    cols = [cell(i, j) for i in range(n) for j in range(n)] + [f"CASE WHEN {inside(i)} THEN g{i}_{n} ELSE 0e0 END AS m{i}_{n}" for i in range(n)]
    return f"m AS (SELECT mask, {', '.join(cols)} FROM {frm})"


def _products(prefix, terms, y, frm, where, key=""):
    """Columns {prefix}{i}_{j} of sums of products of terms and y, each pair once."""
    both = [*terms, y]
    cols = ", ".join(f"sum({both[i]} * {both[j]}) AS {prefix}{i}_{j}" for i in range(len(both)) for j in range(i, len(both)))
    return f"SELECT {key + ', ' if key else ''}{cols} FROM {frm} WHERE {where}" + (f" GROUP BY {key}" if key else "")


def _residual(n, prefix="v"):
    """The sum of squared errors of weights w on the products of other rows."""
    cross = " + ".join(f"w{i} * {prefix}{i}_{n}" for i in range(n))
    square = " + ".join(f"w{i} * w{j} * {prefix}{min(i, j)}_{max(i, j)}" for i in range(n) for j in range(n))
    return f"({prefix}{n}_{n} - 2 * ({cross}) + {square})"


_TX = ("1e0", *XS)
_TRAIN, _VALID = "row_id % 10 <> 0", "row_id % 10 = 0"
_GFS = f"""{LI}, g AS ({_products('g', _TX, 'y', 'f', _TRAIN)}), v AS MATERIALIZED ({_products('v', _TX, 'y', 'f', _VALID)}), gm AS (SELECT * FROM g, (SELECT k AS mask FROM range(0, 16) AS t(k))),
 {_subset_sql(5, 'gm', 1e-4, lambda i: f"(mask & {1 << i - 1}) <> 0")}, {_solution('m', 5, 'w', 'mask')}, e AS MATERIALIZED (SELECT mask, {_residual(5)} / v0_0 AS err FROM w, v), s0 AS (SELECT 0 AS mask, 0e0 AS err)"""
for _k in range(1, 5):
    _GFS += f", s{_k} AS MATERIALIZED (SELECT e.mask, e.err FROM e, s{_k - 1} AS p WHERE bit_count(e.mask) = {_k} AND (e.mask & p.mask) = p.mask ORDER BY e.err, e.mask LIMIT 1)"


@query(f"WITH {_GFS} " + union(f"SELECT {k - 1} AS step, 'x' || CAST(bit_count(xor(a.mask, b.mask) - 1) + 1 AS VARCHAR) AS feature, {r('b.err')} AS error FROM s{k - 1} AS a, s{k} AS b" for k in range(1, 5)))
def gfs_rank(spark, d):
    train, val = sites.lineitem(spark, d).halves(F.col("row_id") % 10 == 0)
    return table_of(spark, [(i, x, round(e, 6)) for i, (x, e) in enumerate(ranking.greedy_features(train, val))], "step int, feature string, error double")


@query(f"WITH {em()}, {_pruned(20, 5)} SELECT CAST(row_number() OVER (ORDER BY f.row_id) - 1 AS INT) AS centroid, {', '.join(ES)} FROM f WHERE row_id IN (SELECT row_id FROM kept)")
def prune_centroids(spark, d):
    sf = sites.embeddings(spark, d)
    return table_of(spark, [(i, *map(float, c)) for i, c in enumerate(ranking.prune(_centroids(sf, 20), 5))], "centroid int, " + ", ".join(f"{x} double" for x in ES))


_SC = "s AS (SELECT *, round(e1 + 0.5e0 * e2 - 0.3e0 * e3, 2) AS s FROM f)"


def _scored(spark, d):
    sf = sites.embeddings(spark, d)
    return sf.df.withColumn("s", F.round(F.col("e1") + 0.5 * F.col("e2") - 0.3 * F.col("e3"), 2))


@query(f"WITH {em()}, {_SC}, k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2e0 AS rk FROM s) SELECT {r('(sum(CASE WHEN y = 1 THEN rk END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2e0) / (count_if(y = 1) * count_if(y = 0))')} AS auc FROM k")
def auc_rank(spark, d):
    return rounded(metrics.auc(_scored(spark, d), "s", "y"), "auc")


@query(f"WITH {em()}, {_SC} SELECT {r('avg(CASE WHEN (s >= 0) = (y = 1) THEN 1e0 ELSE 0e0 END)')} AS accuracy FROM s")
def accuracy(spark, d):
    return rounded(metrics.accuracy(_scored(spark, d).withColumn("p", (F.col("s") >= 0).cast("double")), "p", "y"), "accuracy")


@query(f"WITH {em()}, {_SC} SELECT {r('avg((y - s) * (y - s))')} AS mse, {r('1 - sum((y - s) * (y - s)) / (count(*) * var_pop(y))')} AS r2 FROM s")
def r2(spark, d):
    return rounded(metrics.errors(_scored(spark, d), "s", "y"), "mse", "r2")


@query(f"WITH {em()}, {_SC}, o AS (SELECT y, (1 / (1 + exp(-s))) * (1 - 2e-6) + 1e-6 AS o FROM s) SELECT {r('avg(-y * ln(o) - (1 - y) * ln(1 - o))')} AS cross_entropy FROM o")
def cross_entropy(spark, d):
    return rounded(metrics.mean_cross_entropy(_scored(spark, d).withColumn("o", ex.sigmoid(F.col("s"))), "o", "y"), "cross_entropy")


# Data value.


def _halves(spark, d):
    return sites.lineitem(spark, d).halves(F.col("row_id") % 10 == 0)


_RXY = f"{LI}, t AS (SELECT site, {', '.join(f'sum({x} * y) AS {x}' for x in XS)} FROM f WHERE row_id % 10 <> 0 GROUP BY site), v AS (SELECT {', '.join(f'sum({x} * y) AS {x}' for x in XS)} FROM f WHERE row_id % 10 = 0)"


@query(f"WITH {_RXY} SELECT t.site, {r('(' + ' + '.join(f't.{x} * v.{x}' for x in XS) + ') / (sqrt(' + ' + '.join(f't.{x} * t.{x}' for x in XS) + ') * sqrt(' + ' + '.join(f'v.{x} * v.{x}' for x in XS) + '))')} AS alignment FROM t, v")
def task_alignment(spark, d):
    return rounded(value.task_alignment(*_halves(spark, d)), "alignment")


_SPAN = f"""{LI}, t AS (SELECT site, {', '.join(f'sum({x} * (2 * y - 1)) AS {x}' for x in XS)} FROM f WHERE row_id % 10 <> 0 GROUP BY site), m AS (SELECT k AS mask FROM range(1, 16) AS t(k)),
 s AS (SELECT mask, {', '.join(f'sum({x}) AS {x}' for x in XS)} FROM m, t WHERE (mask & (1 << site)) <> 0 GROUP BY mask),
 z AS (SELECT {', '.join(f'sum(CASE WHEN y = 0 THEN -{x} END) AS a_{x}, sum(CASE WHEN y = 1 THEN {x} END) AS b_{x}' for x in XS)} FROM f WHERE row_id % 10 = 0),
 u AS (SELECT {', '.join(f'a_{x} / sqrt({" + ".join(f"a_{q} * a_{q}" for q in XS)}) AS a_{x}, b_{x} / sqrt({" + ".join(f"b_{q} * b_{q}" for q in XS)}) AS b_{x}' for x in XS)} FROM z),
 g AS (SELECT {', '.join(f'k / 1e2 * a_{x} + (1 - k / 1e2) * b_{x} AS {x}' for x in XS)} FROM u, range(0, 101) AS t(k)),
 q AS (SELECT mask, max(({' + '.join(f's.{x} * g.{x}' for x in XS)}) / (sqrt({' + '.join(f's.{x} * s.{x}' for x in XS)}) * sqrt({' + '.join(f'g.{x} * g.{x}' for x in XS)}))) AS utility FROM s, g GROUP BY mask)"""


@query(f"WITH {_SPAN} SELECT mask, {r('utility')} AS utility FROM q")
def rxy_span(spark, d):
    return rounded(value.rxy_span(*_halves(spark, d), 4), "utility")


def _shapley_sql(util):
    w = "(CASE bit_count(CAST(a.mask AS INT)) WHEN 0 THEN 6 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 6 END) / 24e0"
    return f"e AS (SELECT * FROM {util} UNION ALL SELECT 0, 0e0), i AS (SELECT k AS site FROM range(0, 4) AS t(k)), x AS (SELECT CAST(i.site AS INT) AS site, sum({w} * (b.utility - a.utility)) AS score FROM e AS a, i, e AS b WHERE (a.mask & (1 << i.site)) = 0 AND b.mask = a.mask | (1 << i.site) GROUP BY i.site)"


@query(f"WITH {_SPAN}, {_shapley_sql('q')} SELECT site, {r('score')} AS score FROM x")
def shapley(spark, d):
    return rounded(value.shapley(value.rxy_span(*_halves(spark, d), 4), 4), "score")


@query(f"WITH {_SPAN}, {_shapley_sql('q')} SELECT site, {r('greatest(score, 0) / sum(greatest(score, 0)) OVER ()')} AS value FROM x")
def shapley_apriori(spark, d):
    return rounded(value.shares(value.shapley(value.rxy_span(*_halves(spark, d), 4), 4)), "value")


@query("WITH h AS (SELECT CAST(date_part('day', ts) AS INT) AS step, CAST(user_id % 4 AS INT) AS site, sum(value) AS value FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY step) - 1 AS k FROM h)" + f" SELECT site, {r('sum(pow(0.5e0, k) * value) / sum(pow(0.5e0, k))', 4)} AS value FROM k GROUP BY site")
def online_value_decay(spark, d):
    h = sites.table(spark, d, "events").groupBy(F.dayofmonth("ts").alias("step"), sites.site_of(F.col("user_id")).alias("site")).agg(F.sum("value").alias("value"))
    return rounded(value.decayed(h), "value", k=4)


_MASKED = f"""{LI}, g AS ({_products('g', _TX, 'y', 'f', _TRAIN, 'site')}), v AS MATERIALIZED ({_products('v', _TX, 'y', 'f', _VALID)}), gs AS (SELECT mask, {', '.join(f'sum(g{i}_{j}) AS g{i}_{j}' for i in range(6) for j in range(i, 6))} FROM g, (SELECT k AS mask FROM range(1, 16) AS t(k)) WHERE (mask & (1 << site)) <> 0 GROUP BY mask),
 {_subset_sql(5, 'gs', 1e-2, lambda i: "TRUE")}, {_solution('m', 5, 'w', 'mask')}"""


def _greedy_sql(n=4):
    """CTEs s0, s1, …: the best mask of each size that holds the one before, of e (mask, u)."""
    parts = ["s0 AS (SELECT 0 AS mask, 0e0 AS u)"]
    for k in range(1, n + 1):
        parts.append(f"s{k} AS MATERIALIZED (SELECT e.mask, e.u FROM e, s{k - 1} AS p WHERE bit_count(e.mask) = {k} AND (e.mask & p.mask) = p.mask ORDER BY e.u DESC, e.mask LIMIT 1)")
    return ", ".join(parts)


_SITE_OF = "CAST(bit_count(xor(a.mask, b.mask) - 1) AS INT)"
_UTIL = f"e AS MATERIALIZED (SELECT mask, 1 - {_residual(5)} / v5_5 AS u FROM w, v)"


@query(
    f"WITH {_MASKED}, {_UTIL}, {_greedy_sql()}, o AS ("
    + union(f"SELECT {k - 1} AS step, {_SITE_OF} AS site, greatest(b.u - greatest({', '.join(f'(SELECT u FROM s{q})' for q in range(k))}), 0) AS gain FROM s{k - 1} AS a, s{k} AS b" for k in range(1, 5))
    + f") SELECT step, site, {r('gain / (SELECT CASE WHEN sum(gain) = 0 THEN 1 ELSE sum(gain) END FROM o)')} AS gain FROM o"
)
def greedy_sites(spark, d):
    """Sites in the order in which they lower the validation error of a ridge regression most.

    Utilities come from one table of cross products for each site, so the rows are read twice in all.
    """
    train, val = _halves(spark, d)
    own = value.site_matrices(train)
    v = stats.matrix(stats.gram(val, by_site=False), ["1", *XS, "y"])
    utility = lambda chosen: value.ridge_utility(own, v, chosen)
    return table_of(spark, [(i, s, round(float(x), 6)) for i, (s, x) in enumerate(value.greedy_sites(sorted(own), utility))], "step int, site int, gain double")


@query(
    f"WITH {_MASKED}, q AS MATERIALIZED (SELECT mask, 1 - {_residual(5)} / v5_5 AS utility FROM w, v), {_shapley_sql('q')}, y AS (SELECT site, greatest(CASE WHEN max(score) OVER () <= 0 THEN score - 2 * min(score) OVER () ELSE score END, 0) AS s FROM x) SELECT site, {r('s / sum(s) OVER ()')} AS value FROM y"
)
def value_of_products(spark, d):
    return rounded(value.value_of_products(*_halves(spark, d)), "value")


_AUCS = f"""o AS (SELECT mask, y, {_dot(_TX)} AS s FROM f, w WHERE {_VALID}), k AS (SELECT mask, y, rank() OVER (PARTITION BY mask ORDER BY s) + (count(*) OVER (PARTITION BY mask, s) - 1) / 2e0 AS rk FROM o),
 e AS MATERIALIZED (SELECT mask, (sum(CASE WHEN y = 1 THEN rk END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2e0) / (count_if(y = 1) * count_if(y = 0)) AS u FROM k GROUP BY mask)"""


@query(
    f"WITH {_MASKED}, {_AUCS}, {_greedy_sql()}, z AS ("
    + union(f"SELECT {k - 1} AS step, {_SITE_OF} AS site, b.u AS area, greatest(b.u - a.u, 0) AS rise FROM s{k - 1} AS a, s{k} AS b" for k in range(1, 5))
    + f") SELECT step, site, {r('area')} AS area, {r('rise / (SELECT CASE WHEN sum(rise) = 0 THEN 1 ELSE sum(rise) END FROM z)')} AS value FROM z"
)
def posterior_auc(spark, d):
    """Sites in the order in which they raise the area under the curve of a ridge regression most."""
    found = value.greedy_auc(*_halves(spark, d), linear.ridge)
    return table_of(spark, [(i, s, round(a, 6), round(v, 6)) for i, (s, a, v) in enumerate(found)], "step int, site int, area double, value double")


def _online_sql(steps=2, rate="0.5e0"):
    """Each step's gradients by site, weights and errors of all coalitions, Shapley values and shares."""
    parts, weight = [f"w0 AS (SELECT {_ZERO5})"], "(CASE bit_count(CAST(a.mask AS INT)) WHEN 0 THEN 6 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 6 END) / 24e0"
    logistic = f"1e0 / (1e0 + exp(-({_dot(_TX)})))"
    for t in range(steps):
        parts += [
            f"g{t} AS MATERIALIZED (SELECT site, {', '.join(f'avg((s - y) * {x}) AS g{j}' for j, x in enumerate(_TX))} FROM (SELECT f.*, {logistic} AS s FROM f, w{t} AS w WHERE {_TRAIN}) GROUP BY site)",
            f"c{t} AS MATERIALIZED (SELECT mask, {', '.join(f'any_value(w.w{j}) - {rate} * coalesce(avg(g{j}), 0) AS w{j}' for j in range(5))} FROM w{t} AS w, (SELECT k AS mask FROM range(0, 16) AS t(k)) LEFT JOIN g{t} ON (mask & (1 << site)) <> 0 GROUP BY mask)",
            f"e{t} AS MATERIALIZED (SELECT mask, avg(-y * ln(o) - (1 - y) * ln(1 - o)) AS err FROM (SELECT mask, y, ({logistic}) * (1 - 2e-6) + 1e-6 AS o FROM f, c{t} AS w WHERE {_VALID}) GROUP BY mask)",
            f"u{t} AS MATERIALIZED (SELECT mask, (SELECT err FROM e{t} WHERE mask = 0) - err AS utility FROM e{t})",
            f"x{t} AS (SELECT CAST(i AS INT) AS site, sum({weight} * (b.utility - a.utility)) AS score FROM u{t} AS a, range(0, 4) AS n(i), u{t} AS b WHERE (a.mask & (1 << i)) = 0 AND b.mask = a.mask | (1 << i) GROUP BY i)",
            f"y{t} AS (SELECT site, greatest(CASE WHEN max(score) OVER () <= 0 THEN score - 2 * min(score) OVER () ELSE score END, 0) AS s FROM x{t})",
            f"w{t + 1} AS MATERIALIZED (SELECT w0, w1, w2, w3, w4 FROM c{t} WHERE mask = 15)",
        ]
    return f"WITH {LI}, {', '.join(parts)} " + union(f"SELECT {t} AS step, site, {r('s / sum(s) OVER ()', 5)} AS value FROM y{t}" for t in range(steps))


@query(_online_sql())
def online_value(spark, d):
    history, _ = value.online(*_halves(spark, d), steps=2)
    return rounded(history, "value", k=5)


# Aggregators of models.

_SW = f"{LI}, g AS (SELECT site, count(*) + 0.01e0 AS a, sum(x1) AS b, sum(x1 * x1) + 0.01e0 AS c, sum(y) AS u, sum(x1 * y) AS v FROM f GROUP BY site), w AS (SELECT site, 0 AS pos, (u * c - b * v) / (a * c - b * b) AS w FROM g UNION ALL SELECT site, 1, (a * v - b * u) / (a * c - b * b) FROM g)"


def _site_weights(spark, d):
    """A ridge regression of each site on one feature, solved as expressions."""
    sf = preprocess.select(sites.lineitem(spark, d), [0])
    s = sf.df.groupBy("site").agg((F.count("*") + 0.01).alias("a"), F.sum("x1").alias("b"), (F.sum(F.col("x1") * F.col("x1")) + 0.01).alias("c"), F.sum("y").alias("u"), F.sum(F.col("x1") * F.col("y")).alias("v"))
    det = "(a * c - b * b)"
    return s.select("site", F.lit("").alias("class"), F.posexplode(F.array(F.expr(f"(u * c - b * v) / {det}"), F.expr(f"(a * v - b * u) / {det}"))).alias("pos", "w"))


@query(f"WITH {_SW} SELECT '' AS class, pos, {r('avg(w)')} AS w FROM w GROUP BY pos")
def model_average(spark, d):
    return rounded(networks.averaged(_site_weights(spark, d)), "w")


@query(f"WITH {_SW} SELECT '' AS class, pos, {r('quantile_cont(w, 0.5)')} AS w FROM w GROUP BY pos")
def model_median(spark, d):
    return rounded(networks.averaged(_site_weights(spark, d), "median"), "w")


@query(_descent_sql("sigmoid", 2, 0.5 * 4) + _weights_sql(5, 2))
def lc_site_sum(spark, d):
    """Two steps along the summed gradients of the four sites."""
    return _weights(spark, linear.descend(sites.lineitem(spark, d), "sigmoid", steps=2, rate=0.5, combine="site_sum"))


@query(_descent_sql("sigmoid", 2, 0.5, 0.9) + _weights_sql(5, 2))
def server_sgd(spark, d):
    """Two steps of the server's gradient descent with momentum, written out with server_step."""
    sf = sites.lineitem(spark, d)
    w, acc = np.zeros(5), np.zeros(5)
    for _ in range(2):
        row = linear.combined(linear.gradients(sf, {"": w}, ex.sigmoid)).first()
        w, acc = networks.server_step(w, np.array(list(row)), acc, 0.5, 0.9)
    return _weights(spark, linear.Linear({"": w}, XS))


_NET = networks.Network((64, 3, 1)).w


def _nn_forward(w=lambda i: f"w.w{i}", x=lambda i: f"f.e{i + 1}"):
    """The hidden layer and the output of the network as columns of a row and its weights."""
    h = [f"tanh({' + '.join(f'{x(i)} * {w(3 * i + j)}' for i in range(64))} + {w(192 + j)})" for j in range(3)]
    return h, lambda hs: f"1e0 / (1e0 + exp(-({' + '.join(f'{a} * {w(195 + j)}' for j, a in enumerate(hs))} + {w(198)})))"


def _nn_sql(rounds=2, epochs=2, rate="0.5e0"):
    """The weights of each way of training, step by step: weights as (site, pos, w), rows as (row_id, site, i, v)."""
    literal = ", ".join(f"{float(v)!r}{'' if 'e' in repr(float(v)) else 'e0'}" for v in _NET)
    parts = [
        f"l AS MATERIALIZED (SELECT row_id, site, unnest(range(0, 64)) AS i, unnest([{', '.join(ES)}]) AS v FROM f)",
        f"i0 AS MATERIALIZED (SELECT site, pos, w FROM (SELECT unnest(range(0, {len(_NET)})) AS pos, unnest([{literal}]) AS w), (SELECT CAST(s AS INT) AS site FROM range(0, 4) AS t(s)))",
    ]

    def stepped(cur, name, only="", mean=False):
        """The CTEs of a step from the weights of cur; mean: all sites take the mean gradient."""
        m = "MATERIALIZED"
        parts.append(f"{name}_h AS {m} (SELECT z.row_id, z.site, z.j, tanh(z.z + b.w) AS h FROM (SELECT l.row_id, l.site, w.pos % 3 AS j, sum(l.v * w.w) AS z FROM l JOIN {cur} AS w ON w.site = l.site AND w.pos // 3 = l.i AND w.pos < 192{only} GROUP BY ALL) AS z JOIN {cur} AS b ON b.site = z.site AND b.pos = 192 + z.j)")
        parts.append(f"{name}_d AS {m} (SELECT h.row_id, h.site, 1e0 / (1e0 + exp(-(sum(h.h * v.w) + any_value(c.w)))) - any_value(f.y) AS d FROM {name}_h AS h JOIN {cur} AS v ON v.site = h.site AND v.pos = 195 + h.j JOIN {cur} AS c ON c.site = h.site AND c.pos = 198 JOIN f ON f.row_id = h.row_id GROUP BY h.row_id, h.site)")
        parts.append(f"{name}_q AS {m} (SELECT h.row_id, h.site, h.j, h.h, d.d, d.d * v.w * (1 - h.h * h.h) AS q FROM {name}_h AS h JOIN {name}_d AS d ON d.row_id = h.row_id JOIN {cur} AS v ON v.site = h.site AND v.pos = 195 + h.j)")
        grads = union((
            f"SELECT l.site, 3 * l.i + q.j AS pos, avg(q.q * l.v) AS g FROM l JOIN {name}_q AS q ON q.row_id = l.row_id GROUP BY ALL", f"SELECT site, 192 + j AS pos, avg(q) AS g FROM {name}_q GROUP BY ALL",
            f"SELECT site, 195 + j AS pos, avg(d * h) AS g FROM {name}_q GROUP BY ALL", f"SELECT site, 198 AS pos, avg(d) AS g FROM {name}_d GROUP BY ALL",
        ))
        g = "avg(g.g) OVER (PARTITION BY g.pos)" if mean else "g.g"
        parts.append(f"{name} AS {m} (SELECT w.site, w.pos, w.w - {rate} * {g} AS w FROM {cur} AS w JOIN ({grads}) AS g ON g.site = w.site AND g.pos = w.pos)")
        return name

    last = {}
    for how in ("mean_weights", "median_weights", "mean_gradients", "sequential"):
        cur = "i0"
        for t in range(rounds):
            if how == "mean_gradients":
                cur = stepped(cur, f"{how}_{t}", mean=True)
                continue
            for group in range(4) if how == "sequential" else ("",):
                for e in range(epochs):
                    cur = stepped(cur, f"{how}_{t}{group}_{e}", f" AND l.site = {group}" if group != "" else "")
                name = f"{how}_{t}{group}"
                f_ = "quantile_cont(w, 0.5)" if how == "median_weights" else "avg(w)"
                parts.append(f"{name} AS MATERIALIZED (SELECT CAST(s AS INT) AS site, pos, w FROM (SELECT pos, {f_} AS w FROM {cur} GROUP BY pos), range(0, 4) AS t(s))")
                cur = name
        last[how] = cur
    rows = union(f"SELECT '{how}' AS how, CAST(pos AS INT) AS pos, {r('w')} AS w FROM {cur} WHERE site = 0" for how, cur in last.items())
    return f"WITH {em()}, {', '.join(parts)} {rows}"


@query(_nn_sql())
def nn_average(spark, d):
    rows = []
    for how in ("mean_weights", "median_weights", "mean_gradients", "sequential"):
        net = networks.train(sites.embeddings(spark, d), networks.Network((64, 3, 1)), how, rounds=2, epochs=2, rate=0.5)
        rows += [(how, i, round(float(w), 6) + 0.0) for i, w in enumerate(net.w)]
    return table_of(spark, rows, "how string, pos int, w double")


_NH, _NO = _nn_forward(lambda i: f"({float(_NET[i])!r}{'' if 'e' in repr(float(_NET[i])) else 'e0'})")


@query(f"WITH {em()}, h AS (SELECT row_id, {', '.join(f'{a} AS h{j}' for j, a in enumerate(_NH))} FROM f) SELECT row_id, {r(_NO(['h0', 'h1', 'h2']))} AS score FROM h")
def nn_predict(spark, d):
    sf = sites.embeddings(spark, d)
    return rounded(networks.predict(sf, networks.Network((64, 3, 1))), "score").select("row_id", "score")
