"""Operators against NumPy on small tables: edge cases, invariants and training loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsite.functions import expressions as ex
from quillsite.operators import images, kernels, kmeans, linear, linkage, metrics, networks, preprocess, ranking, stats, text, value
from quillsite.sources import sites
from quillsite.sources.sites import SiteFrame


def frame(spark, x, y=None, site=None, names=None):
    x = np.asarray(x, float)
    names = names or [f"x{i + 1}" for i in range(x.shape[1])]
    y = np.zeros(len(x)) if y is None else y
    site = np.zeros(len(x), int) if site is None else site
    rows = [(int(s), i, *(None if np.isnan(v) else float(v) for v in r), float(t)) for i, (s, r, t) in enumerate(zip(site, x, y))]
    return SiteFrame(spark.createDataFrame(rows, "site int, row_id bigint, " + ", ".join(f"{n} double" for n in names) + ", y double"), tuple(names))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3))
    y = (x @ [1.5, -2.0, 0.3] + 0.2 > 0).astype(float)
    return x, y, np.arange(120) % 4


def values(sf, *names):
    return np.array([list(r) for r in sf.df.orderBy(sf.id).select(*(names or sf.features)).collect()], float)


def test_gram_is_the_same_however_rows_are_split(spark, data):
    x, y, s = data
    a = np.c_[np.ones(120), x, y]
    for sf in (frame(spark, x, y, s), frame(spark, x, y, s // 2)):
        for df in (sf.df, sf.df.repartition(7)):
            assert np.allclose(stats.matrix(stats.gram(sf.having(df), by_site=False), ["1", *sf.features, "y"]), a.T @ a)


def test_wide_gram_equals_narrow(spark, data, monkeypatch):
    x, y, s = data
    sf = frame(spark, x, y, s)
    narrow = {(r["site"], r["a"], r["b"]): r["value"] for r in stats.gram(sf).collect()}
    monkeypatch.setattr(stats, "WIDE", 2)
    wide = {(r["site"], r["a"], r["b"]): r["value"] for r in stats.gram(sf).collect()}
    assert wide.keys() == narrow.keys() and all(np.isclose(wide[k], narrow[k]) for k in wide)


def test_scaling_leaves_constant_and_kept_columns(spark):
    sf = frame(spark, [[1, 5, 0], [2, 5, 1], [3, 5, 1]])
    out = values(preprocess.standardise(sf, keep=("x3",)))
    assert np.allclose(out[:, 0], [-(1.5**0.5), 0, 1.5**0.5]) and (out[:, 1] == 5).all() and list(out[:, 2]) == [0, 1, 1]
    assert np.allclose(values(preprocess.min_max(sf)), [[0, 0, 0], [0.5, 0, 1], [1, 0, 1]])


def test_missing_values(spark):
    sf = frame(spark, [[1, np.nan], [3, 4], [np.nan, 6], [10, np.nan]], site=[0, 0, 0, 1])
    assert np.allclose(values(preprocess.impute(sf)), [[1, 5], [3, 4], [2, 6], [10, np.nan]], equal_nan=True)
    assert [r["n"] for r in stats.feature_counts(sf).orderBy("feature").collect()] == [3, 2]
    logs = values(preprocess.log_scale(frame(spark, [[-3.0], [0.0], [np.nan]])))
    assert np.allclose(logs, [[-np.log(4)], [0], [np.nan]], equal_nan=True)


def test_clip_is_by_site(spark):
    x = [[0.0]] * 9 + [[100.0]] + [[5.0]]
    out = values(preprocess.clip(frame(spark, x, site=[0] * 10 + [1]), 2.0))
    assert np.isclose(out[9, 0], 10 + 2 * 30) and out[10, 0] == 5


def test_one_hot_sorts_and_rejects(spark):
    df = spark.createDataFrame([(1, "b"), (2, ""), (3, None), (4, "a")], "i int, c string")
    out = preprocess.one_hot(df, "c", ["b", "a"]).orderBy("i").collect()
    assert [tuple(r) for r in out] == [(1, 0.0, 1.0), (2, None, None), (3, None, None), (4, 1.0, 0.0)]
    with pytest.raises(Exception, match="unknown category"):
        preprocess.one_hot(df, "c", ["a"]).collect()
    assert [r[0] for r in df.select(preprocess.numeric(F.lit(""))).distinct().collect()] == [None]


def test_data_check_counts(spark):
    df = spark.createDataFrame([(0, "1", 1.0, "u"), (0, "x", 2.0, "w"), (0, "", None, None), (1, "3", 0.0, "u")], "site int, n string, b double, c string")
    found = {(r["site"], r["column"]): r["n_bad"] for r in preprocess.data_check(df, {"n": ("num",), "b": ("bin",), "c": ("cat", ["u", "v"])}).collect()}
    assert found == {(0, "n"): 1, (0, "b"): 1, (0, "c"): 1, (1, "n"): 0, (1, "b"): 0, (1, "c"): 0}


def test_projections_and_pca(spark, data):
    x, y, s = data
    sf = frame(spark, x, y, s)
    for m in (preprocess.random_matrix(3, 2, 1), preprocess.random_matrix(3, 2, 1, sparse=True), preprocess.bucket_matrix(3, 2)):
        assert np.allclose(values(preprocess.project(sf, m)), x @ m)
    assert (preprocess.bucket_matrix(7, 3).sum(axis=1) == 1).all()
    p = preprocess.pca_matrix(sf, 2)
    v = np.linalg.svd(x.T @ x / len(x))[0][:, :2]
    assert np.allclose(np.abs(p), np.abs(v)) and (p[np.abs(p).argmax(axis=0), [0, 1]] > 0).all()


def test_vocabulary_bounds_are_strict(spark):
    rows = [(0, i % n, w) for w, n, k in (("ten", 10, 10), ("eleven", 11, 11), ("few", 2, 30)) for i in range(k)]
    t = spark.createDataFrame(rows, "site int, doc_id int, token string")
    vocab = text.vocabulary(t)
    assert {r["token"] for r in vocab.collect()} == {"eleven", "few"}
    df = text.document_frequency(t, vocab)
    assert {(r["token"], r["df"]) for r in df.collect()} == {("eleven", 11)}
    dense = text.tf_idf_dense(t, df).filter("doc_id = 0").first()
    assert np.allclose(dense["vector"], [1 / 11])


def test_linkage_with_repeated_and_missing_ids(spark):
    a = spark.createDataFrame([(1, "p", 0), (1, "q", 1), (2, "r", 2)], "id int, x string, o int")
    b = spark.createDataFrame([(2, "s", 0), (3, "t", 1)], "id int, x string, o int")
    ids = linkage.hash_ids({0: a, 1: b}, "id")
    assert linkage.link(ids, 2).count() == 1 and linkage.link(ids, 2, "join").count() == 3
    out = {r["x"] for r in linkage.align(linkage.link(ids, 2, "join"), a, "id", "o", missing="").collect()}
    assert out == {"p", "r", ""}
    row = linkage.vertical_concat(linkage.link(ids, 2), {0: (a, "id", "o"), 1: (b, "id", "o")}).first()
    assert (row["s0_x"], row["s1_x"]) == ("r", "s")


def test_kmeans_ties_small_clusters_and_descent(spark, data):
    x, y, s = data
    sf = frame(spark, [[0.0], [2.0]])
    assert [r["cluster"] for r in kmeans.assign(sf, [[1.0], [1.0]]).collect()] == [0, 0]
    small = frame(spark, [[0], [0], [0], [9], [9]])
    assert [r["cluster"] for r in kmeans.step(small, [[0.0], [9.0]], 3).collect()] == [0]
    c, seen = kmeans.fit(frame(spark, x, y, s), 3, iterations=6, tolerance=0)
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert len(seen) == 6 and seen[-1] <= seen[0] + 1e-9 and np.bincount(d.argmin(1), minlength=3).min() > 0
    moved = kmeans.relocated(np.array([[0.0], [5.0]]), np.array([0, 100]))
    assert abs(moved[0, 0] - 5) < 0.1 and moved[1, 0] == 5


def test_sharding_divides_the_rest_by_the_floor(spark):
    out = kmeans.naive_sharding(frame(spark, [[1], [2], [3], [4], [5]]), 2).orderBy("shard").collect()
    assert [r["value"] for r in out] == [1.5, 6.0]


def test_linear_models(spark, data):
    x, y, s = data
    sf = frame(spark, x, y, s)
    a = np.c_[np.ones(120), x]
    assert np.allclose(linear.ridge(sf, 0.1).weights[""], np.linalg.solve(a.T @ a + 0.1 * np.eye(4), a.T @ y))
    w = np.zeros(4)
    for _ in range(3):
        g = np.mean([(a[s == k].T @ (a[s == k] @ w - y[s == k])) / (s == k).sum() for k in range(4)], axis=0)
        w = w - 0.1 * g
    assert np.allclose(linear.descend(sf, steps=3, stop=0).weights[""], w)
    model = linear.descend(sf, "sigmoid", steps=15, combine="rows", validation=sf)
    out = model.predict(sf.df)
    assert metrics.accuracy(out.withColumn("p", (F.col("score") > 0.5).cast("double")), "p", "y").first()[0] > 0.95
    assert metrics.auc(out, "score", "y").first()[0] > 0.98
    again = model.predict_with(sf.df, [-model.weights[""]]).select("score").distinct().collect()
    assert [r[0] for r in again] == [0.5]


def test_multiclass_prefers_the_first_of_equals(spark, data):
    x, y, s = data
    sf = frame(spark, x, y, s)
    model = linear.Linear({"a": np.zeros(4), "b": np.zeros(4)}, sf.features, "sigmoid")
    assert {r["score"] for r in model.predict(sf.df).collect()} == {"a"}


def test_kernel_machines_learn(spark, data):
    x, y, s = data
    sf = frame(spark, x, y, s)
    c, sigma = ranking.prune(x[:20], 8), kernels.width(3)
    t = 2 * y - 1

    def accuracy(model):
        p = np.array([r["p"] for r in model.predict(sf, "p", hard=True).orderBy("row_id").collect()])
        return (p == t).mean()

    assert accuracy(kernels.budget_svm(sf, c, sigma, steps=5)) > 0.9
    assert accuracy(kernels.federated_svm(sf, c, sigma, rounds=2, epochs=2)) > 0.85
    assert accuracy(kernels.federated_svm(sf, c, sigma, rounds=1, epochs=2, sequential=True)) > 0.85
    train, val = sf.halves(F.col("row_id") % 5 == 0)
    assert accuracy(kernels.budget_svm(train, c, sigma, steps=3, validation=val, search=True)) > 0.85
    assert accuracy(kernels.svm(sf, c, sigma, steps=20, rate=0.02, combine="sum")) > 0.8
    errors = metrics.errors(kernels.regress(sf, c, sigma).predict(sf), "score", "y").first()
    assert errors["mse"] < 0.12


def test_irwls_weight_bounds(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.01,), (2.0,)], "e double")
    got = [r[0] for r in df.select(kernels.irwls_weight(F.col("e"), 1.0, 0.01)).collect()]
    assert np.allclose(got, [0, 200, 200, 1])


def test_greedy_features_find_the_signal(spark, data):
    x, y, s = data
    train, val = frame(spark, x, y, s).halves(F.col("row_id") % 3 == 0)
    order = [f for f, _ in ranking.greedy_features(train, val)]
    assert order[0] == "x2" and set(order) == {"x1", "x2", "x3"}


def test_merged_and_pruned_centroids():
    c = np.array([[0.0], [0.1], [5.0]])
    assert ranking.prune(c, 2).tolist() == [[0.0], [5.0]] and sorted(map(tuple, ranking.merged(c, 2))) == [(0.05,), (5.0,)]


def test_shapley_is_efficient_and_shares_add_up(spark):
    u = spark.createDataFrame([(1, 0.5), (2, 0.2), (3, 0.9)], "mask bigint, utility double")
    s = {r["site"]: r["score"] for r in value.shapley(u, 2, empty=0.1).collect()}
    assert np.isclose(sum(s.values()), 0.8) and np.isclose(s[0], 0.5 * (0.4 + 0.7))
    bad = spark.createDataFrame([(0, -0.1), (1, -0.3)], "site int, score double")
    assert {r["value"] for r in value.shares(bad).collect()} == {0.0}
    assert np.isclose(sum(r["value"] for r in value.shares(bad, shift=True).collect()), 1)
    with pytest.raises(ValueError, match="coalitions"):
        value.coalitions(spark, 13)


def test_decay_order(spark):
    h = spark.createDataFrame([(1, 0, 4.0), (2, 0, 1.0)], "step int, site int, value double")
    assert np.isclose(value.decayed(h).first()["value"], 4.5 / 1.5)
    assert np.isclose(value.decayed(h, newest_first=True).first()["value"], 3 / 1.5)


def test_networks_lower_the_loss(spark, data):
    x, y, s = data
    for how in ("mean_weights", "mean_gradients", "sequential"):
        sf, net = frame(spark, x, y, s), networks.Network((3, 4, 1), seed=1)
        loss = lambda: -np.mean(np.log(np.where(y == 1, o := net.forward(x)[-1][:, 0], 1 - o)))  # noqa: E731, B023
        before = loss()
        networks.train(sf, net, how, rounds=3, epochs=2, rate=0.5)
        assert loss() < before
    g, net = np.zeros(21), networks.Network((3, 4, 1), seed=2)
    eps = 1e-6
    for i in range(len(net.w)):
        step = np.eye(len(net.w))[i] * eps
        f = lambda w: -np.sum(np.log(np.where(y[:, None] == 1, o := net.forward(x, w)[-1], 1 - o)))
        g[i] = (f(net.w + step) - f(net.w - step)) / (2 * eps)
    assert np.allclose(g, net.gradient(x, y[:, None], net.w), atol=1e-3)


def test_sampling_sizes(spark, data):
    x, y, s = data
    sf = frame(spark, x, y, s)
    assert {r["count"] for r in preprocess.minibatch(sf, 0.25).df.groupBy("site").count().collect()} == {7}
    seen = {r["row_id"] for i in range(3) for r in preprocess.cyclic_batch(sf, 10, i).df.collect()}
    assert len(seen) == 120


def test_images_and_digests(spark):
    df = spark.createDataFrame([(list(map(float, range(16))),)], "v array<double>")
    small = df.select(images.to_vector(images.resize(images.as_matrix(F.col("v"), 4, 4), 4, 4, 2, 2))).first()[0]
    assert small == [5.0, 7.0, 13.0, 15.0]
    import hashlib

    got = df.select(*(ex.digest(F.lit("a"), h) for h in ("md5", "sha256", "sha3_512"))).first()
    assert list(got) == [hashlib.new(h, b"a").hexdigest() for h in ("md5", "sha256", "sha3_512")]


def test_model_tables_and_unions(spark, tmp_path):
    sites.save_model(spark, "m", {"a": [1.0, 2.0], "b": [3.0]}, str(tmp_path / "m"))
    assert sites.load_model(spark, str(tmp_path / "m")) == {"a": [1.0, 2.0], "b": [3.0]}
    one = spark.createDataFrame([(1.0,)], "x double")
    assert {r["site"] for r in sites.union_sites({3: one, 5: one}).collect()} == {3, 5}
    with pytest.raises(ValueError, match="no sites"):
        sites.union_sites({})


def test_streamed_sums_equal_batch_sums(spark, data, tmp_path):
    from quillsite.streaming import sums

    x, y, s = data
    sf = frame(spark, x, y, s)
    sf.df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = sf.having(spark.readStream.schema(sf.df.schema).parquet(str(tmp_path / "in")))
    sums.keep(sums.running_gram(stream), "running", str(tmp_path / "state")).awaitTermination(120)
    key = lambda r: (r["site"], r["a"], r["b"])
    a, b = ({key(r): r["value"] for r in df.collect()} for df in (spark.table("running"), stats.gram(sf)))
    assert a.keys() == b.keys() and all(np.isclose(a[k], b[k]) for k in a)
    with pytest.raises(ValueError, match="stream"):
        sums.running_gram(sf)
