"""Modes, hooks and stored models, and the plans that avoid sorting a site in one task, against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillsite.api import Federation
from quillsite.operators import images, kernels, kmeans, linear, metrics, networks, preprocess, stats, value
from quillsite.sources import sites
from quillsite.sources.sites import SiteFrame


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    for i in range(400):
        site = 0 if i < 300 else 1 if i < 399 else 2
        out.append((site, i * 7 - 50, float(np.round(rng.exponential(), 1)), 1.5, None if i % 5 else float(i), float(i % 3 == 0), "abc"[i % 3]))
    return out


@pytest.fixture(scope="module")
def sf(spark, rows):
    return SiteFrame(spark.createDataFrame(rows, "site int, row_id bigint, x1 double, x2 double, x3 double, y double, class string"), ("x1", "x2", "x3"))


def by_site(rows, k):
    out: dict = {}
    for r in rows:
        if r[k] is not None:
            out.setdefault(r[0], []).append(r[k])
    return out


@pytest.mark.parametrize("bins", [1, 3, 4096])
def test_quantiles(monkeypatch, sf, rows, bins):
    monkeypatch.setattr(stats, "BINS", bins)
    got = {(r["site"], r["feature"], r["share"]): r["value"] for r in stats.quantiles(sf, (0.0, 0.25, 0.5, 1.0)).collect()}
    want = {(s, f"x{k - 1}", q): np.quantile(v, q) for k in (2, 3, 4) for s, v in by_site(rows, k).items() for q in (0.0, 0.25, 0.5, 1.0)}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_statistics_have_every_site(sf):
    got = {(r["site"], r["stat"], r["pos"]): r["value"] for r in stats.site_statistics(sf).collect()}
    assert len(got) == 3 * (8 * 3 + 1 + 4) and got[2, "medianx", 2] is None and got[2, "medianx", 1] == 1.5


def test_minibatch_takes_the_least_hashes(sf, rows):
    hash_ = lambda i: ((i * 1103515245 + 12345 + 3 * 7919) % 2147483648) / 2147483648.0
    for share in (0.0, 0.004, 0.3, 0.999, 1.0):
        got = {r["row_id"] for r in preprocess.minibatch(sf, share, 3).df.collect()}
        want = set()
        for ids in by_site(rows, 1).values():
            want |= set(sorted(ids, key=lambda i: (hash_(i), i))[: int(share * len(ids))])
        assert got == want
    assert preprocess.minibatch(sf, 0.3).df.columns == sf.df.columns


def test_minibatch_ends_within_equal_ids(spark):
    hash_ = lambda r: 1.0 if r[1] is None else (r[1] * 1103515245 + 12345) % 2147483648 / 2147483648.0
    # Ids thrice, of which two rows are the same; a site of one id; a site without a name; rows without an id.
    rows = [(s, i, float(k // 2)) for s in (0, None) for i in range(200) for k in range(3)] + [(1, 7, float(k % 5)) for k in range(50)] + [(2, None, float(k)) for k in range(9)] + [(2, 3, 0.0)]
    sf = SiteFrame(spark.createDataFrame(rows, "site int, row_id bigint, x1 double").repartition(5), ("x1",), target=None)
    for share in (0.05, 0.1, 0.101, 0.25, 0.502, 0.9):
        got = [tuple(r) for r in preprocess.minibatch(sf, share).df.collect()]
        assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in preprocess.minibatch(sf.having(sf.df.repartition(3)), share).df.collect())
        for site in (0, None, 1, 2):
            own = [r for r in rows if r[0] == site]
            want = sorted(own, key=hash_)[: int(share * len(own))]
            assert [r[1] for r in sorted((r for r in got if r[0] == site), key=hash_)] == [r[1] for r in want]
            assert all(got.count(r) <= rows.count(r) for r in got)


def test_cyclic_batch_goes_round(sf, rows):
    for size, step in ((70, 0), (70, 4), (70, 13), (500, 1)):
        got = {r["row_id"] for r in preprocess.cyclic_batch(sf, size, step).df.collect()}
        want = set()
        for ids in by_site(rows, 1).values():
            ids = sorted(ids)
            want |= {ids[(step * size + k) % len(ids)] for k in range(min(size, len(ids)))}
        assert got == want


def test_naive_sharding_with_ties_and_rests(sf, rows):
    got = {(r["site"], r["shard"], r["feature"]): r["value"] for r in kmeans.naive_sharding(SiteFrame(sf.df, ("x1", "x2")), 7).collect()}
    for k in (2, 3):
        for s, v in by_site(rows, k).items():
            v, size = sorted(v), len(v) // 7
            for j in range(7):
                run = v[j * size : None if j == 6 else (j + 1) * size]
                assert got[s, j, f"x{k - 1}"] is None if size == 0 else np.isclose(got[s, j, f"x{k - 1}"], sum(run) / size)


def area(s, y):
    rank = pd.Series(s).rank()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_area_in_ranges(spark, monkeypatch, sf, rows):
    s, y = np.array([r[2] for r in rows]), np.array([r[5] for r in rows])
    for size in (2, 10, 1_000_000):
        monkeypatch.setattr(metrics, "RANGE", size)
        assert np.isclose(metrics.auc(sf.df, "x1", "y").first()[0], area(s, y))
    monkeypatch.setattr(metrics, "RANGE", 3)
    got = {r["class"]: r["auc"] for r in metrics.auc(sf.df.withColumn("z", F.pmod("row_id", F.lit(2)).cast("double")), "x1", "z", ["class"]).collect()}
    for c in "abc":
        own = [r for r in rows if r[6] == c]
        assert np.isclose(got[c], area([r[2] for r in own], np.array([r[1] % 2 for r in own])))


def test_cut_by_counts_cuts(spark):
    df = spark.range(40).select((F.col("id") / 2.0).alias("v"))
    got = df.withColumn("c", metrics.cut_by(F.col("v"), [1.0, 2.5, 7.0, 11.0, 19.0])).collect()
    assert all(r["c"] == sum(x <= r["v"] for x in (1.0, 2.5, 7.0, 11.0, 19.0)) for r in got)


@pytest.mark.parametrize("bins", [4, 8192])
def test_best_blend_is_that_of_all(spark, monkeypatch, bins):
    monkeypatch.setattr(kernels, "BINS", bins)
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(120, 2)), np.array([[0.0, 0.5], [1.0, -1.0], [-1.0, 0.3]])
    y = (x[:, 0] + rng.normal(size=120) > 0).astype(float)
    val = SiteFrame(spark.createDataFrame([(0, i, *map(float, x[i]), float(y[i])) for i in range(120)], "site int, row_id bigint, x1 double, x2 double, y double"), ("x1", "x2"))
    old, new = rng.normal(size=4), rng.normal(size=4)
    k = np.concatenate([np.ones((120, 1)), np.exp(-((x[:, None] - c) ** 2).sum(-1) / 2)], axis=1)
    areas = {j: area((1 - j / 100) * (k @ old) + j / 100 * (k @ new), y) for j in range(-100, 200)}
    assert areas[round(kernels.best_blend(val, c, 1.0, old, new) * 100)] == pytest.approx(max(areas.values()))


def test_models_are_stored_whole(spark, sf, tmp_path):
    two = SiteFrame(sf.df, ("x1", "x2"))
    c = np.array([[0.1, 1.5], [2.0, 1.5]])
    model = linear.descend(two, "sigmoid", classes=["a", "b", "c"], steps=2)
    kernel = kernels.budget_svm(two, c, 1.2, steps=1, classes=["a", "b"])
    net = networks.Network((2, 3, 2), "softmax", seed=4)
    scaled = {"x1": [1.0, 2.0]}
    for kind, thing in (("m", model), ("k", kernel), ("n", net)):
        path = str(tmp_path / kind)
        thing.save(spark, path)
        back = type(thing).load(spark, path)
        if kind == "n":
            assert np.array_equal(back.w, net.w) and back.sizes == net.sizes and back.out == "softmax"
        else:
            assert back.weights.keys() == thing.weights.keys() and all(np.array_equal(back.weights[x], thing.weights[x]) for x in thing.weights)
    assert np.array_equal(kernels.Kernel.load(spark, str(tmp_path / "k")).centroids, c)
    sites.save_parts(spark, "scaler", {"facts": scaled, "none": np.zeros((0, 2))}, str(tmp_path / "s"))
    kind, parts = sites.load_parts(spark, str(tmp_path / "s"))
    assert kind == "scaler" and parts["facts"] == scaled and parts["none"].shape == (0, 2)
    soft = kernel.predict_soft(two).first()["scores"]
    hard = kernel.predict(two, "p").first()["p"]
    assert set(soft) == {"a", "b"} and hard == max(soft, key=soft.get)


def test_modes_have_their_own_rules(sf):
    two = SiteFrame(sf.df, ("x1", "x2"))
    f = Federation(*two.halves(F.col("row_id") % 4 == 0))
    far = np.array([[0.0, 1.5], [2.0, 1.5], [1e6, 1e6]])
    third, first = (f.fit("Kmeans", mode, k=3, iterations=1, start=far)[0] for mode in (3, 1))
    assert np.allclose(third[:2], first[:2]) and (third[2] == 0).all() and (first[2] == 1e6).all()
    assert not np.allclose(f.fit("Kmeans", 6, k=2, iterations=1)[0], f.fit("Kmeans", 6, k=2, iterations=1, seed=9)[0])
    kernel = {"centroids": far[:2], "sigma": 1.0, "steps": 1}
    assert not np.allclose(f.fit("BSVM", 4, **kernel).weights[""], f.fit("BSVM", 6, **kernel).weights[""])
    assert not np.allclose(f.fit("KR", 5, **kernel).weights[""], Federation(f.train).fit("KR", 5, **kernel).weights[""])
    w = [f.fit("LC", 5, steps=1, balance=b).weights[""] for b in (None, "y")] + [f.fit("LR", 5, steps=2, minibatch=0.5, stop=0.0).weights[""]]
    assert not np.allclose(w[0], w[1]) and not np.allclose(w[2], f.fit("LR", 5, steps=2, stop=0.0).weights[""])
    assert f.fit("BSVM", 6, balance="y", **kernel).weights[""].shape == (3,)
    with pytest.raises(TypeError):
        f.fit("LR", 5, stpes=3)


def test_hooks(spark, sf):
    two = SiteFrame(sf.df.filter("site < 2"), ("x1", "x2"))
    net = networks.train(two, networks.Network((2, 1)), rounds=1, process=lambda w, x, y: w * 0 + len(x))
    assert np.allclose(net.w, (300 + 99) / 2)
    out = networks.train(two, networks.Network((2, 3, 2)), rounds=1, epochs=1, targets=("y", "x1"), minibatch=0.5)
    assert len(networks.predict(two, out, "s", every=True).first()["s"]) == 2
    flat = lambda train, val, n: spark.createDataFrame([(m, float(bin(m).count("1"))) for m in range(1, 1 << n)], "mask bigint, utility double")
    f = Federation(*two.halves(F.col("row_id") % 4 == 0))
    assert {r["value"] for r in f.prior_value(2, flat).collect()} == {0.5}
    found = f.posterior_auc("LC", 5, steps=2)
    assert sorted(s for s, *_ in found) == [0, 1] and np.isclose(sum(v for *_, v in found), 1)
    for df in (f.value_of_products(), value.value_of_models(f.validation, {0: np.array([0.0, -1, 0]), 1: np.array([0.5, 1, 0])}, np.zeros(3))):
        assert np.isclose(sum(r["value"] for r in df.collect()), 1) and df.count() == 2


def test_schema_of_categories(sf):
    out = preprocess.one_hot_all(sf.having(sf.df.withColumn("b", F.lit("u")), ("x1", "class", "b")), {"x1": ("num",), "class": ("cat", ["c", "b", "a"]), "b": ("cat", ["u", "v"])})
    assert out.features == ("x1", "class_a", "class_b", "class_c", "b_u", "b_v") and out.df.agg(F.sum("b_u")).first()[0] == 400
    assert preprocess.one_hot_all(sf, {"x1": ("num",)}).features == sf.features


def test_an_owners_cache_stays(spark):
    df = spark.range(5).withColumn("site", F.lit(0)).persist()
    with sites.kept(df):
        pass
    assert df.storageLevel.useMemory
    df.unpersist()
    other = spark.range(6)
    with pytest.raises(RuntimeError), sites.kept(other):
        assert other.storageLevel.useMemory
        raise RuntimeError
    assert not other.storageLevel.useMemory


def test_images_of_channels(spark):
    flat = spark.createDataFrame([([float(i) for i in range(24)],)], "v array<double>")
    got = flat.select(images.channels(F.col("v"), 2, 3, 4).alias("c")).first()["c"]
    assert np.array_equal(np.array(got), np.arange(24.0).reshape(2, 3, 4))
    same, wide = (np.array(flat.select(images.bilinear(images.as_matrix(F.col("v"), 4, 6), 4, 6, *to).alias("m")).first()["m"]) for to in ((4, 6), (8, 6)))
    assert np.allclose(same, np.arange(24.0).reshape(4, 6)) and wide.shape == (8, 6) and np.allclose(wide[1], 0.75 * same[0] + 0.25 * same[1])
