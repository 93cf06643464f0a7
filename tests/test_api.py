"""The facade from preparation to values, and the driver's entry points without the corpus folder."""

import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsite.api import MODELS, Federation, link
from quillsite.operators import preprocess, value
from quillsite.sources.sites import SiteFrame


@pytest.fixture(scope="module")
def federation(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, 2)) * [2.0, 0.5] + [1.0, 0.0]
    y = (x[:, 0] - 1 + 2 * x[:, 1] > 0).astype(float)
    rows = [(i % 4, i, *map(float, x[i]), "ab"[i % 2], float(y[i]), "no yes".split()[int(y[i])]) for i in range(160)]
    sf = SiteFrame(spark.createDataFrame(rows, "site int, row_id bigint, x1 double, x2 double, c string, y double, class string"), ("x1", "x2"))
    return Federation(*sf.halves(F.col("row_id") % 5 == 0))


def test_preparation(federation):
    out = federation.one_hot("c", ["b", "a"]).normalise()
    m = out.train.df.agg(F.avg("x1"), F.stddev_pop("x1")).first()
    assert abs(m[0]) < 1e-9 and abs(m[1] - 1) < 1e-9 and {"c_a", "c_b"} <= set(out.validation.df.columns)
    low = federation.normalise("min_max").train.df.agg(F.min("x2"), F.max("x2")).first()
    assert (low[0], low[1]) == (0, 1)
    assert out.apply(preprocess.log_scale).pca(1).train.features == ("p1",) and federation.random_projection(3).validation.features == ("p1", "p2", "p3")
    assert len(federation.most_frequent(1).train.features) == 1 and federation.select_sites([1, 2]).train.df.select("site").distinct().count() == 2
    assert federation.check({"x1": ("num",)}).agg(F.sum("n_bad")).first()[0] == 0 and federation.statistics().count() == 4 * (8 * 2 + 1 + 4)
    assert {r["site"] for r in federation.alignment().collect()} == {0, 1, 2, 3}
    assert [f for f, _ in federation.rank_features()][0] == "x1"
    long = preprocess.to_long(federation.train)
    m = preprocess.random_matrix(2, 2, 3)
    dense = {(r["row_id"], j): r[f"p{j + 1}"] for r in federation.project(m).train.df.collect() for j in range(2)}
    assert all(np.isclose(dense[r["row_id"], r["out"]], r["value"]) for r in preprocess.project_long(long, m).collect())


def test_every_model_of_every_mode_trains(federation):
    f = federation.normalise()
    c = np.array([[-1.0, -1], [1, 1], [-1, 1], [1, -1]])
    kernel = {"centroids": c, "sigma": 1.4}
    own = {"Kmeans": {"k": 3, "iterations": 2}, "LR": {"steps": 3}, "LC": {"steps": 3}, "MLC": {"steps": 2}, "SVM": kernel | {"steps": 2}, "FBSVM": kernel | {"rounds": 1, "epochs": 1}, "KR": kernel}
    from quillsite.operators.networks import Network

    for mode, models in MODELS.items():
        for m in models:
            if mode in (2, 4) and m in ("Kmeans", "LR", "LC", "MLC", "KR", "FBSVM"):
                continue  # the same jobs as in modes 1 and 5
            how = {"net": Network((2, 3, 1)), "rounds": 1, "epochs": 1} if m == "NN" else own.get(m, {} if m == "RR" else kernel | {"steps": 1})
            if m == "MBSVM":
                how = how | {"classes": ["no", "yes"]}
            assert f.fit(m, mode, **how) is not None
    with pytest.raises(ValueError, match="mode 1 has"):
        f.fit("RR", 1)


def test_values(federation):
    f = federation.normalise()
    for df in (f.prior_value(4), f.online_value(2)):
        v = [r["value"] for r in df.collect()]
        assert len(v) == 4 and np.isclose(sum(v), 1) and min(v) >= 0
    assert np.isclose(sum(g for _, g in f.posterior_value()), 1)
    own = value.site_matrices(f.train)
    assert set(own) == {0, 1, 2, 3} and own[0].shape == (4, 4)


def test_link(spark):
    a = spark.createDataFrame([(1, "p", 0), (2, "q", 1)], "id int, x string, o int")
    b = spark.createDataFrame([(2, "r", 0), (3, "s", 1)], "id int, z string, o int")
    assert [tuple(r)[1:] for r in link({0: (a, "id", "o"), 1: (b, "id", "o")}).collect()] == [("q", "r")]
    assert link({0: (a, "id", "o"), 1: (b, "id", "o")}, "join").count() == 3


def test_entry_points_work_without_the_corpus_folder(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "quillsite", tmp_path / "quillsite", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'gram_per_site' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    (tmp_path / "quillsite" / "llm" / "__pycache__").mkdir(parents=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
