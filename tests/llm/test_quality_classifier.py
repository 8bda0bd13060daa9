"""Parts of the classifier against closed forms, and held-out accuracy."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from custodia.llm import quality_classifier as qc

DOCS = "doc_id long, text string, stats string, score string"
LABELS = "doc_id long, quality int, text string"


def test_isotonic_is_the_nearest_rising_sequence():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = rng.integers(1, 9)
        y, w = rng.integers(0, 5, n) / 4, rng.integers(1, 4, n).astype(float)
        # minimax form: max over starts of min over ends of the weighted mean
        want = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(qc.isotonic(y, w), want)


def test_features_approximate_the_gaussian_kernel():
    model = qc.Model(np.zeros(20), np.ones(20), 20000, 1.0)
    x = np.random.default_rng(1).normal(size=(6, 20))
    z = model.mapped(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 20))
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_partition_sums_solve_the_same_equations(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 20))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(int)
    rows = [(v.tolist(), int(t), i % 5 == 0) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "stats array<double>, label int, calibrates boolean").repartition(7)
    model = qc.fitted(df, features=30)
    fit = np.array([i % 5 != 0 for i in range(300)])
    z = model.mapped(x[fit])
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + np.eye(31), z.T @ y[fit]))
    assert (np.diff(model.steps[1]) >= 0).all() and ((model.score(x) >= 0) & (model.score(x) <= 1)).all()


@pytest.mark.parametrize("labels, want", [([], 0.5), ([(i, 1, "") for i in range(40)], 1.0), ([(None, 1, ""), (2, None, "")], 0.5)])
def test_nulls_and_few_labels(spark, labels, want):
    docs = [(1, None, "a", "b"), (None, "", "a", "b"), (3, "a b " * 50000, "", ""), (3, "Same same. ##", None, None)]
    docs += [(i, "word text.", "", "") for i in range(10, 30)]
    got = qc.scored(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs) and all(r.score == want and r.predicted == 1 for r in got)
    assert qc.scored(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not there")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = qc.scored(docs, labels).filter("held_out").join(labels, "doc_id")
    assert got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.93
