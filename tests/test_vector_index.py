"""The stored index: codes, calibration, and lists that hold nothing for an asker."""

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from custodia.operators import retrieval, vector_index
from custodia.plans import jobs

rng = np.random.default_rng(8)
PUBLIC = "Code of Conduct"


@pytest.fixture(scope="module")
def clustered():
    """Forty directions with vectors around each of them."""
    centers = rng.normal(size=(40, 24))
    return (centers[rng.integers(0, 40, 900)] + 0.3 * rng.normal(size=(900, 24))).astype("float32")


def chunks_of(spark, vectors, category=lambda i: PUBLIC, mails=lambda i: None):
    data = [(i, v.tolist(), category(i), mails(i), f"E{i % 3}", f"t{i % 4}", i // 8) for i, v in enumerate(vectors)]
    schema = "chunk_id bigint, embedding array<float>, category string, entitled_emails array<string>, extracted_employee_id string, title string, chunk_index int"
    return spark.createDataFrame(data, schema).repartition(3)


def askers(spark, vectors, mail="nobody@x"):
    data = [(i, v.tolist(), mail, "E9", ["pm"], i // 2, i % 2, f"q{i}") for i, v in enumerate(vectors)]
    return spark.createDataFrame(data, "query_id bigint, embedding array<float>, email string, employee_id string, groups array<string>, request_id bigint, query_pos int, query string")


def test_codes_are_close_and_small():
    unit = retrieval._unit(pd.Series(list(rng.normal(size=(200, 33)))))
    centers = retrieval._unit(pd.Series(list(rng.normal(size=(200, 33)))))
    codes, scale = vector_index.coded(unit, centers)
    back = vector_index.decoded(pd.Series(codes), scale.astype("float64"), centers)
    assert {len(c) for c in codes} == {17}
    assert (np.abs(back - unit) <= scale[:, None] / vector_index.LEVELS + 1e-6).all()


def test_calibrated_search_reaches_its_recall(spark, clustered, tmp_path):
    path = str(tmp_path / "index")
    chunks, asked = chunks_of(spark, clustered), askers(spark, clustered[::20])
    vector_index.build(chunks, path, lists=30)
    table = spark.read.parquet(f"{path}/calibration").toPandas()
    assert table["recall"].between(0, 1).all() and table["recall"].max() == 1
    for recall in (0.8, 0.95, 1.0):
        nprobe, depth = vector_index.plan_for(spark, path, recall)
        assert nprobe < 15 and depth < 300
        found = vector_index.search(path, asked, 10, -2.0, recall)
        true = retrieval.vector_search(chunks, asked, 10, -2.0)
        met = true.join(found.select("query_id", "chunk_id", F.col("similarity").alias("own")), ["query_id", "chunk_id"])
        assert met.filter("similarity <> own").isEmpty()
        assert met.count() >= (recall - 0.06) * true.count()


def test_exact_search_equals_search_without_an_index(spark, clustered, tmp_path):
    path = str(tmp_path / "index")
    vectors = np.vstack([clustered, np.zeros((3, 24), dtype="float32"), clustered[:40]])
    category = lambda i: [PUBLIC, "Records", "Performance Review", None][i % 4]
    chunks = chunks_of(spark, vectors, category, lambda i: [f"u{i % 7}@x", "all@x"] if i % 5 == 0 else None)
    vector_index.build(chunks, path, lists=25)
    asked = askers(spark, vectors[::90], "u3@x").unionByName(askers(spark, vectors[5:8]).withColumn("query_id", F.col("query_id") + 100))
    for threshold in (0.2, 0.9):
        want = retrieval.vector_search(chunks, asked, 6, threshold, secured=True)
        assert rows(vector_index.search(path, asked, 6, threshold, secured=True, nprobe=2)) == rows(want)
    plain = asked.select("query_id", "embedding")
    assert rows(vector_index.search(path, plain, 6, 0.2)) == rows(retrieval.vector_search(chunks, plain, 6, 0.2))
    assert rows(jobs.retrieve(chunks, asked, index=path)) == rows(jobs.retrieve(chunks, asked))
    texts = chunks.withColumn("content", F.format_string("text %d", "chunk_id"))
    assert rows(jobs.retrieve_context(texts, asked, index=path)) == rows(jobs.retrieve_context(texts, asked))


def test_lists_without_a_grant_are_not_read(spark, clustered, tmp_path, monkeypatch):
    """All chunks but a few in two lists belong to others: only these lists' files are read."""
    path = str(tmp_path / "index")
    centers = retrieval._centers(chunks_of(spark, clustered), 30, 10, 7)
    unit = retrieval._unit(pd.Series(list(clustered)))
    own = (unit @ centers.T).argmax(axis=1)
    mine = {i for i in range(len(unit)) if own[i] in (4, 9)}
    chunks = chunks_of(spark, clustered, lambda i: "Records", lambda i: ["me@x"] if i in mine else ["other@x"])
    vector_index.build(chunks, path, lists=30)
    held = {r["list_id"] for r in spark.read.parquet(f"{path}/lists").filter("array_contains(grants, 'mail me@x')").select("list_id").distinct().collect()}
    read, pairs = [], retrieval._search_pairs

    def watched(lists, probes, *rest):
        read.append({r["list_id"] for r in probes.select("list_id").distinct().collect()})
        return pairs(lists, probes, *rest)

    monkeypatch.setattr(retrieval, "_search_pairs", watched)
    asked = askers(spark, clustered[:6], "me@x")
    found = vector_index.search(path, asked, 5, -2.0, secured=True, nprobe=3)
    assert {r["chunk_id"] for r in found.collect()} <= mine and found.count() == 30
    assert held and all(some <= held for some in read)
    assert vector_index.search(path, askers(spark, clustered[:2], "stranger@x"), 5, -2.0, secured=True).isEmpty()
    lists = vector_index.opened(spark, path)
    one = vector_index.search(path, asked.limit(1), 5, -2.0, secured=True)
    assert one.count() == 5 and lists.stored


def test_empty_index(spark, clustered, tmp_path):
    path = str(tmp_path / "index")
    vector_index.build(chunks_of(spark, clustered[:4]).limit(0), path)
    assert vector_index.search(path, askers(spark, clustered[:2]), 5, recall=0.9).isEmpty()
    assert vector_index.search(path, askers(spark, clustered[:2]), 5, secured=True).isEmpty()
