"""Cycles that write only what changed, and vectors that are made once for each text."""

from conftest import rows
from pyspark.sql import functions as F

from custodia.operators import incremental


def entities(spark, data):
    return spark.createDataFrame(data, "qualified_name string, name string, tags map<string,string>, n int")


def test_only_changes_are_told_and_written(spark, tmp_path):
    state = str(tmp_path / "state")
    first = [(f"q{i}", f"n{i}", {"a": str(i)}, i) for i in range(60)] + [(None, "no name", None, 1)]
    done = incremental.changes(entities(spark, first), state, groups=8)
    assert rows(done.rows) == sorted((f"q{i}", "created") for i in range(60))
    assert done.remember() == 8
    again = incremental.changes(entities(spark, first[::-1]), state, groups=8)
    assert (rows(again.rows), again.groups, again.remember()) == ([], [], 0)
    second = [(k, n, {"a": "new"} if k == "q7" else t, None if k == "q8" else i) for k, n, t, i in first if k not in ("q1", "q2")] + [("q99", None, None, None)]
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "state" / "rows").rglob("*.parquet")}
    changed = incremental.changes(entities(spark, second), state, groups=8)
    assert rows(changed.rows) == [("q1", "deleted"), ("q2", "deleted"), ("q7", "updated"), ("q8", "updated"), ("q99", "created")]
    lost = incremental.changes(entities(spark, second), state, groups=8)  # not remembered: told again
    assert rows(lost.rows) == rows(changed.rows)
    assert 0 < changed.remember() < 8
    assert any(f.exists() and f.stat().st_mtime_ns == t for f, t in before.items())  # equal groups stay as they are
    assert incremental.changes(entities(spark, second), state, groups=8).rows.isEmpty()
    gone = incremental.changes(entities(spark, []), state, groups=8)
    assert gone.rows.count() == 59 and gone.rows.filter("change <> 'deleted'").isEmpty()
    gone.remember()
    assert incremental.changes(entities(spark, []), state, groups=8).groups == []


def test_texts_are_embedded_once(spark, tmp_path):
    store, seen = str(tmp_path / "vectors"), spark.sparkContext.accumulator(0)

    def embedder(texts):
        seen.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    def load(name, before, texts):
        start = seen.value
        chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id int, chunk string")
        done = incremental.embed_load(chunks, store, name, before, embedder)
        assert rows(done.chunks.select("chunk_id", F.col("embedding")[0])) == [(i, float(len(t or ""))) for i, t in enumerate(texts)]
        return done.embedded, done.dropped, seen.value - start

    assert load("one", None, ["a", "bb", "a", None, "", "ccc"]) == (4, 0, 4)
    assert load("two", "one", ["bb", "bb", "dddd", "a"]) == (1, 2, 1)
    assert load("three", "two", []) == (0, 3, 0)
    assert load("four", "three", ["bb"]) == (1, 0, 1)
