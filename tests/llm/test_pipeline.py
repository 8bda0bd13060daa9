"""Stages against brute force, their columns, and the whole run."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute as brute_windows
from test_line_dedup import brute as brute_lines
from test_near_duplicates import brute as brute_classes

import corpus_pipeline
from custodia.llm import stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in docs], SCHEMA)


def pairs(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=repr)


def corpus(rng, n=40):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8)))
    lines = [" ".join(word() for _ in range(rng.randrange(4, 30))) for _ in range(n)]
    docs = []
    for i in range(n):
        own = [rng.choice(lines) if rng.random() < 0.4 else " ".join(word() for _ in range(12)) for _ in range(rng.randrange(1, 6))]
        docs.append((i, "\n".join(own), rng.choice(["a", "a", "b"])))
    docs += [(100 + i, docs[i][1] + " " + word(), "b") for i in range(0, n, 5)] + [(200, docs[3][1], "a"), (200, docs[3][1], "a")]
    return docs + [(None, None, None), (300, "", "a"), (301, None, "b"), (None, "alone it stands", None)]


def test_decisions(spark):
    docs = frame(spark, [(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (2, "c", "x"), (None, None, None), (None, None, "z"), (3, None, "x")])
    decisions = [(1, "a", True), (1, "a", False), (1, "b", False), (2, "c", True), (None, None, False), (None, None, True), (3, None, False)]
    found = spark.createDataFrame(decisions, "doc_id long, text string, kept boolean").withColumn("digest", stages.digest_of("text"))
    assert pairs(stages.decided(docs, found)) == sorted([(1, "a"), (2, "c"), (None, None)], key=repr)


def test_line_stage(spark):
    docs = corpus(random.Random(1))
    want = []
    for (i, text, _), b in zip(docs, brute_lines(docs, 2, 24)):
        kept = [x for n, x in enumerate((text or "").split("\n")) if n not in b[4]]
        if not b[4] or any(x.strip() for x in kept):
            want.append((i, "\n".join(kept) if b[4] else text))
    got = stages.without_repeated_lines(spark, frame(spark, docs), "")
    assert pairs(got) == sorted(want, key=repr)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())


def test_near_duplicate_stage(spark):
    docs = corpus(random.Random(2))
    got = stages.without_near_duplicates(spark, frame(spark, docs), "")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = sorted((r.doc_id for r in got.collect()), key=repr)
    want = sorted((min((i for i in group if i is not None), default=None) for group in brute_classes(docs)), key=repr)
    assert kept == want


def test_decontamination_stage(spark, tmp_path):
    docs = corpus(random.Random(3))
    items = [("i1", docs[4][1], 0), ("i2", "never seen", 0), ("i3", "alone it", 0), (None, docs[5][1], 0)]
    spark.createDataFrame(items, "item_id string, text string, n long").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = stages.without_benchmark(spark, frame(spark, docs), str(tmp_path))
    want = [(d[0], d[1]) for d in docs if not dict_of(docs, items)[d[0], d[1]]]
    assert pairs(got) == sorted(want, key=repr)


def dict_of(docs, items):
    return {(d[0], d[1]): brute_windows([d], items)[0][4] for d in docs}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not there")
def test_run(spark):
    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == documents.columns
        assert after.select("doc_id").join(docs, "doc_id", "left_anti").count() == 0 and 0 < after.count() <= docs.count()
        docs = after.cache()
    got = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert got.groupBy("block", "position").count().filter(F.col("count") > 1).count() == 0


def test_columns_with_any_name_pass_all_stages(spark, tmp_path):
    """Columns named like helper columns, and a text of very many lines."""
    names = ["row", "own", "hash", "parts", "lines", "body", "digest", "id", "kept", "copy", "predicted", "score", "held_out", "_lines", "_id", "whole_row", "text_digest"]
    long = "\n".join(hashlib.md5(str(i % 700).encode()).hexdigest() for i in range(6000))
    docs = [(1, "one two three four five six\nseven"), (2, "one two three four five six\neight"), (3, "one two three four five six\neight"), (4, long), (5, None), (None, "")]
    folder = str(tmp_path)
    spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "nowhere to be found")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = spark.createDataFrame([(*d, *names) for d in docs], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, rows, folder)
        assert after.columns == rows.columns, name
        got = after.collect()
        assert all(tuple(r)[2:] == tuple(names) for r in got), name
        if name == "line_dedup":
            texts = {r["doc_id"]: r["text"] for r in got}
            assert texts[1].endswith("seven") and texts[4] == "\n".join(long.split("\n")[:700])
