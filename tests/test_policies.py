import pytest
from conftest import rows
from pyspark.sql import functions as F

from custodia.functions import wire
from custodia.operators import annotate, labels, policies, quality


@pytest.fixture
def files(spark):
    data = [
        ("1", "/a/x.txt", "h1", 3, ["ROT"], "Records", "2010-01-01"),
        ("2", "/b/x.txt", "h1", 3, ["CONFIDENTIAL"], "Records", "2020-01-01"),
        ("3", "c\\y.txt", "h2", 5, ["CONFIDENTIAL", "GATED"], "Other", "2010-01-01"),
        ("4", "/d/z.txt", "h1", 3, None, "Records", None),
        ("5", "/e/e.txt", "", 1, [], "Other", "2010-01-01"),
        ("6", "/f/f.txt", None, 1, ["GATED"], "Other", "2010-01-01"),
        ("7", " ", "h3", 1, ["ROT", "GATED"], "Other", "2010-01-01"),
        ("8", None, "h3", 1, ["ROT"], "Other", "2010-01-01"),
    ]
    return spark.createDataFrame(
        data, "file_id string, path string, content_sha256 string, size bigint, labels array<string>, category string, d string"
    ).withColumn("last_modified", F.col("d").cast("date"))


def test_duplicates(files):
    assert rows(policies.duplicate_groups(files)) == [("h1", 3, 9, "1"), ("h3", 2, 2, "7")]
    assert rows(policies.duplicates_to_archive(files), "file_id", "keep_id") == [("2", "1"), ("4", "1"), ("8", "7")]


@pytest.mark.parametrize("hot_rows", [1, 2, 1000])
def test_duplicates_of_a_hot_hash(spark, hot_rows):
    """A third of all files have one content; the result does not depend on how it is split."""
    n = 3000
    hashed = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), (F.col("id") / 2).cast("int")))
    files = spark.range(n).select(
        F.format_string("%05d", "id").alias("file_id"), F.lit("/p").alias("path"), hashed.alias("content_sha256"), F.lit(1).alias("size")
    )
    got = policies.duplicates_to_archive(files, hot_rows=hot_rows)
    keepers = policies.duplicate_groups(files)
    want = files.join(keepers, "content_sha256").filter("file_id <> keep_id").count()
    assert got.count() == got.select("file_id").distinct().count() == want
    assert got.filter("content_sha256 = 'hot'").count() == 999


def test_retention_and_rot(files):
    assert rows(policies.retention_gaps(files, "2024-01-01"), "file_id") == [("1",)]
    edge = files.filter("file_id = '1'").withColumn("last_modified", F.lit("2017-01-01").cast("date"))
    assert policies.retention_gaps(edge, "2024-01-01").count() == 0
    assert rows(policies.rot_files(files), "file_id") == [("1",), ("7",), ("8",)]


def test_remediation_plan(files):
    plan = rows(policies.remediation_plan(files, "/arch/"), "source_path", "archive_path")
    assert plan == [
        ("/a/x.txt", "/arch/h1/x.txt"),
        ("/b/x.txt", "/arch/h1/x.txt"),
        ("/d/z.txt", "/arch/h1/z.txt"),
        ("/e/e.txt", "/arch/unhashed/e.txt"),
        ("/f/f.txt", "/arch/unhashed/f.txt"),
        ("c\\y.txt", "/arch/h2/y.txt"),
    ]
    windows = policies.remediation_plan(files.filter("file_id = '3'"), "\\\\srv\\arch", "\\").first()
    assert windows["archive_path"] == "\\\\srv\\arch\\h2\\y.txt" and windows["stub_text"] == wire.STUB_TEXT


def test_routing(files):
    routed = labels.route(files, ["GATED"], ["CONFIDENTIAL"], remove=True)
    assert rows(routed, "file_id", "target", "action") == [
        ("1", None, "stay"), ("2", "quarantine", "move"), ("3", "quarantine", "move"), ("4", None, "stay"),
        ("5", None, "stay"), ("6", "allowed", "move"), ("7", "allowed", "move"), ("8", None, "stay"),
    ]
    none = labels.route(files, [], [])
    assert none.filter("target IS NOT NULL").count() == 0
    assert {r[0] for r in rows(labels.route(files, ["GATED"], []), "action")} == {"stay", "copy"}
    assert none.filter("written_category <> category").count() == 0


def test_object_events_keep_their_bucket(spark):
    record = "struct<s3:struct<bucket:struct<name:string>,object:struct<key:string>>>"
    events = spark.createDataFrame(
        [([(((("b1",), ("d/a+b%2Bc.txt",))),), (((("b2",), ("x",))),)],)], f"Records array<{record}>"
    )
    assert rows(labels.object_events(events)) == [("b1", "d/a b+c.txt", "a b+c.txt"), ("b2", "x", "x")]


def test_label_structs(spark):
    df = spark.createDataFrame([([("1", "CONFIDENTIAL")],), (None,)], "labels array<struct<id:string,name:string>>")
    names = labels.label_names(F.col("labels"))
    assert [r[0] for r in df.select(labels.label_gap(names, "CONFIDENTIAL", "GATED")).collect()] == [True, None]


def test_quality_rules(files):
    gap = "array_contains(labels, 'CONFIDENTIAL') AND NOT array_contains(labels, 'GATED')"
    assert rows(quality.rule_row_count(files, gap)) == [(1, False)]
    assert rows(quality.rule_row_count(files, gap, "<=", 1)) == [(1, True)]
    assert quality.rule_column_exists(files, "labels") and not quality.rule_column_exists(files, "nope")
    card = quality.evaluate_ruleset(
        files,
        [
            quality.ColumnExists("has labels", "labels"),
            quality.ColumnExists("has nope", "nope"),
            quality.RowCount("gap", gap),
            quality.RowCount("nope", "nope = 1"),
            quality.RowCount("big", "size > 100"),
        ],
    )
    assert rows(card) == [
        ("big", "Passed", 0), ("gap", "Failed", 1), ("has labels", "Passed", None), ("has nope", "Failed", None), ("nope", "Failed", None),
    ]


def test_annotations_and_rules(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The FINANCIAL projections of ITAR"), (2, "nothing"), (3, None), (4, "é ÉTÉ")], "doc_id int, text string")
    words = spark.createDataFrame(
        [("fin", "Financial Projections"), ("fin", "of"), ("law", "itar"), ("dup", "ITAR"), ("x", ""), ("fr", "été")],
        "annotator string, keyword string",
    )
    want = [(1, "dup", "ITAR"), (1, "fin", "Financial Projections"), (1, "fin", "of"), (1, "law", "itar"), (4, "fr", "été")]
    assert rows(annotate.annotate(docs, words)) == want
    for size in (1, 3):
        monkeypatch.setattr(annotate, "GRAM", size)
        assert rows(annotate.annotate(docs, words)) == want
    assert annotate.annotate(docs, words.limit(0)).count() == 0
    rules = spark.createDataFrame([("fin", "Sensitive"), ("law", "Sensitive"), ("law", "ITAR")], "annotator string, label string")
    assert rows(annotate.apply_label_rules(annotate.annotate(docs, words), rules)) == [(1, ["ITAR", "Sensitive"])]


def test_keywords_with_shared_pieces_and_odd_texts(spark):
    """Many keywords that begin alike, letters of several bytes, and texts longer than a piece of work."""
    from custodia.operators import annotate

    head = "a common beginning "
    words = [head + f"{i:03d}" for i in range(300)] + ["é", "日本", "ÄÖÜ-groß", "x" * 400, "", head]
    texts = [head.upper() + "007 and 日本語", None, "", "e" + "é" * 3, "äöü-GROSS äöü-groß", "y" * 2_000_000 + head + "299", "x" * 399, "x" * 401 + head[:-1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    dictionary = spark.createDataFrame([("a", w) for w in words] + [("b", "é"), ("b", None)], "annotator string, keyword string")
    found = {(r["doc_id"], r["annotator"], r["keyword"]) for r in annotate.annotate(docs, dictionary).collect()}
    pairs = [("a", w) for w in words if w] + [("b", "é")]
    assert found == {(i, a, w) for i, t in enumerate(texts) for a, w in pairs if t and w.lower() in t.lower()}
