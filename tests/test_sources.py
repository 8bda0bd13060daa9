import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from custodia.plans.jobs import run_snapshot
from custodia.sources import files, ndjson, tables


@pytest.fixture
def export(tmp_path):
    path = tmp_path / "export.jsonl"
    lines = [
        json.dumps({"fileId": "1", "fileName": "a", "size": 5, "labels": [{"id": 1, "name": "L"}], "owner": "me", "datasource": {"id": 9}}),
        "",
        "not json",
        json.dumps({"fileId": 2, "path": " /p ", "fileName": "", "labels": None, "scanDepth": "deep"}),
        "{broken",
    ]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_ndjson_skips_blank_and_bad_lines(spark, export):
    assert ndjson.read_ndjson(spark, export).count() == 2
    assert ndjson.read_ndjson(spark, export, cap=1).count() == 1
    assert rows(ndjson.read_bad_lines(spark, export)) == [("not json",), ("{broken",)]
    typed = ndjson.read_ndjson(spark, export, "fileName string, size bigint")
    assert rows(typed) == [("", None), ("a", 5)]
    mistyped = ndjson.read_ndjson(spark, export, "fileName string, scanDepth int")
    assert rows(mistyped) == [("", None), ("a", None)]
    with pytest.raises(ValueError):
        ndjson.read_ndjson(spark, export, cap=0)


def test_file_record_projection(spark, export):
    got = ndjson.project_file_records(ndjson.read_ndjson(spark, export)).orderBy("file_id").collect()
    first, second = got
    assert (first["file_id"], first["file_name"], first["size"], first["owner_json"]) == ("1", "a", 5, "me")
    assert json.loads(first["labels_json"]) == [{"id": 1, "name": "L"}] and json.loads(first["datasource_json"]) == {"id": 9}
    assert json.loads(first["raw_json"])["fileName"] == "a"
    assert (second["file_id"], second["path"], second["labels_json"], second["scan_depth"]) == ("2", " /p ", None, None) and second["file_name"] == ""
    assert len(got[0]) == 19


def test_land_and_register(spark, export, tmp_path):
    ndjson.land_raw(spark.range(3).select(F.col("id").alias("n")), str(tmp_path / "raw"))
    ndjson.land_raw(spark.range(2).select(F.col("id").alias("n")), str(tmp_path / "raw"))
    view = ndjson.register_inferred(spark, str(tmp_path / "raw"), "things")
    assert view == "exported_things"
    assert rows(ndjson.adhoc(spark, view, 1, "n")) == [(0,)]


def test_export_formats(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1)], "x string, y int")
    ndjson.export(df, str(tmp_path / "c"), "csv")
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "c"))) == [("a,b", "1")]
    ndjson.export(df, str(tmp_path / "j"), "json")
    assert rows(spark.read.json(str(tmp_path / "j"))) == [("a,b", 1)]
    with pytest.raises(ValueError):
        ndjson.export(df, str(tmp_path / "x"), "xml")


def test_mirror_by_label(spark, tmp_path):
    df = spark.createDataFrame([("f1", ["A", "B"]), ("f2", ["A"]), ("f3", None)], "f string, labels array<string>")
    ndjson.mirror_by_label(df, str(tmp_path / "m"))
    assert sorted(d for d in os.listdir(tmp_path / "m") if d.startswith("label=")) == ["label=A", "label=B"]
    assert rows(spark.read.parquet(str(tmp_path / "m" / "label=A"))) == [("f1",), ("f2",)]


def test_list_files(spark, tmp_path):
    root = tmp_path / "vol"
    (root / "nested" / "deep").mkdir(parents=True)
    (root / "a").write_bytes(b"12345")
    (root / "nested" / "b").write_bytes(b"1")
    (root / "nested" / "deep" / ".hidden").write_bytes(b"")
    (root / "nested" / "back").symlink_to(root)
    (root / "one").mkdir()
    (root / "two").mkdir()
    (root / "one" / "other").symlink_to(root / "two")
    (root / "two" / "other").symlink_to(root / "one")
    (root / "gone").symlink_to(root / "nowhere")
    by_address = files.list_files(spark, f"file://{root}").select("relative_path", "size_bytes")
    assert rows(by_address) == [("a", 5), ("nested/b", 1), ("nested/deep/.hidden", 0)]
    got = rows(files.list_files(spark, str(root)).select("relative_path", "size_bytes"))
    assert got == [("a", 5), ("nested/b", 1), ("nested/deep/.hidden", 0)]
    scoped = files.list_files(spark, str(root), "nested").select("relative_path", "modification_time")
    assert [r[0] for r in rows(scoped)] == ["b", "deep/.hidden"]
    assert scoped.filter(F.col("modification_time") < 1_600_000_000).count() == 0
    assert files.list_files(spark, str(tmp_path / "none")).count() == 0
    assert files.volume_root("/Volumes", "c", "s", "v", "/p/") == "/Volumes/c/s/v/p"


def test_snapshot_replaces_one_day(spark, export, tmp_path):
    target = str(tmp_path / "snap")
    assert run_snapshot(spark, export, target, "2024-03-01", "2024-03-01 06:00:00")
    assert run_snapshot(spark, export, target, "2024-03-02")
    assert run_snapshot(spark, export, target, "2024-03-02", cap=1)
    assert rows(tables.read_snapshot(spark, target).groupBy("ingestion_date").count()) == [("2024-03-01", 2), ("2024-03-02", 1)]
    name = "spark_catalog.default.custodia_days"
    assert run_snapshot(spark, export, target, "2024-03-03", table=name)
    assert spark.table(name).count() == 5
    assert run_snapshot(spark, export, target, "2024-03-04", table=name)
    assert spark.table(name).count() == 7
    spark.sql(f"DROP TABLE {name}")
    empty = spark.createDataFrame([], "x int")
    assert not tables.write_snapshot(empty, str(tmp_path / "none"), "2024-03-01")
    assert not os.path.exists(tmp_path / "none")
    day = tables.read_snapshot(spark, target, "2024-03-01")
    assert "PartitionFilters: [isnotnull(ingestion_date" in day._jdf.queryExecution().toString()


def test_register_table(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    name = tables.register_table(spark, "spark_catalog.default.custodia_t", str(tmp_path / "t"))
    assert name == "`spark_catalog`.`default`.`custodia_t`" and spark.table(name).count() == 3
    spark.sql(f"DROP TABLE {name}")
    for bad in ("a.b", "a.b.c.d", "a..c", ""):
        with pytest.raises(ValueError):
            tables.table_name(spark, bad)
    assert tables.table_name(spark, "a.`b.c`.d") == "`a`.`b.c`.`d`"


def test_metadata_table_contract(spark):
    schema = tables.metadata_schema()
    assert len(schema) == 34 and schema["parent_paths"].dataType.simpleString() == "array<string>"
    actual = StructType.fromDDL("file_path string, file_size int, extra string")
    found = tables.schema_differences(actual, StructType.fromDDL("file_path string not null, file_size bigint, job_id string"))
    assert found == [("file_size", "bigint", "int"), ("job_id", "string", None)]
    assert tables.schema_differences(schema, schema) == []
    name = "spark_catalog.default.custodia_meta"
    tables.ensure_table(spark, name, drop=True)
    tables.ensure_table(spark, name)
    assert spark.table(name).count() == 0
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"CREATE TABLE {name} (file_path STRING) USING parquet")
    with pytest.raises(ValueError, match="relative_path is not there"):
        tables.ensure_table(spark, name)
    spark.sql(f"DROP TABLE {name}")


def test_latest_row_per_key(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 3, "b"), ("k", 2, "c"), ("m", None, "d")], "k string, t int, v string")
    assert rows(tables.latest_per_key(df, ["k"], ["t"])) == [("k", 3, "b"), ("m", None, "d")]


def test_upsert_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "keyed")
    first = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "k bigint, v string")
    second = spark.createDataFrame([(i, f"w{i}") for i in range(40, 60)], "k bigint, v string")
    assert tables.merge_upsert(first, path, ["k"], 4)
    assert tables.merge_upsert(second, path, ["k"], 4)
    want = [(i, f"v{i}" if i < 40 else f"w{i}") for i in range(60)]
    assert sorted(rows(tables.read_keyed(spark, path))) == want
    assert tables.merge_upsert(second, path, ["k"], 4)
    assert sorted(rows(tables.read_keyed(spark, path))) == want
    assert not tables.merge_upsert(second.limit(0), path, ["k"], 4)
    assert tables.merge_upsert(second, path, ["k"]) and sorted(rows(tables.read_keyed(spark, path))) == want
    for keys, buckets in ((["k"], 8), (["v"], None)):
        with pytest.raises(ValueError):
            tables.merge_upsert(second, path, keys, buckets)


def test_crash_before_the_switch_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path, root = str(tmp_path / "keyed"), str(tmp_path / "loads")
    df = spark.range(20).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    tables.merge_upsert(df, path, ["k"], 4)
    tables.full_refresh({"d": df}, root)
    real = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
    for load in (lambda: tables.merge_upsert(df.withColumn("v", F.lit("new")), path, ["k"], 4), lambda: tables.full_refresh({"d": df.limit(3)}, root)):
        with pytest.raises(RuntimeError):
            load()
    monkeypatch.setattr(type(spark), "createDataFrame", real)
    assert rows(tables.read_keyed(spark, path).groupBy("v").count()) == [("old", 20)]
    assert tables.read_current(spark, root, "d").count() == 20
    assert tables.merge_upsert(df.withColumn("v", F.lit("new")), path, ["k"], 4)
    assert rows(tables.read_keyed(spark, path).groupBy("v").count()) == [("new", 20)]


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    path = tmp_path / "keyed"
    df = spark.range(100).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    tables.merge_upsert(df, str(path), ["k"], 8)
    before = {p: p.stat().st_mtime_ns for p in (path / "data").rglob("*.parquet")}
    tables.merge_upsert(df.filter("k = 5"), str(path), ["k"], 8)
    after = {p: p.stat().st_mtime_ns for p in (path / "data").rglob("*.parquet")}
    assert before.items() <= after.items() and len({p.parent for p in after.keys() - before.keys()}) == 1
    assert tables.read_keyed(spark, str(path)).count() == 100


def test_full_refresh(spark, tmp_path):
    root = str(tmp_path / "r")
    for n in (1, 2, 3):
        tables.full_refresh({"d": spark.range(n), "c": spark.range(2 * n)}, root)
        assert tables.read_current(spark, root, "d").count() == n and tables.read_current(spark, root, "c").count() == 2 * n
    assert sorted(os.listdir(tmp_path / "r")) == ["current", "loads"]


def test_mirror_writes_as_many_files_as_labels_need(spark, tmp_path):
    """A label on a third of all rows is spread, rare ones get one file each, whatever the number of tasks."""
    from pyspark.sql import functions as F

    from custodia.sources import ndjson

    labels = F.when(F.col("id") % 3 == 0, F.array(F.lit("hot"), F.concat(F.lit("rare"), F.col("id") % 40), F.lit("hot"))).when(F.col("id") % 3 == 1, F.array(F.concat(F.lit("rare"), F.col("id") % 40)))
    files = spark.range(0, 3000, 1, 16).withColumn("labels", labels).withColumn("extra", F.create_map(F.lit("a"), F.col("id")))
    ndjson.mirror_by_label(files, str(tmp_path / "mirror"), rows_per_file=100)
    held = spark.read.parquet(str(tmp_path / "mirror")).withColumn("file", F.input_file_name())
    per_file = held.groupBy("label", "file").agg(F.count("*").alias("n")).groupBy("label").agg(F.count("*").alias("files"), F.max("n").alias("most"), F.sum("n").alias("n"))
    got = {r["label"]: (r["files"], r["most"], r["n"]) for r in per_file.collect()}
    assert got["hot"][2] == 1000 and 10 <= got["hot"][0] <= 20 and all(v[1] <= 100 for v in got.values())
    assert len(got) == 41 and all(v[0] == 1 for k, v in got.items() if k != "hot")
