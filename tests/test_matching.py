import json

from conftest import rows
from pyspark.sql import functions as F

from custodia.operators import matching
from custodia.plans import jobs
from custodia.sources import tables


def volume(spark):
    data = [
        ("b1", "/v/folder/a.txt", "folder/a.txt", 5, 100),
        ("b1", "/v/other/a.txt", "other/a.txt", 6, 101),
        ("b1", "/v/c.txt", "c.txt", 7, 102),
        ("b2", "/v/z/a.txt", "z/a.txt", 8, 103),
    ]
    return spark.createDataFrame(data, "batch string, absolute_path string, relative_path string, size_bytes bigint, modification_time bigint")


def test_exact_path_then_base_name(spark):
    hits = spark.createDataFrame(
        [
            ("b1", "1", "other/a.txt"), ("b1", "2", "x/y/a.txt"), ("b1", "3", "a.txt"), ("b1", "4", "none.txt"),
            ("b2", "5", "other/a.txt"), ("b1", "6", "folder/"), ("b1", "7", ""), ("b3", "8", "a.txt"),
        ],
        "batch string, hit_id string, file_key string",
    )
    got = rows(matching.match_hits(hits, volume(spark)), "hit_id", "relative_path")
    assert got == [("1", "other/a.txt"), ("2", "folder/a.txt"), ("3", "folder/a.txt"), ("5", "z/a.txt")]


def test_paths_listed_twice_are_one_file(spark):
    hits = spark.createDataFrame([("b1", "1", "c.txt"), ("b1", "2", "x/c.txt")], "batch string, hit_id string, file_key string")
    twice = volume(spark).unionByName(volume(spark))
    assert rows(matching.match_hits(hits, twice), "hit_id", "relative_path") == [("1", "c.txt"), ("2", "c.txt")]


def record(**more):
    return json.dumps(
        {
            "dxr#file_id": "id-1",
            "ds#file_name": "folder/a.txt",
            "ds#parent_folder_paths": ["shelf", "shelf/left"],
            "folder_id": "box 12",
            "metadata#MODIFIED_DATE": "1998-11-30",
            "annotations": '[{"n": 1}]',
            "annotation_stats#1": {"count": 3},
            "dxr#tags": ["Payroll", "Draft"],
            "dxr#manually_removed_tags": ["Old"],
            "dxr#is_processed": False,
            "dxr#ocr_used": True,
            "dxr#datasource_scan_id": 4711,
        }
        | more
    )


def test_volume_job_end_to_end(spark):
    hits = spark.createDataFrame(
        [
            ("s1", "h1", record()),
            ("s1", "h2", record(**{"dxr#indexed_date": "2024-01-02", "object_id": "newer"})),
            ("s1", "h3", record(**{"ds#file_name": "unknown.txt"})),
            ("s1", "c.txt", json.dumps({"ai#category": "HR", "dxr#datasource_scan_id": "12"})),
            ("s2", "h5", record(**{"ds#file_name": "a.txt"})),
            ("s3", "h6", record()),
        ],
        "scan_id string, hit_id string, j string",
    ).select("scan_id", "hit_id", F.parse_json("j").alias("source"))
    submissions = spark.createDataFrame([("j1", "b1"), ("j2", "b2"), ("j3", "b3")], "job_id string, batch string")
    results = spark.createDataFrame([("j1", "FINISHED", "s1"), ("j2", "FAILED", "s2"), ("j3", "FINISHED", None)], "job_id string, state string, scan_id string")
    got = jobs.volume_metadata(
        volume(spark), submissions, results, hits, "cat", "sch", "vol", "ds-7", "2024-06-01 00:00:00"
    )
    assert tables.schema_differences(got.schema, tables.metadata_schema()) == []
    assert got.columns == [f.name for f in tables.metadata_schema()]
    by_path = {r["file_path"]: r for r in got.collect()}
    assert sorted(by_path) == ["/v/c.txt", "/v/folder/a.txt", "/v/z/a.txt"]
    full = by_path["/v/folder/a.txt"]
    assert full["object_id"] == "newer" and full["datasource_scan_id"] == 4711 and full["job_id"] == "j1"
    assert (full["dxr_tags"], full["removed_tags"], full["parent_paths"], full["categories"]) == (["Payroll", "Draft"], ["Old"], ["shelf", "shelf/left"], [])
    assert (full["is_processed"], full["ocr_used"], full["modified_at"], full["folder_id"]) == (False, True, "1998-11-30", "box 12")
    assert json.loads(full["annotation_stats_json"]) == {"annotation_stats#1": {"count": 3}}
    assert json.loads(full["raw_metadata"])["dxr#file_id"] == "id-1"
    plain = by_path["/v/c.txt"]
    assert (plain["categories"], plain["datasource_scan_id"], plain["annotation_stats_json"], plain["file_name"]) == (["HR"], 12, None, None)
    rejected = rows(matching.rejected_jobs(submissions, results), "job_id", "reason")
    assert rejected == [("j2", "not finished, hits collected anyway"), ("j3", "no scan id")]


def test_scan_search(spark):
    hits = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 3.0), ("t", "c", 9.0), ("s", "c", 3.0)], "scan_id string, hit_id string, score double")
    assert [r["hit_id"] for r in matching.hits_for_scan(hits, "s").collect()] == ["b", "c", "a"]
    docs = hits.withColumnRenamed("scan_id", "datasource_id")
    assert rows(matching.docs_for_datasources(docs, ["t"]), "hit_id") == [("c",)]
