import pytest
from conftest import rows
from pyspark.sql import functions as F

from custodia.operators import catalog
from custodia.plans import jobs

FILE = (
    "pos bigint, file_id string, datasource struct<id:string,name:string,connector:struct<type:string,name:string,id:string,connectorId:string>>, "
    "labels array<struct<id:string,name:string>>"
)
LABEL = (
    "pos bigint, id string, name string, type string, subtype string, description string, createdAt string, "
    "updatedAt string, searchLink string, tenant string"
)


@pytest.fixture
def files(spark):
    smb = ("smb", None, "", "c9")
    data = [
        (1, "f1", ("d1", "First", smb), [("1", "A"), ("2", "B")]),
        (2, "f2", ("d1", "Second", smb), [("1", "A"), ("1", "A")]),
        (3, "f3", ("d2", "", None), [("2", "B")]),
        (4, "f4", (None, "nameless", None), [("1", "A")]),
        (5, "f5", ("d3", "Third", smb), [("77", "Moved")]),
        (6, "f6", ("d1", "Last", smb), [("77", "Moved")]),
        (7, "f7", ("d4", "D4", smb), None),
        (8, "f8", None, [("1", "A")]),
    ]
    return spark.createDataFrame(data, FILE)


@pytest.fixture
def classes(spark):
    data = [
        (1, "1", "A", "LABEL", "smart", "About A", "2024-01-01", None, "/s?q=A", None),
        (2, "2", "B", "label", None, None, None, None, None, "other"),
        (3, "3", "Moved", "Label", "", "", "", "2024-02-02", "", None),
        (4, "4", "Ann", "ANNOTATOR", None, None, None, None, None, None),
        (5, "5", None, "LABEL", None, None, None, None, None, None),
    ]
    return spark.createDataFrame(data, LABEL)


def test_label_filter(classes):
    assert rows(catalog.select_labels(classes), "id") == [("1",), ("2",), ("3",), ("5",)]
    assert rows(catalog.select_labels(classes, 2), "id") == [("1",), ("2",)]


def test_datasources_of_labels(files, classes):
    pairs = catalog.label_datasources(files, catalog.select_labels(classes))
    got = rows(pairs.select("label_id", "ds.*"))
    assert got == [
        ("1", "d1", "First", "smb", None, "c9"),
        ("2", "d1", "First", "smb", None, "c9"),
        ("2", "d2", "d2", "", None, None),
        ("3", "d1", "Last", "smb", None, "c9"),
        ("3", "d3", "Third", "smb", None, "c9"),
    ]
    last = rows(catalog.unique_datasources(pairs), "id", "name")
    assert last == [("d1", "Last"), ("d2", "d2"), ("d3", "Third")]


def test_cycle(spark, files, classes):
    existing = spark.createDataFrame(
        [("unstructured_dataset", "dxrtag://acme/1", "acme"), ("unstructured_dataset", "dxrtag://acme/9", "acme"), ("unstructured_dataset", "dxrtag://beta/9", "beta")],
        "type_name string, qualified_name string, tenant string",
    )
    done = jobs.catalog_sync(files, classes, existing, "acme", "https://h/")
    labels = {r["label_id"]: r for r in done.labels.collect()}
    assert labels["1"]["search_link"] == "https://h/s?q=A" and labels["1"]["label_subtype"] == "smart"
    assert labels["2"]["qualified_name"] == "dxrtag://other/2" and labels["2"]["tenant"] == "other"
    assert labels["5"]["name"] == "dxr_label_5" and labels["3"]["search_link"] is None
    assert rows(done.stale) == [("dxrtag://acme/9",)]
    assert ("unstructured_datasource_has_unstructured_dataset", "dxrds://acme/d2", "dxrtag://other/2", 1) in rows(done.edges.drop("stats_updated_at"))
    processes = {r["qualified_name"]: r for r in done.processes.collect()}
    assert len(processes) == 5
    about_a = processes["dxrproc://acme/d1->1"]
    assert about_a["name"] == "DXR processing: Last -> A"
    assert about_a["description"] == "About A\nLabel type: LABEL\nLabel subtype: smart\nCreated at: 2024-01-01\nDXR Search: https://h/s?q=A"
    moved = processes["dxrproc://acme/d3->3"]
    assert moved["description"].startswith("DXR processing that derived label 'Moved' from datasource 'Third' (id d3).\nLabel type: Label\nUpdated at")
    assert (moved["label_subtype"], moved["search_link"], moved["created_at"], moved["connector_id"]) == (None, None, None, "c9")
    assert processes["dxrproc://acme/d2->2"]["connector_type"] is None


def test_collections(spark):
    sources = spark.createDataFrame([("1", "Finance"), ("2", "HR / x"), ("3", "y")], "id string, name string")
    refs = catalog.collection_refs(sources.filter("id <> '3'"))
    assert rows(catalog.by_collection(sources, refs), "collection_ref", "collection_size") == [("finance-1", 1), ("hr-x-2", 1)]
    one = refs.withColumn("collection_ref", F.lit("all"))
    assert rows(catalog.by_collection(sources, one), "id", "collection_size") == [("1", 2), ("2", 2)]
    many = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("n").alias("name"))
    refs = many.select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id"))).alias("collection_ref"))
    split = catalog.by_collection(many, refs)
    assert split.count() == 500 and split.filter("collection_size = 167").count() == 167


def test_lookups_and_deletes(spark):
    entities = spark.createDataFrame([("t", "q1", "x"), ("t", "q2", "y"), ("u", "q1", "x")], "type_name string, qualified_name string, tenant string")
    wanted = spark.createDataFrame([("t", "q1")], "type_name string, qualified_name string")
    assert rows(catalog.lookup_by_name(entities, wanted), "tenant") == [("x",)]
    assert rows(catalog.lookup_by_attribute(entities, "t", "tenant", "y"), "qualified_name") == [("q2",)]
    left = catalog.apply_deletes(entities, catalog.stale(entities, wanted, "y"))
    assert rows(left, "qualified_name") == [("q1",), ("q1",)]


def test_entity_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "qualified_name string, n int, extra string")
    new = spark.createDataFrame([("b", None, "N"), ("c", 3, "M")], "qualified_name string, n int, more string")
    assert rows(catalog.upsert_entities(old, new)) == [
        ("a", 1, "x", None, "kept"), ("b", None, "y", "N", "updated"), ("c", 3, None, "M", "created"),
    ]


def test_schema_merge(spark):
    old, new = spark.createDataFrame([(1, "a")], "k int, x string"), spark.createDataFrame([(2, 5)], "k int, y int")
    assert catalog.merge_schema(old, new).columns == ["k", "x", "y"]
    with pytest.raises(ValueError, match="x"):
        catalog.merge_schema(old, spark.createDataFrame([(1, 2)], "k int, x int"))


def test_edge_upsert(spark):
    shape = "qualified_name string, attributes map<string,string>, inputs array<string>, outputs array<string>"
    old = spark.createDataFrame([("e", {"a": "1", "b": "2"}, ["i"], ["o"]), ("f", {"a": "1"}, ["i"], None)], shape)
    new = spark.createDataFrame([("e", {"b": "3", "c": None}, ["i", "j"], ["o"]), ("g", None, [], ["o"])], shape)
    got = {r["qualified_name"]: r for r in catalog.upsert_edges(old, new).collect()}
    assert got["e"]["attributes"] == {"a": "1", "b": "3", "c": None} and got["e"]["inputs"] == ["i", "j"]
    assert got["f"]["attributes"] == {"a": "1"} and got["g"]["attributes"] == {} and got["g"]["outputs"] == ["o"]


def test_hit_counts(spark):
    files = spark.createDataFrame([("1", "d", ["A", "A", "B"]), ("2", "d", ["A"]), ("3", "e", None)], "file_id string, datasource_id string, labels array<string>")
    assert rows(catalog.hit_counts(files)) == [("d", "A", 2), ("d", "B", 1)]
