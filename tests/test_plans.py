"""What the physical plans must and must not have."""

import os
import re

import pytest

import __spark_entry__ as registered
from custodia.operators import policies
from custodia.registered import views

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
WRITERS = {"secured_indexed_search", "indexed_vector_search", "probed_vector_search", "full_refresh_tables", "snapshot_days", "keyed_table_upsert"}


@pytest.fixture
def plan(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def registered_plan(spark, plan, name):
    return plan(registered.queries()[name](spark, FOLDER))


@pytest.mark.parametrize("name", sorted(q for q in set(registered.queries()) - WRITERS if not re.match(r"op\d+_|pipeline$", q)))
def test_no_cross_joins(spark, plan, name):
    text = registered_plan(spark, plan, name)
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", ["recent_turns"])
def test_best_rows_are_limited_before_the_shuffle(spark, plan, name):
    text = registered_plan(spark, plan, name)
    assert "WindowGroupLimit" in text and text.index("Exchange hashpartitioning") < text.rindex("WindowGroupLimit")


def test_short_listing_is_a_top_k(spark, plan):
    text = registered_plan(spark, plan, "newest_documents")
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


@pytest.mark.parametrize("name", ["text_chunks", "token_counts", "routed_files", "label_entities", "slugs_and_refs", "document_titles"])
def test_no_python_in_the_hot_path(spark, plan, name):
    assert not re.search("InPandas|ArrowEval|BatchEval", registered_plan(spark, plan, name))


def test_scans_read_only_what_they_need(spark, plan):
    text = registered_plan(spark, plan, "rot_files")
    assert "text" not in re.search(r"ReadSchema: struct<(doc_id:bigint,n_chars[^>]*)>", text).group(1)
    chunks = registered_plan(spark, plan, "text_chunks")
    assert re.findall(r"ReadSchema: struct<([^>]*)>", chunks) == ["doc_id:bigint,text:string"]
    listed = registered_plan(spark, plan, "datasource_documents")
    assert re.search(r"PushedFilters: \[In\(source, \[src1,src3\]\)", listed)


def test_duplicates_are_never_gathered(spark, plan):
    text = plan(policies.duplicates_to_archive(views.files(spark, FOLDER)))
    assert "collect_list" not in text and "Window" not in text and "partial_count" in text


def test_quality_rules_share_one_pass(spark, plan):
    text = registered_plan(spark, plan, "quality_scorecard")
    assert text.count("FileScan") == 2 and text.count("Exchange SinglePartition") == 1
