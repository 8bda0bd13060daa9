"""The registered queries: every operator over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming, text, values
from ..operators import access, annotate, batching, catalog, incremental, labels, mail, matching, policies, quality, retrieval, vector_index
from ..plans import jobs
from ..session import scratch_folder
from ..sources import files, ndjson, tables
from ..streaming import streams
from . import views as view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

READER = access.Principal("user20@example.com", "E20", ("hr", "can_see_all_reviews"))
MEMBER = access.Principal("user7@example.com", "E7", ("pm",))


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def joined(column: str):
    return F.array_join(F.array_sort(column), ",").alias(column)


# --- sources and tables ---------------------------------------------------------------------


@query
def ndjson_round_trip(spark, sf):
    """Land an export, read it back as open records."""
    folder = scratch_folder(spark, "export")
    ndjson.land_raw(view.files(spark, sf).select("file_id", "size", "labels"), folder)
    record = F.col("record")
    return ndjson.read_ndjson(spark, folder).select(
        values.variant_str(values.field(record, "file_id")).alias("file_id"),
        values.variant_int(values.field(record, "size")).alias("size"),
        F.array_join(values.variant_str_array(values.field(record, "labels")), ",").alias("labels"),
    )


@query
def typed_ndjson(spark, sf):
    """S1 with a schema: a field of another type is null, its record stays; lines that aren't JSON go."""
    folder = scratch_folder(spark, "typed")
    rows = view.files(spark, sf)
    size = F.when(F.col("doc_id") % 7 == 0, F.lit('"big"')).otherwise(F.col("size").cast("string"))
    record = F.concat(F.lit('{"file_id": "'), "file_id", F.lit('", "size": '), size, F.lit("}"))
    broken = rows.filter("doc_id % 5 = 0").select(F.concat(F.lit("{broken "), "file_id").alias("value"))
    rows.select(record.alias("value")).unionByName(broken).write.text(folder)
    return ndjson.read_ndjson(spark, folder, "file_id string, size bigint")


@query
def listed_files(spark, sf):
    """Files per folder and their bytes, of a folder with one subfolder per source."""
    folder = scratch_folder(spark, "volume")
    view.files(spark, sf).select(F.col("file_id").alias("value"), "source").write.partitionBy("source").text(folder)
    found = files.list_files(spark, folder).filter("relative_path LIKE 'source=%/part-%'")
    name = F.split_part(F.split_part("relative_path", F.lit("/"), F.lit(1)), F.lit("="), F.lit(2))
    return found.groupBy(name.alias("source")).agg(F.sum("size_bytes").alias("bytes"))


@query
def schema_contract(spark, sf):
    """Files registered as a table, its differences from the metadata contract, and its rows."""
    folder = scratch_folder(spark, "registered")
    rows = view.files(spark, sf).select(F.col("path").alias("file_path"), F.col("size").cast("int").alias("file_size"), "file_name", "labels")
    rows.write.parquet(folder)
    name = tables.register_table(spark, f"spark_catalog.default.{folder.rsplit('-', 1)[1]}_files", folder)
    found = tables.schema_differences(spark.table(name).schema, tables.metadata_schema())
    n_rows = spark.read.parquet(folder).agg(F.count("*").alias("n_rows"))
    spark.sql(f"DROP TABLE {name}")
    listed = F.array(*[F.struct(F.lit(d.column).alias("column"), F.lit(d.expected).alias("expected"), F.lit(d.found).cast("string").alias("found")) for d in found])
    return n_rows.select("n_rows", F.inline(listed)).filter("column IN ('file_path', 'file_size', 'file_name', 'relative_path', 'categories')")


@query
def snapshot_job(spark, sf):
    """ST3: an export read, projected and written as a day's partition, twice."""
    export, target = scratch_folder(spark, "export"), scratch_folder(spark, "days")
    rows = view.files(spark, sf).select(F.col("file_id").alias("fileId"), F.col("file_name").alias("fileName"), "path", "size")
    ndjson.land_raw(rows, export)
    for _ in range(2):
        jobs.run_snapshot(spark, export, target, "2024-03-01", "2024-03-01 06:00:00")
    return tables.read_snapshot(spark, target, "2024-03-01").select("file_id", "file_name", "path", "size", "ingestion_date")


@query
def streamed_routing(spark, sf):
    """ST1: the same files, routed as they arrive."""
    inbox, out, state = (scratch_folder(spark, name) for name in ("inbox", "routed", "state"))
    rows = view.files(spark, sf).filter("labels IS NOT NULL").select("file_id", "category", "labels")
    rows.repartition(4).write.json(inbox)
    arriving = streams.arriving(spark, inbox, rows.schema, per_batch=2)
    streams.route_stream(arriving, ["GATED"], ["CONFIDENTIAL"], out, state).awaitTermination()
    return spark.read.parquet(out).select("file_id", "target", "action", "written_category")


@query
def streamed_sync(spark, sf):
    """ST2: events that arrive in any order, upserted cycle by cycle; the latest one per user is left."""
    inbox, target, state, failures = (scratch_folder(spark, name) for name in ("events", "synced", "state", "failed"))
    events = view.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    shuffled = F.xxhash64("event_id")
    events.repartitionByRange(6, shuffled).write.parquet(inbox)  # every cycle has late rows
    arriving = streams.arriving(spark, inbox, events.schema, fmt="parquet", per_batch=2)
    streams.sync_stream(arriving, target, ["user_id"], ["event_id"], state, failures, 8, every=None).awaitTermination()
    return tables.read_keyed(spark, target)


@query
def inferred_table_sql(spark, sf):
    """Land, infer, register, ask in SQL."""
    folder = scratch_folder(spark, "crawl")
    ndjson.land_raw(view.files(spark, sf).select("file_id", "source", "size"), folder)
    name = ndjson.register_inferred(spark, folder, f"files_{folder.rsplit('-', 1)[1]}")
    return spark.sql(f"SELECT source, count(*) AS n_files, sum(size) AS bytes FROM {name} GROUP BY source")


@query
def adhoc_listing(spark, sf):
    """The first hundred rows of a registered table."""
    name = f"exported_{scratch_folder(spark, 'listing').rsplit('-', 1)[1]}"
    view.files(spark, sf).select("file_id", "path", "size").createOrReplaceTempView(name)
    return ndjson.adhoc(spark, name, 100, "file_id")


@query
def file_record_projection(spark, sf):
    """nested records to typed scalars and JSON columns."""
    rows = view.files(spark, sf)
    record = F.struct(
        F.col("file_id").alias("fileId"),
        F.col("file_name").alias("fileName"),
        F.col("path"),
        F.col("size"),
        F.col("lang").alias("mimeType"),
        F.col("last_modified").cast("string").alias("lastModifiedAt"),
        F.col("content_sha256").alias("contentSha256"),
        F.col("labels"),
        F.struct(F.col("source").alias("id")).alias("datasource"),
        F.col("lang").alias("owner"),
    )
    projected = ndjson.project_file_records(rows.select(F.parse_json(F.to_json(record)).alias("record")))
    return projected.select(
        "file_id", "file_name", "path", "size", "mime_type", "created_at", "last_modified_at", "content_sha256", "scan_depth",
        F.get_json_object("datasource_json", "$.id").alias("datasource_id"),
        F.coalesce(F.json_array_length("labels_json"), F.lit(-1)).cast("bigint").alias("n_labels"),
        F.col("owner_json").alias("owner"),
    )


@query
def snapshot_days(spark, sf):
    """Two days written, the second twice; a day is replaced, never doubled."""
    folder = scratch_folder(spark, "snapshot")
    rows = view.files(spark, sf).select("file_id", "size")
    tables.write_snapshot(rows, folder, "2024-03-01")
    tables.write_snapshot(rows, folder, "2024-03-02")
    tables.write_snapshot(rows.withColumn("size", F.col("size") + 1), folder, "2024-03-02")
    return tables.read_snapshot(spark, folder).select("file_id", "size", "ingestion_date")


def _events_per_user(spark, sf):
    events = view.table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("state"), F.col("value"), "ts", "event_id"
    )
    return tables.latest_per_key(events, ["doc_id"], ["ts", "event_id"]).select("doc_id", "state", "value")


def _label_states(spark, sf):
    rows = view.table(spark, sf, "labels")
    return rows.select("doc_id", F.format_string("q%d", "quality").alias("state"), F.col("toxic").cast("double").alias("value"))


@query
def keyed_merge(spark, sf):
    """The latest source row per key replaces or joins the target's rows."""
    return tables.merge_rows(_label_states(spark, sf), _events_per_user(spark, sf), ["doc_id"])


@query
def keyed_table_upsert(spark, sf):
    """S10 on files: first load, then an upsert that rewrites the touched buckets."""
    folder = scratch_folder(spark, "keyed")
    tables.merge_upsert(_label_states(spark, sf), folder, ["doc_id"], 8)
    tables.merge_upsert(_events_per_user(spark, sf), folder, ["doc_id"], 8)
    return tables.read_keyed(spark, folder).select("doc_id", "state", "value")


@query
def full_refresh_tables(spark, sf):
    """Documents and chunks reloaded as one load."""
    folder = scratch_folder(spark, "refresh")
    docs = view.secured_docs(spark, sf)
    chunks = retrieval.chunk_text(docs.select("document_id", "content"))
    tables.full_refresh({"documents": docs.drop("content").withColumn("category", F.lit("old"))}, folder)
    tables.full_refresh({"documents": docs.drop("content"), "chunks": chunks}, folder)
    per_doc = tables.read_current(spark, folder, "chunks").groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    return tables.read_current(spark, folder, "documents").join(per_doc, "document_id").select("document_id", "category", "n_chunks")


@query
def exported_policy(spark, sf):
    """A policy's result as CSV with header, read back."""
    folder = scratch_folder(spark, "csv")
    ndjson.export(policies.rot_files(view.files(spark, sf)).select("file_id", "path", "size"), folder)
    return spark.read.option("header", True).schema("file_id string, path string, size bigint").csv(folder)


@query
def label_mirror(spark, sf):
    """One folder per label with its files, in no more Parquet files than the label's weight asks for."""
    folder = scratch_folder(spark, "mirror")
    ndjson.mirror_by_label(view.files(spark, sf).select("file_id", "size", "labels"), folder, rows_per_file=200)
    rows = spark.read.parquet(folder).withColumn("file", F.input_file_name())
    held = rows.groupBy("label").agg(F.count_distinct("file").alias("files"), F.ceil(F.count("*") / 200).alias("needed"))
    bounded = held.select("label", (F.col("files") <= 2 * F.col("needed")).alias("few_files"))
    return rows.join(bounded, "label").select("label", "file_id", "size", "few_files")


@query
def scan_hits(spark, sf):
    """All hits of one scan, best first; the scan is what the operator is asked for."""
    return matching.hits_for_scan(view.hits(spark, sf), "1").select("hit_id", "score")


@query
def datasource_documents(spark, sf):
    """Documents of the datasources the operator is asked for."""
    docs = view.table(spark, sf, "documents").withColumnRenamed("source", "datasource_id")
    return matching.docs_for_datasources(docs, ["src1", "src3"]).select("doc_id", "datasource_id", "n_chars")


# --- functions ------------------------------------------------------------------------------


@query
def typed_values(spark, sf):
    """loose text to typed values."""
    rows = view.table(spark, sf, "part")
    padded = F.concat(F.lit(" \t"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")), F.lit("\n "))
    word = F.element_at(F.array(*[F.lit(w) for w in ["YES", " no ", "True", "0", "maybe"]]), (F.col("p_size") % 5 + 1).cast("int"))
    return rows.select(
        "p_partkey",
        values.int_or_null(F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("brand_number"),
        values.int_or_null(F.col("p_name")).alias("name_number"),
        values.str_or_null(padded).alias("type_text"),
        values.bool_or_null(word).cast("int").alias("flag"),
        values.first_truthy(F.when(F.col("p_size") % 2 == 0, F.lit("")), F.col("p_name")).alias("first_name"),
        F.array_join(values.parse_list(F.concat(F.replace("p_name", F.lit(" "), F.lit(" ,, ")), F.lit(","))), "|").alias("words"),
        F.size(values.parse_int_list(F.concat_ws(",", F.col("p_size").cast("string"), F.split_part("p_brand", F.lit("#"), F.lit(2))))).cast("bigint").alias("n_ints"),
    )


@query
def object_keys(spark, sf):
    """Bucket notifications to decoded keys and names, joined with results by key."""
    pages = view.table(spark, sf, "pages")
    s3 = F.struct(
        F.struct(F.lit("intake").alias("name")).alias("bucket"),
        F.struct(F.concat(F.lit("in+box/"), F.url_encode("url")).alias("key")).alias("object"),
    )
    events = pages.select(F.array(F.struct(s3.alias("s3"))).alias("Records"))
    results = pages.select(F.concat(F.lit("in box/"), "url").alias("object_key"), F.length("html").cast("bigint").alias("size"))
    return labels.attach_labels(labels.object_events(events), results).select("bucket", "object_key", "file_name", "size")


@query
def slugs_and_refs(spark, sf):
    """reference names."""
    url, ident = F.col("url"), F.col("page_id").cast("string")
    return view.table(spark, sf, "pages").select(
        "page_id",
        naming.slug(url).alias("slug"),
        naming.normalize_ref(url).alias("normalized"),
        naming.collection_ref(url, ident).alias("short_ref"),
        naming.collection_ref(url, url).alias("long_ref"),
        naming.collection_ref(F.lit("  "), ident).alias("blank_ref"),
        naming.group_ref(ident).alias("group_ref"),
        naming.group_ref(F.concat(url, url)).alias("long_group_ref"),
    )


@query
def qualified_names(spark, sf):
    """Names of catalog entities, taken apart again, and links."""
    tenant, ident = F.col("lang"), F.col("doc_id").cast("string")
    rows = view.files(spark, sf).select(
        "doc_id",
        naming.tag_qn(tenant, ident).alias("tag"),
        naming.datasource_qn(tenant, F.col("source")).alias("datasource"),
        naming.process_qn(tenant, F.col("source"), ident).alias("process"),
        naming.abs_link(view.LINK_BASE, F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("/f/"), ident)).otherwise("")).alias("link"),
    )
    return rows.select(
        "*", naming.qn_tenant(F.col("datasource")).alias("parsed_tenant"), naming.qn_id(F.col("datasource")).alias("parsed_id")
    )


@query
def entitled_emails(spark, sf):
    """e-mails of JSON entries; entries without one are skipped."""
    entry = F.to_json(F.struct(F.format_string("user%d@example.com", "user_id").alias("email")))
    emails = values.entitled_emails(F.array("props", entry, F.lit("not json"), F.lit('{"email":""}')))
    return view.table(spark, sf, "events").select("event_id", F.array_join(emails, ",").alias("emails"))


@query
def extracted_attributes(spark, sf):
    """one attribute of a JSON string."""
    return view.table(spark, sf, "events").select("event_id", values.extracted_attr(F.col("props"), "k").alias("k"))


@query
def document_titles(spark, sf):
    """documents with text, their title and preview."""
    lang = F.col("lang")
    docs = view.table(spark, sf, "documents").select(
        "doc_id",
        F.when(lang == "en", F.format_string("doc_%d", "doc_id")).when(lang == "fr", "").alias("file_name"),
        F.when(lang != "de", F.concat(F.lit("on "), "source")).alias("title"),
        F.when(lang == "es", " \n\t").otherwise(F.col("text")).alias("text"),
    )
    rows = retrieval.document_rows(docs)
    return rows.select("doc_id", "title", F.md5(text.preview(F.col("content")).cast("binary")).alias("preview_md5"))


@query
def token_counts(spark, sf):
    """tokens of each text and the text cut to a hundred of them."""
    body = F.col("text")
    return view.table(spark, sf, "documents").select(
        "doc_id",
        text.token_count(body).alias("n_tokens"),
        F.md5(text.truncate_tokens(body, 100).cast("binary")).alias("cut_md5"),
    )


@query
def principal_groups(spark, sf):
    """groups of a principal as one text."""
    return view.principals(spark, sf).select("email", "employee_id", text.joined_groups(F.col("groups")).alias("groups"))


# --- access ---------------------------------------------------------------------------------


@query
def visible_documents(spark, sf):
    """What one member may see, newest first."""
    rows = access.list_documents(view.secured_docs(spark, sf), MEMBER)
    return rows.withColumn("created_at", F.col("created_at").cast("string"))


@query
def visible_documents_reader(spark, sf):
    """A reader of all reviews, with the policy's looser matching."""
    docs = view.secured_docs(spark, sf)
    return access.apply_entitlements(docs, READER, compat=True).select("document_id", "category")


@query
def newest_documents(spark, sf):
    """The twenty newest documents a member may see, with previews."""
    rows = access.list_documents(view.secured_docs(spark, sf), MEMBER, limit=20)
    preview = F.md5(F.col("content_preview").cast("binary")).alias("preview_md5")
    return rows.select("document_id", "title", F.col("created_at").cast("string").alias("created_at"), preview)


def _chunks(spark, sf):
    docs = view.secured_docs(spark, sf).select("document_id", "content")
    return retrieval.chunk_text(docs).select("document_id", "chunk_index", "chunk")


@query
def visible_chunks(spark, sf):
    """Chunks of documents the member may see."""
    chunks = _chunks(spark, sf).select("document_id", "chunk_index")
    return access.secure_chunks(chunks, view.secured_docs(spark, sf), MEMBER)


@query
def access_grants(spark, sf):
    """The policy as a list of grants."""
    return access.access_grants(view.secured_docs(spark, sf))


@query
def entitlement_pairs(spark, sf):
    """Documents granted to each principal in person."""
    return access.entitlement_pairs(view.secured_docs(spark, sf), view.principals(spark, sf))


@query
def visible_counts(spark, sf):
    """How many documents each principal may see."""
    return access.visible_counts(view.secured_docs(spark, sf), view.principals(spark, sf))


@query
def document_totals(spark, sf):
    """A3: documents and chunks a member may see, and all of them."""
    docs, chunks = view.secured_docs(spark, sf), _chunks(spark, sf)
    seen = access.document_totals(docs, chunks, MEMBER).withColumn("scope", F.lit("member"))
    return seen.unionByName(access.document_totals(docs, chunks).withColumn("scope", F.lit("all")))


@query
def category_counts(spark, sf):
    """A4: documents per category."""
    return access.category_counts(view.secured_docs(spark, sf))


@query
def known_requests(spark, sf):
    """Requests with their user's profile."""
    asked = view.table(spark, sf, "part").select("p_partkey", F.format_string("user%d@example.com", "p_partkey").alias("email"))
    return access.resolve_principals(asked, view.principals(spark, sf)).select("p_partkey", "email", "employee_id")


@query
def unknown_requests(spark, sf):
    """Requests nobody may make."""
    asked = view.table(spark, sf, "part").select("p_partkey", F.format_string("user%d@example.com", "p_partkey").alias("email"))
    return access.unknown_requests(asked, view.principals(spark, sf))


# --- labels, policies, quality --------------------------------------------------------------


@query
def label_tests(spark, sf):
    """Any of some labels; one label without another."""
    names = F.col("labels")
    return view.files(spark, sf).select(
        "file_id",
        labels.has_any_label(names, ["ROT", "CONFIDENTIAL"]).cast("int").alias("any_label"),
        labels.label_gap(names, "CONFIDENTIAL", "GATED").cast("int").alias("gap"),
    )


@query
def duplicate_groups(spark, sf):
    """A1: content held by several files."""
    return policies.duplicate_groups(view.files(spark, sf))


@query
def duplicates_to_archive(spark, sf):
    """All but one file of each group."""
    return policies.duplicates_to_archive(view.files(spark, sf)).select("file_id", "path", "content_sha256", "keep_id")


@query
def remediation_plan(spark, sf):
    """Where duplicates would be moved."""
    return policies.remediation_plan(policies.duplicates_to_archive(view.files(spark, sf)), "/archive")


@query
def retention_gaps(spark, sf):
    """Records past seven years."""
    rows = policies.retention_gaps(view.files(spark, sf), view.AS_OF)
    return rows.select("file_id", F.col("last_modified").cast("string").alias("last_modified"))


@query
def rot_files(spark, sf):
    """Files to clean up."""
    return policies.rot_files(view.files(spark, sf)).select("file_id", "size")


@query
def routed_files(spark, sf):
    """Where each classified file goes."""
    classified = view.files(spark, sf).filter("labels IS NOT NULL")
    return labels.route(classified, ["GATED"], ["CONFIDENTIAL"]).select("file_id", "target", "action", "written_category")


GAP = "array_contains(labels, 'CONFIDENTIAL') AND NOT array_contains(labels, 'GATED')"


@query
def rule_count(spark, sf):
    """A rule that counts violations."""
    return quality.rule_row_count(view.files(spark, sf), GAP).withColumn("passed", F.col("passed").cast("int"))


@query
def quality_scorecard(spark, sf):
    """A rule set in one pass."""
    rules = [
        quality.ColumnExists("labels are there", "labels"),
        quality.ColumnExists("owners are there", "owner"),
        quality.RowCount("confidential is gated", GAP),
        quality.RowCount("no empty file", "size = 0"),
        quality.RowCount("owner known", "owner IS NULL"),
        quality.RowCount("some labelled", "labels IS NOT NULL", ">", 10),
    ]
    return quality.evaluate_ruleset(view.files(spark, sf), rules)


def _dictionary(spark, sf):
    return view.table(spark, sf, "benchmark").select(
        F.format_string("annotator-%d", F.col("item_id") % 5).alias("annotator"), F.col("text").alias("keyword")
    )


@query
def dictionary_hits(spark, sf):
    """Phrases of a dictionary found in the documents."""
    return annotate.annotate(view.table(spark, sf, "documents"), _dictionary(spark, sf))


@query
def small_dictionary_hits(spark, sf):
    """D12 with a handful of words: the language codes."""
    docs = view.table(spark, sf, "documents")
    words = docs.select(F.lit("codes").alias("annotator"), F.upper("lang").alias("keyword")).distinct()
    return annotate.annotate(docs, words)


@query
def labels_from_rules(spark, sf):
    """Labels given by annotator hits."""
    found = annotate.annotate(view.table(spark, sf, "documents"), _dictionary(spark, sf))
    rules = _dictionary(spark, sf).select("annotator").distinct()
    rules = rules.withColumn("label", F.concat(F.lit("Found by "), "annotator"))
    rules = rules.unionByName(rules.withColumn("label", F.lit("Leaked")))
    return annotate.apply_label_rules(found, rules).withColumn("labels", F.array_join("labels", ","))


# --- hits and batches -----------------------------------------------------------------------


def _keyed_hits(spark, sf):
    rows = view.hits(spark, sf)
    return rows.withColumn("file_key", matching.file_key(F.col("source"), F.col("hit_id")))


@query
def matched_hits(spark, sf):
    """Hits and the files they belong to."""
    matched = matching.match_hits(_keyed_hits(spark, sf), view.submitted(spark, sf).drop("job_id"))
    return matched.select("hit_id", "batch", "relative_path", "size_bytes")


def _jobs(spark, sf):
    batches = view.submitted(spark, sf).select("batch", "job_id").distinct()
    number = F.col("batch").cast("bigint")
    results = batches.select(
        "job_id",
        F.when(number % 3 == 2, "FAILED").otherwise("FINISHED").alias("state"),
        F.when(number % 4 != 1, F.col("batch")).alias("scan_id"),
    )
    return batches, results


@query
def collected_results(spark, sf):
    """Hits of all jobs that have a scan id."""
    submissions, results = _jobs(spark, sf)
    found = matching.collect_results(submissions, results, view.hits(spark, sf).drop("batch"))
    return found.select("job_id", "state", "scan_id", "hit_id")


@query
def rejected_jobs(spark, sf):
    """Jobs to look at."""
    return matching.rejected_jobs(*_jobs(spark, sf)).select("job_id", "reason")


def _metadata(spark, sf, as_of="2024-01-01 00:00:00"):
    submissions, results = _jobs(spark, sf)
    hits = view.hits(spark, sf).drop("batch")
    return jobs.volume_metadata(view.submitted(spark, sf), submissions, results, hits, "main", "files", "inbox", "ds-1", as_of)


@query
def volume_metadata(spark, sf):
    """The metadata rows of all jobs, one per file."""
    return _shown_metadata(_metadata(spark, sf))


@query
def volume_table(spark, sf):
    """The volume job's end, S9 and S10: rows checked and upserted, twice; the second run replaces the first's rows."""
    folder = scratch_folder(spark, "volume-table")
    jobs.run_volume(_metadata(spark, sf, "2023-01-01 00:00:00"), folder)
    jobs.run_volume(_metadata(spark, sf), folder)
    return _shown_metadata(tables.read_keyed(spark, folder))


def _shown_metadata(rows):
    return rows.select(
        "file_path", "relative_path", "file_size", "modification_time", "datasource_id", "datasource_scan_id", "job_id",
        "file_name", "object_id", "sha256", "doc_language", "folder_id",
        F.col("is_processed").cast("int").alias("is_processed"),
        F.col("ocr_used").cast("int").alias("ocr_used"),
        F.array_join("dxr_tags", ",").alias("tags"),
        F.array_join("categories", ",").alias("categories"),
        F.size("removed_tags").cast("bigint").alias("n_removed"),
        F.get_json_object("annotation_stats_json", "$.annotation_stats#size").cast("bigint").alias("stats_size"),
        F.col("collected_at").cast("string").alias("collected_at"),
    )


@query
def batch_plan(spark, sf):
    """Documents packed into batches, in path order."""
    files = view.files(spark, sf).select("path", "size")
    return batching.plan_batches(files, 200_000, 25, path="path", size="size")


@query
def large_batch_plan(spark, sf):
    """Few and long batches, up to a million files each, over blocks far shorter than a batch."""
    files = view.files(spark, sf).select("path", "size")
    return batching.plan_batches(files, 500_000, 1_000_000, path="path", size="size", block=16)


# --- catalog --------------------------------------------------------------------------------


def _labels(spark, sf):
    return catalog.select_labels(view.classifications(spark, sf))


def _pairs(spark, sf):
    return catalog.label_datasources(view.tagged_files(spark, sf), _labels(spark, sf))


@query
def selected_labels(spark, sf):
    """Only labels."""
    return _labels(spark, sf).select("id", "name", "type")


@query
def label_datasources(spark, sf):
    """Datasources of each label, by id, else by name."""
    return _pairs(spark, sf).select("label_id", F.col("ds.id").alias("ds_id"), F.col("ds.name").alias("ds_name"), F.col("ds.connector_id").alias("connector_id"))


@query
def unique_datasources(spark, sf):
    """A2: each datasource as its last label saw it."""
    return catalog.unique_datasources(_pairs(spark, sf))


@query
def hit_counts(spark, sf):
    """A10: documents per datasource and label."""
    files = view.files(spark, sf).withColumnRenamed("source", "datasource_id")
    return catalog.hit_counts(files)


@query
def collection_members(spark, sf):
    """Datasources by the collection they go to."""
    sources = catalog.unique_datasources(_pairs(spark, sf))
    return catalog.by_collection(sources, catalog.collection_refs(sources)).select("collection_ref", "id", "collection_size")


@query
def label_entities(spark, sf):
    """Entities of labels."""
    return catalog.label_entities(_labels(spark, sf), view.TENANT, view.LINK_BASE)


@query
def datasource_entities(spark, sf):
    """Entities of datasources."""
    return catalog.datasource_entities(catalog.unique_datasources(_pairs(spark, sf)), view.TENANT)


@query
def has_edges(spark, sf):
    """Edges from datasources to labels."""
    edges = catalog.has_edges(_pairs(spark, sf), _labels(spark, sf), view.TENANT, "2024-06-01")
    return edges.withColumn("document_count", F.col("document_count").cast("bigint"))


@query
def lineage_rows(spark, sf):
    """Lineage processes with their texts."""
    pairs = _pairs(spark, sf)
    return catalog.lineage_rows(pairs, _labels(spark, sf), catalog.unique_datasources(pairs), view.TENANT, view.LINK_BASE)


def _existing(spark, sf):
    """What the catalog holds: an entity per label or annotator name and per nation."""
    names = view.classifications(spark, sf).select("id").unionByName(
        view.table(spark, sf, "nation").select(F.col("n_name").alias("id"))
    )
    return names.select(
        F.lit("unstructured_dataset").alias("type_name"),
        naming.tag_qn(F.lit(view.TENANT), F.col("id")).alias("qualified_name"),
        F.concat(F.lit("old "), "id").alias("name"),
        F.lit(view.TENANT).alias("tenant"),
    )


@query
def entity_lookup(spark, sf):
    """Entities by type and name."""
    wanted = catalog.label_entities(_labels(spark, sf), view.TENANT, view.LINK_BASE).select("type_name", "qualified_name")
    return catalog.lookup_by_name(_existing(spark, sf), wanted).select("qualified_name", "name")


@query
def entity_search(spark, sf):
    """Entities by an attribute."""
    return catalog.lookup_by_attribute(_existing(spark, sf), "unstructured_dataset", "tenant", view.TENANT).select("qualified_name")


@query
def stale_entities(spark, sf):
    """Names that no longer come in."""
    incoming = catalog.label_entities(_labels(spark, sf), view.TENANT, view.LINK_BASE)
    return catalog.stale(_existing(spark, sf), incoming, view.TENANT)


@query
def catalog_cycle(spark, sf):
    """What the catalog holds after one cycle."""
    existing = _existing(spark, sf)
    done = jobs.catalog_sync(view.tagged_files(spark, sf), view.classifications(spark, sf), existing, view.TENANT, view.LINK_BASE)
    shown = ["qualified_name", "type_name", "name", "change"]
    kept = catalog.apply_deletes(catalog.upsert_entities(existing, done.labels), done.stale).select(*shown)
    new = done.datasources.withColumn("change", F.lit("created")).select(*shown)
    processes = done.processes.withColumn("change", F.lit("created")).select(*shown)
    edges = done.edges.select(
        F.concat_ws(" ", "datasource_qn", "label_qn").alias("qualified_name"),
        F.col("relation").alias("type_name"),
        F.lit(None).cast("string").alias("name"),
        F.lit("created").alias("change"),
    )
    return kept.unionByName(new).unionByName(processes).unionByName(edges)


@query
def incremental_cycle(spark, sf):
    """What a second cycle has to write after a first one, and a third, equal one: nothing."""
    state = scratch_folder(spark, "fingerprints")
    files = view.files(spark, sf).select(F.col("file_id").alias("qualified_name"), "source", "labels", "doc_id")
    incremental.changes(files.drop("doc_id"), state).remember()
    moved = F.when(F.col("doc_id") % 13 == 0, F.lit("elsewhere")).otherwise(F.col("source"))
    next_ = files.filter("doc_id % 11 <> 0").withColumn("source", moved)
    added = files.filter("doc_id % 17 = 0").withColumn("qualified_name", F.concat(F.lit("new "), "qualified_name"))
    next_ = next_.unionByName(added).drop("doc_id")
    second = incremental.changes(next_, state)
    second.remember()
    third = incremental.changes(next_, state)
    done = second.rows.select(F.lit(2).alias("cycle"), "qualified_name", "change").unionByName(third.rows.select(F.lit(3).alias("cycle"), "qualified_name", "change"))
    untouched = next_.join(second.rows, "qualified_name", "left_anti").select(F.lit(2).alias("cycle"), "qualified_name", F.lit("untouched").alias("change"))
    return done.unionByName(untouched)


@query
def embedded_loads(spark, sf):
    """Two loads of chunks; the second embeds only texts that are new, and drops vectors of texts that are gone."""
    store = scratch_folder(spark, "vectors")
    docs = view.secured_docs(spark, sf).select("document_id", "content")
    first = incremental.embed_load(_chunks(spark, sf), store, "one")
    edited = F.when(F.col("document_id") % 3 == 0, F.concat("content", F.lit(" edited"))).otherwise(F.col("content"))
    chunks = retrieval.chunk_text(docs.withColumn("content", edited))
    second = incremental.embed_load(chunks, store, "two", "one")
    shown = lambda load, done: done.chunks.filter("embedding IS NOT NULL").agg(
        F.lit(load).alias("load"), F.count("*").alias("n_chunks"), F.lit(done.embedded).cast("bigint").alias("embedded"), F.lit(done.dropped).cast("bigint").alias("dropped")
    )
    return shown(1, first).unionByName(shown(2, second))


@query
def entity_upsert(spark, sf):
    """Created, updated and kept rows of a keyed upsert."""
    target = view.table(spark, sf, "labels").select(F.col("doc_id").alias("qualified_name"), "quality", "toxic")
    source = view.table(spark, sf, "embeddings").select(F.col("vec_id").alias("qualified_name"), F.col("label").alias("quality"))
    return catalog.upsert_entities(target, source)


@query
def merged_schema(spark, sf):
    """Rows with the attributes of both sides."""
    old = view.table(spark, sf, "labels").select("doc_id", "quality")
    new = view.table(spark, sf, "labels").select("doc_id", "toxic")
    return catalog.merge_schema(old, new)


@query
def edge_upsert(spark, sf):
    """U4: attributes overlaid, inputs and outputs united."""

    def edges(df, ident, attributes, inputs):
        name = F.col(ident).cast("string")
        return df.select(name.alias("qualified_name"), attributes.alias("attributes"), inputs.alias("inputs"), F.array(name).alias("outputs"))

    text_of = lambda c: F.col(c).cast("string")
    old = edges(view.table(spark, sf, "labels"), "doc_id", F.create_map(F.lit("count"), text_of("quality"), F.lit("toxic"), text_of("toxic")), F.array(F.lit("a")))
    new = edges(view.table(spark, sf, "embeddings"), "vec_id", F.create_map(F.lit("count"), text_of("label")), F.array(F.lit("b"), F.lit("a")))
    merged = catalog.upsert_edges(old, new)
    return merged.select(
        "qualified_name",
        F.col("attributes")["count"].alias("n"),
        F.col("attributes")["toxic"].alias("toxic"),
        joined("inputs"),
        joined("outputs"),
    )


@query
def united_label_files(spark, sf):
    """The file lists of all labels as one."""
    rows = view.files(spark, sf)
    lists = [rows.filter(labels.has_any_label(F.col("labels"), [n])).select("file_id", F.lit(n).alias("label")) for n in ("GATED", "ROT", "CONFIDENTIAL")]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


# --- retrieval ------------------------------------------------------------------------------


@query
def text_chunks(spark, sf):
    """Overlapping chunks of whole texts."""
    chunks = _chunks(spark, sf)
    return chunks.select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query
def character_chunks(spark, sf):
    """Chunks by another tokenizer, here of single characters."""
    docs = view.table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    chunks = retrieval.chunk_text(docs, max_tokens=1000, overlap=100, tokenizer=lambda column: F.split(column, ""))
    return chunks.select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query
def chunk_documents(spark, sf):
    """Chunks with what is known of their document."""
    chunks = _chunks(spark, sf).select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.length("chunk").cast("bigint").alias("n_chars"))
    return jobs.attach_documents(chunks, view.secured_docs(spark, sf)).select("document_id", "chunk_index", "n_chars", "title", "category")


@query
def ingest_counts(spark, sf):
    """Documents, chunks and rejects per source."""
    result = jobs.ingest_documents(_ingest_input(spark, sf))
    chunks = result.chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    done = result.documents.join(chunks, "document_id").select("document_id", F.length("title").cast("bigint").alias("title_length"), "n_chunks")
    rejected = result.rejects.select("document_id", F.lit(-1).cast("bigint").alias("title_length"), F.lit(0).cast("bigint").alias("n_chunks"))
    return done.unionByName(rejected)


@query
def ingest_metrics(spark, sf):
    """The run's numbers and its first errors."""
    metrics = jobs.run_metrics(jobs.ingest_documents(_ingest_input(spark, sf)))
    return metrics.withColumn("first_errors", F.md5(F.array_join("first_errors", "\n").cast("binary")))


def _ingest_input(spark, sf):
    """Documents titled by their first line, which is too long for some of them."""
    return view.secured_docs(spark, sf).select(
        "document_id",
        F.lit(None).cast("string").alias("file_name"),
        F.split_part("content", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("content").alias("text"),
        "category",
        "entitled_emails",
        "extracted_employee_id",
    )


@query
def embedded_chunks(spark, sf):
    """A vector for every chunk."""
    vectors = retrieval.embed(_chunks(spark, sf))
    cells = F.transform("embedding", lambda x: F.round(x.cast("double") * 1_000_000).cast("bigint"))
    return vectors.select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.md5(F.array_join(cells, ",").cast("binary")).alias("vector_md5"))


def _row_queries(spark, sf):
    """Every vector whose id is divisible by 20, asked against all."""
    return view.table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _scored(found):
    rank = F.col("rank").cast("bigint").alias("rank")
    return found.select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), rank)


@query
def vector_search(spark, sf):
    """The chunks nearest to every twentieth of them."""
    chunks = view.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return _scored(retrieval.vector_search(chunks, _row_queries(spark, sf), k=10))


@query
def vector_search_secured(spark, sf):
    """J6 with P2: every principal's questions, over the chunks the principal may see."""
    return _scored(retrieval.vector_search(view.vec_chunks(spark, sf), view.requests(spark, sf), k=10, secured=True))


def _index(spark, sf):
    folder = scratch_folder(spark, "ivf")
    retrieval.build_ivf(view.vec_chunks(spark, sf), folder, lists=20)
    return folder


@query
def indexed_vector_search(spark, sf):
    """The same search through inverted lists, with the exact second round."""
    return _scored(retrieval.ivf_search(_index(spark, sf), _row_queries(spark, sf), k=10, nprobe=4))


def _stored_index(spark, sf):
    folder = scratch_folder(spark, "index")
    vector_index.build(view.vec_chunks(spark, sf), folder, lists=20)
    return folder


@query
def probed_vector_search(spark, sf):
    """As many lists and vectors as the index's calibration asks for. Are the similarities right, nine tenths of the true ten
    found over all queries, and less than a third of the vectors scored?"""
    folder, asked = _stored_index(spark, sf), _row_queries(spark, sf)
    found = vector_index.search(folder, asked, k=10, recall=0.95).select("query_id", "chunk_id", "similarity")
    true = retrieval.vector_search(view.vec_chunks(spark, sf), asked, k=10).select("query_id", "chunk_id", F.col("similarity").alias("true_similarity"))
    met = true.join(found, ["query_id", "chunk_id"], "left")
    right = F.coalesce(F.abs(F.col("similarity") - F.col("true_similarity")) < 1e-6, F.lit(True))
    _, depth = vector_index.plan_for(spark, folder, 0.95)
    vectors = view.table(spark, sf, "embeddings").agg(F.count("*")).scalar()
    return met.agg(
        F.count_distinct("query_id").alias("n_queries"),
        F.count("*").alias("n_true"),
        F.min(right).alias("similarities_right"),
        (F.count("similarity") >= 0.9 * F.count("*")).alias("recalled"),
        (F.lit(3 * depth) < F.any_value(vectors)).alias("few_scored"),
    )


@query
def secured_indexed_search(spark, sf):
    """J7 with P2: every principal's questions through the index, over the chunks the principal may see."""
    return _scored(retrieval.ivf_search(_index(spark, sf), view.requests(spark, sf), k=10, nprobe=4, secured=True))


def _results(spark, sf):
    chunks, asked = view.vec_chunks(spark, sf), view.requests(spark, sf)
    found = retrieval.vector_search(chunks, asked, k=10, secured=True)
    info = chunks.select("chunk_id", "title", "chunk_index", "category")
    return retrieval.described(found, info).join(asked.select("query_id", "request_id", "query_pos", "query"), "query_id")


@query
def rank_fusion(spark, sf):
    """A5: results of three questions merged per request."""
    fused = retrieval.rank_fusion(_results(spark, sf))
    return fused.select("request_id", "chunk_id", F.col("position").cast("bigint").alias("position"), F.round("score", 6).alias("score"), F.array_join("matching_queries", ",").alias("queries"))


@query
def secured_retrieval(spark, sf):
    """Context rows of every principal's request."""
    rows = jobs.retrieve(view.vec_chunks(spark, sf), view.requests(spark, sf))
    return rows.select("request_id", F.col("number").cast("bigint").alias("number"), "title", "chunk_id", F.round("score", 6).alias("score"))


@query
def indexed_retrieval(spark, sf):
    """The same context rows from a stored index, which holds the policy."""
    chunks = view.vec_chunks(spark, sf)
    rows = jobs.retrieve(chunks, view.requests(spark, sf), index=_stored_index(spark, sf))
    return rows.select("request_id", F.col("number").cast("bigint").alias("number"), "title", "chunk_id", F.round("score", 6).alias("score"))


@query
def context_texts(spark, sf):
    """The context of every request as the text that is handed on, made of the texts of chunks."""
    chunks = view.text_chunks(spark, sf, _chunks(spark, sf))
    texts = jobs.retrieve_context(chunks, view.requests(spark, sf))
    return texts.select("request_id", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query
def recent_turns(spark, sf):
    """The last turns of every conversation."""
    turns = view.table(spark, sf, "conversations")
    last = retrieval.recent_turns(turns, 3, user="conv_id")
    return last.select("conv_id", "turn", "role", F.col("turn_number").cast("bigint").alias("turn_number"))


# --- mail -----------------------------------------------------------------------------------


@query
def first_blocked_labels(spark, sf):
    """The first blocked label of each message."""
    name = F.format_string("line_%d_%d.txt", "att_pos.l_linenumber", "att_pos.l_partkey")
    tagged = view.mail_labels(spark, sf).withColumn("filename", name)
    return mail.first_blocked(tagged, view.blocked_labels(spark)).select("message_id", "filename", "name", "message")


@query
def mail_attachments(spark, sf):
    """Attachments of multipart mails, one for each document; one without content doesn't count."""
    docs = view.table(spark, sf, "documents")

    def part(name, content):
        head = F.concat(F.lit('--limit\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename="'), name, F.lit('"\r\nContent-Transfer-Encoding: base64\r\n\r\n'))
        return F.concat(head, F.base64(content), F.lit("\r\n"))

    top = F.lit('From: a@example.com\r\nTo: b@example.com\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="limit"\r\n\r\n')
    body = F.lit("--limit\r\nContent-Type: text/plain\r\n\r\nbody\r\n")
    parts = [part(F.lit("empty.txt"), F.lit(b"")), part(F.concat("source", F.lit(".txt")), F.col("source").cast("binary")), part(F.format_string("doc_%d.txt", "doc_id"), F.col("text").cast("binary"))]
    raw = docs.select(F.col("doc_id").cast("string").alias("path"), F.concat(top, body, *parts, F.lit("--limit--\r\n")).cast("binary").alias("content"))
    found = mail.extract_attachments(raw)
    return found.select("message_id", F.col("pos").cast("bigint").alias("pos"), "filename", F.md5("content").alias("content_md5"))


@query
def mail_verdicts(spark, sf):
    """Code and reply for every message."""
    verdicts = mail.mail_gate(
        view.mail_messages(spark, sf), view.mail_attachments(spark, sf), view.mail_labels(spark, sf), view.blocked_labels(spark)
    )
    return verdicts.withColumn("classification_error", F.col("classification_error").cast("int"))


@query
def late_mail_verdicts(spark, sf):
    """ST4: the same verdicts when mails and classifications are two streams; a classification that failed is an answer that never comes."""
    inbox, desk, out, state = (scratch_folder(spark, name) for name in ("mails", "answers", "verdicts", "state"))
    mails, parts, named = view.mail_messages(spark, sf), view.mail_attachments(spark, sf), view.mail_labels(spark, sf)
    at = lambda column: F.timestamp_seconds(F.lit(1_700_000_000) + column)
    held = parts.groupBy("message_id").agg(F.collect_list(F.struct("att_pos", "filename")).alias("attachments"))
    sent = mails.join(held, "message_id", "left").withColumn("arrived", at(F.col("message_id") % 600))
    sound = parts.filter("NOT classification_error").select("message_id", "att_pos")
    told = named.join(sound, ["message_id", "att_pos"]).groupBy("message_id", "att_pos").agg(F.collect_list(F.struct("hit_pos", "label_pos", "name")).alias("labels"))
    told = told.withColumn("answered", at(F.col("message_id") % 600 + 30 + F.col("message_id") % 3000))  # up to 50 minutes later
    # a last mail and a last answer, a day later, move the clocks of both streams on; all files are one batch
    last = spark.range(1).select(F.lit(-1).cast("bigint").alias("message_id"), at(F.lit(86_400)).alias("arrived"), F.lit("x").alias("sender"))
    end = spark.range(1).select(F.lit(-1).cast("bigint").alias("message_id"), at(F.lit(172_800)).alias("answered"))
    with streams.settings(spark, streams.CLEANED):
        sent.unionByName(last, allowMissingColumns=True).write.option("compression", "zstd").parquet(inbox)
        told.unionByName(end, allowMissingColumns=True).write.option("compression", "zstd").parquet(desk)
    arriving = lambda folder: streams.arriving(spark, folder, spark.read.parquet(folder).schema, fmt="parquet", per_batch=1_000_000)
    streams.late_label_gate(arriving(inbox), arriving(desk), view.blocked_labels(spark), out, state, "1 hour").awaitTermination()
    verdicts = spark.read.parquet(out).filter("message_id >= 0").drop("batch")
    return verdicts.withColumn("classification_error", F.col("classification_error").cast("int"))
