"""Jobs composed of the operators: snapshot, volume scan, catalog sync, ingest, retrieval."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as v
from ..functions import wire
from ..functions.wire import CATEGORY_MAX, EMPLOYEE_MAX, TITLE_MAX
from ..operators import batching, catalog, matching, retrieval, vector_index
from ..operators.access import ACCESS_COLUMNS
from ..session import checkpointed
from ..sources import ndjson, tables


def run_snapshot(
    spark: SparkSession,
    export_path: str,
    table_path: str,
    ingestion_date: str,
    ingested_at: str | None = None,
    table: str | None = None,
    cap: int | None = None,
) -> bool:
    """Read an export, project it and replace the day's partition; register the table if named."""
    records = ndjson.project_file_records(ndjson.read_ndjson(spark, export_path, cap=cap))
    written = tables.write_snapshot(records, table_path, ingestion_date, ingested_at)
    if written and table:
        tables.register_table(spark, table, table_path)
    return written


def volume_metadata(
    files: DataFrame,
    submissions: DataFrame,
    results: DataFrame,
    hits: DataFrame,
    catalog_name: str,
    schema_name: str,
    volume_name: str,
    datasource_id: str,
    as_of: str,
) -> DataFrame:
    """Rows for the metadata table: hits of all jobs, matched to files and flattened, one per file.

    ``files``: batch and file columns. ``submissions``: job_id, batch. ``results``: job_id, state,
    scan_id. ``hits``: scan_id, hit_id, source. Of several hits for one file the last indexed wins.
    """
    collected = matching.collect_results(submissions, results, hits)
    keyed = collected.withColumn("file_key", matching.file_key(F.col("source"), F.col("hit_id")))
    matched = matching.match_hits(keyed, files.drop("job_id"))
    rows = matching.flatten_hits(matched, catalog_name, schema_name, volume_name, datasource_id, as_of)
    return tables.latest_per_key(rows, ["file_path"], ["indexed_at", "object_id", "raw_metadata"])


def volume_plan(files: DataFrame, max_bytes: int, max_files: int) -> DataFrame:
    """Files of a listing packed into batches: the ``batch`` column that submissions refer to."""
    packed = batching.plan_batches(files, max_bytes, max_files)
    return packed.withColumn("batch", F.col("batch").cast("string"))


def run_volume(metadata: DataFrame, path: str) -> bool:
    """Check the rows of ``volume_metadata`` against the contract of the table and upsert them by file."""
    wrong = tables.schema_differences(metadata.schema, tables.metadata_schema())
    if wrong:
        raise ValueError(f"metadata rows break the table's contract: {wrong}")
    return tables.merge_upsert(metadata, path, ["file_path"])


@dataclass(frozen=True)
class CatalogSync:
    """What one cycle writes to the catalog."""

    labels: DataFrame
    datasources: DataFrame
    edges: DataFrame
    processes: DataFrame
    stale: DataFrame


def catalog_sync(
    files: DataFrame, classifications: DataFrame, existing: DataFrame, tenant: str, link_base: str, limit: int = 0, as_of: str | None = None
) -> CatalogSync:
    """One cycle: entities of labels and datasources, edges, lineage, and the names to delete.

    ``limit`` tries the cycle on a few labels; what is stale is told from all of them.
    """
    labels = catalog.select_labels(classifications, limit)
    pairs = catalog.label_datasources(files, labels)
    datasources = checkpointed(catalog.unique_datasources(pairs))
    entities = catalog.label_entities(labels, tenant, link_base)
    return CatalogSync(
        labels=entities,
        datasources=catalog.datasource_entities(datasources, tenant, catalog.collection_refs(datasources)),
        edges=catalog.has_edges(pairs, labels, tenant, as_of),
        processes=catalog.lineage_rows(pairs, labels, datasources, tenant, link_base),
        stale=catalog.stale(existing, catalog.label_entities(catalog.select_labels(classifications), tenant, link_base), tenant),
    )


@dataclass(frozen=True)
class Ingest:
    documents: DataFrame
    chunks: DataFrame
    rejects: DataFrame


def documents_of_hits(hits: DataFrame, extractor_id: str = "1") -> DataFrame:
    """Open hit records (hit_id, file_name, category, source VARIANT) as documents with their access data."""
    source = F.col("source")
    extracted = v.variant_text(v.field(source, wire.EXTRACTED_PREFIX + extractor_id))
    return hits.select(
        F.col("hit_id").alias("document_id"),
        "file_name",
        v.variant_text(v.field(source, "title")).alias("title"),
        v.variant_text(v.field(source, wire.RAW_TEXT_KEY)).alias("text"),
        "category",
        v.variant_entitled_emails(v.field(source, wire.ACCESS_KEY)).alias("entitled_emails"),
        v.extracted_attr(extracted, "employee_id").alias("extracted_employee_id"),
    )


def ingest_documents(docs: DataFrame, embedder: Callable | None = None) -> Ingest:
    """Documents and their chunks; texts that are blank are left out, rows the table cannot hold are rejected.

    ``docs``: document_id, file_name, title, text, category, entitled_emails, extracted_employee_id.
    """
    titled = retrieval.document_rows(docs)
    reason = (
        F.when(F.length("title") > TITLE_MAX, f"title longer than {TITLE_MAX}")
        .when(F.length("category") > CATEGORY_MAX, f"category longer than {CATEGORY_MAX}")
        .when(F.length("extracted_employee_id") > EMPLOYEE_MAX, f"employee id longer than {EMPLOYEE_MAX}")
    )
    checked = titled.withColumn("reason", reason)
    documents = checked.filter("reason IS NULL").drop("reason", "file_name")
    chunks = retrieval.chunk_text(documents.select("document_id", "content"))
    chunks = chunks.select("document_id", "chunk_index", F.col("chunk").alias("content"))
    if embedder is not None:
        chunks = retrieval.embed(chunks, embedder, text="content")
    message = F.concat_ws("", F.lit(wire.INGEST_ERROR), F.col("title"), F.lit(": "), F.col("reason"))
    rejects = checked.filter("reason IS NOT NULL").select("document_id", message.alias("error"))
    return Ingest(documents, chunks, rejects)


def run_metrics(result: Ingest, shown: int = 5) -> DataFrame:
    """One row: documents, chunks, errors and the first few error texts."""
    first = result.rejects.orderBy("document_id").limit(shown)
    errors = first.agg(F.transform(F.sort_array(F.collect_list(F.struct("document_id", "error"))), lambda e: e["error"]))
    counted = result.documents.agg(F.count("*").alias("documents_processed"))
    return (
        counted.withColumn("chunks_created", result.chunks.agg(F.count("*")).scalar())
        .withColumn("n_errors", result.rejects.agg(F.count("*")).scalar())
        .withColumn("first_errors", errors.scalar())
    )


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 10,
    threshold: float = 0.2,
    max_results: int = 15,
    per_doc: int = 3,
    total: int = 15,
    index: str | None = None,
    recall: float | None = None,
) -> DataFrame:
    """Context rows for many requests at once, each seeing only what its asker may see.

    ``chunks``: chunk_id, title, chunk_index, embedding and ``ACCESS_COLUMNS``. ``queries``: one row
    per sub-query: request_id, query_id, query_pos, query, embedding, email, employee_id, groups.
    With the path of a stored ``index`` of the chunks nothing is dealt anew, and only lists that some asker may see into are
    read; results are the same, unless a ``recall`` below 1 is enough.
    """
    if index is None:
        found = retrieval.vector_search(chunks, queries, k, threshold, secured=True)
    else:
        found = vector_index.search(index, queries, k, threshold, recall, secured=True)
    info = chunks.drop("embedding", "entitled_emails", "extracted_employee_id")
    asked = queries.select("query_id", "request_id", "query_pos", "query")
    results = retrieval.described(found, info).join(asked, "query_id")
    return retrieval.context_rows(retrieval.rank_fusion(results, max_results), per_doc, total)


def retrieve_context(chunks: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.2, index: str | None = None, recall: float | None = None) -> DataFrame:
    """The context of every request as one text; ``chunks`` has ``content`` as well.

    The texts are fetched only for the few chunks that made it into a context, and requests with the same rows of context share
    one text: it is made once, and no text is shuffled by request.
    """
    rows = retrieve(chunks.drop("content"), queries, k, threshold, index=index, recall=recall)
    row = F.struct("number", *[c for c in rows.columns if c not in ("request_id", "number")])
    per_request = checkpointed(rows.groupBy("request_id").agg(F.sort_array(F.collect_list(row)).alias("listed")))  # one for each context row
    lists = checkpointed(per_request.select("listed").distinct().withColumn("context_no", F.monotonically_increasing_id()))
    listed = retrieval.described(lists.select(F.col("context_no").alias("request_id"), F.inline("listed")), chunks.select("chunk_id", "content"), rows=1000)
    texts = checkpointed(retrieval.format_context(listed).withColumnRenamed("request_id", "context_no"))
    size = texts.agg(F.coalesce(F.sum(F.length("context")), F.lit(0))).first()[0]
    mine = per_request.join(retrieval.small(lists, 1000), "listed").select("request_id", "context_no")
    asked = queries.select("request_id").distinct().join(mine, "request_id", "left")
    told = asked.join(F.broadcast(texts) if size <= retrieval.SMALL_BYTES else texts, "context_no", "left")
    return told.select("request_id", F.coalesce("context", F.lit(wire.NO_CONTEXT)).alias("context"))


def attach_documents(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with title, category and access data of their document."""
    info = docs.select("document_id", "title", *ACCESS_COLUMNS)
    return chunks.join(info, "document_id")
