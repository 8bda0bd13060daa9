"""Matching classifier hits to the files that were submitted, and flattening them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wire
from ..functions import values as v
from ..functions.naming import basename
from ..sources.tables import metadata_schema

KINDS = {"int": v.variant_int, "str": v.variant_str, "list": v.variant_str_array, "bool": v.variant_bool}


def hits_for_scan(hits: DataFrame, scan_id: str) -> DataFrame:
    """All hits of one scan, best score first."""
    return hits.filter(F.col("scan_id") == scan_id).orderBy(F.col("score").desc(), F.col("hit_id").asc())


def docs_for_datasources(docs: DataFrame, datasource_ids: list[str]) -> DataFrame:
    return docs.filter(F.col("datasource_id").isin(datasource_ids))


def file_key(record: Column, hit_id: Column) -> Column:
    """The name a hit gives its file: the first of several keys that is not empty."""
    return v.first_truthy(*[v.field(record, key, "string") for key in wire.FILE_KEYS], hit_id)


def match_hits(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits joined to the files of their batch: by exact relative path, else by base name.

    ``hits`` has ``batch, hit_id, file_key``; ``files`` has ``batch, relative_path`` and more. With
    several files of one base name the first by path is taken; hits of unknown files are dropped. A path that
    is listed twice in a batch is one file.

    The second join has a key of its own, so its shuffle is not the aggregate's and AQE can split a
    base name that most hits share; hits that found their path go through it under their own id.
    """
    whole = F.max(F.struct(*[c for c in files.columns if c != "batch"])).alias("file")
    named = files.groupBy("batch", "relative_path").agg(whole).select("batch", "file")
    exact = named.withColumn("file_key", F.col("file.relative_path"))
    tried = hits.join(exact, ["batch", "file_key"], "left")

    base = basename(F.col("file.relative_path"))
    first = named.groupBy("batch", base.alias("base")).agg(F.min_by("file", F.col("file.relative_path")).alias("first"))
    named_key = F.concat(F.col("batch"), F.lit("\x01"), F.nullif("base", F.lit("")))
    by_name = first.select(named_key.alias("name_key"), "first").filter("name_key IS NOT NULL")
    wanted = F.concat(F.col("batch"), F.lit("\x01"), basename(F.col("file_key")))
    asked = F.when(F.col("file").isNull(), wanted).otherwise(F.concat(F.lit("\x01"), F.col("hit_id")))
    joined = tried.withColumn("name_key", asked).join(by_name, "name_key", "left")
    matched = joined.withColumn("file", F.coalesce("file", "first")).drop("first", "name_key")
    return matched.filter("file IS NOT NULL").select("*", "file.*").drop("file")


def collect_results(submissions: DataFrame, results: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits of every submitted job that has a scan id, whatever state it ended in.

    ``submissions``: job_id, batch. ``results``: job_id, state, scan_id. ``hits``: scan_id, ….
    """
    jobs = submissions.join(results.filter("scan_id IS NOT NULL"), "job_id")
    return hits.join(jobs, "scan_id")


def rejected_jobs(submissions: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs without a scan id or without a result, and jobs that did not finish, with the reason."""
    joined = submissions.join(results, "job_id", "left")
    reason = (
        F.when(F.col("state").isNull(), "no result")
        .when(F.col("scan_id").isNull(), "no scan id")
        .when(F.col("state") != "FINISHED", "not finished, hits collected anyway")
    )
    return joined.withColumn("reason", reason).filter("reason IS NOT NULL")


def flatten_hits(
    matched: DataFrame,
    catalog: str,
    schema: str,
    volume: str,
    datasource_id: str,
    as_of: str,
    record: str = "source",
) -> DataFrame:
    """Matched hits as rows of the metadata table.

    ``matched`` has absolute_path, relative_path, size_bytes, modification_time, job_id and the
    open record as a VARIANT.
    """
    source = F.coalesce(F.col(record), F.parse_json(F.lit("{}")))
    # The keys are read in a projection of their own, as typing looks at each value several times.
    raw = {f"raw_{name}": v.field(source, key) for name, key, _ in wire.HIT_FIELDS}
    objects = {f"raw_object_{i}": v.field(source, key, "string") for i, key in enumerate(wire.OBJECT_KEYS)}
    read = matched.withColumns({**raw, **objects})
    typed = {name: KINDS[kind](F.col(f"raw_{name}")) for name, _, kind in wire.HIT_FIELDS}
    columns = {
        "file_path": F.col("absolute_path"),
        "relative_path": F.col("relative_path"),
        "catalog_name": F.lit(catalog),
        "schema_name": F.lit(schema),
        "volume_name": F.lit(volume),
        "file_size": F.col("size_bytes"),
        "modification_time": F.col("modification_time"),
        "datasource_id": F.lit(datasource_id),
        "job_id": F.col("job_id"),
        "object_id": v.str_or_null(v.first_truthy(*[F.col(name) for name in objects])),
        "annotation_stats_json": v.prefixed_json(source, wire.ANNOTATION_PREFIXES),
        "raw_metadata": F.to_json(source),
        "collected_at": F.lit(as_of).cast("timestamp"),
    } | typed
    return read.select(*[columns[f.name].alias(f.name) for f in metadata_schema()])
