"""Newline-delimited JSON: reading, projecting, landing and registering exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from ..functions import wire
from ..functions.values import field, variant_int
from ..operators.skew import heaviest

#: Rows of a file of a mirrored label.
ROWS_PER_FILE = 1_000_000


def read_ndjson(
    spark: SparkSession, path: str, schema: StructType | str | None = None, cap: int | None = None
) -> DataFrame:
    """Records of a line-delimited JSON export; blank and non-JSON lines are skipped.

    Without a schema each row is one open ``record`` VARIANT; with one, typed columns, and a field of another
    type is NULL while its record stays. ``cap`` stops after that many valid records, whichever are read first.
    """
    if cap is not None and cap < 1:
        raise ValueError("cap must be at least 1")
    if schema is None:
        rows = _parsed_lines(spark, path).filter("record IS NOT NULL").select("record")
    else:
        wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        valid = _parsed_lines(spark, path).filter("record IS NOT NULL")
        rows = valid.select(F.from_json("line", wanted, {"mode": "PERMISSIVE"}).alias("typed")).select("typed.*")
    return rows if cap is None else rows.limit(cap)


def read_bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines ``read_ndjson`` skips because they are not JSON."""
    return _parsed_lines(spark, path).filter("record IS NULL AND line <> ''").select("line")


def _parsed_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines.withColumn("record", F.try_parse_json("line"))


def project_file_records(records: DataFrame, record: str = "record") -> DataFrame:
    """Typed scalars, nested fields as ``<field>_json`` and the whole record as ``raw_json``.

    Values are taken as they are; only the two counts become numbers.
    """
    source = F.col(record)
    whole = [name for name, _ in wire.FILE_SCALARS if name in ("size", "scan_depth")]
    read = records.select(source, *[field(source, key).alias(f"raw_{name}") for name, key in wire.FILE_SCALARS if name in whole])
    scalars = [
        (variant_int(F.col(f"raw_{name}")) if name in whole else field(source, key, "string")).alias(name)
        for name, key in wire.FILE_SCALARS
    ]
    nested = [field(source, key, "string").alias(f"{key}_json") for key in wire.FILE_NESTED]
    return read.select(*scalars, F.to_json(source).alias("raw_json"), *nested)


def land_raw(df: DataFrame, path: str) -> None:
    """Land an export as JSON lines, replacing what an earlier run left there."""
    df.write.mode("overwrite").json(path)


def register_inferred(spark: SparkSession, path: str, name: str, prefix: str = "exported_") -> str:
    """Infer the schema of landed JSON and register it as ``<prefix><name>`` for SQL."""
    view = prefix + name
    spark.read.json(path).createOrReplaceTempView(view)
    return view


def adhoc(spark: SparkSession, view: str, limit: int = 100, order_by: str | None = None) -> DataFrame:
    """A look at a registered table: its first ``limit`` rows."""
    order = f" ORDER BY {order_by}" if order_by else ""
    return spark.sql(f"SELECT * FROM {view}{order} LIMIT {int(limit)}")


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a result set as CSV with a header, or as JSON lines."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"unknown export format {fmt}")
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def mirror_by_label(df: DataFrame, path: str, labels: str = "labels", rows_per_file: int = ROWS_PER_FILE) -> None:
    """One folder per label with the files that carry it; a file with two labels is in both.

    Labels are weighed before the write: one with more than ``rows_per_file`` rows is dealt over as many shares as it needs, any
    other is one share and one file. No file has more rows than that, and a label at most twice the files it needs.
    """
    per_label = df.withColumn("label", F.explode(F.array_distinct(labels))).drop(labels)
    weights = per_label.groupBy("label").agg(F.count("*").alias("weight"))
    heavy = heaviest(weights, ["label"], "weight", rows_per_file).select("label", F.ceil(F.col("weight") / rows_per_file).cast("int").alias("shares"))
    row = F.xxhash64(*[F.col(f"`{c}`") for c in per_label.columns if not isinstance(per_label.schema[c].dataType, MapType)], F.monotonically_increasing_id())
    dealt = per_label.join(F.broadcast(heavy), "label", "left").withColumn("_share", F.pmod(row, F.coalesce("shares", F.lit(1))))
    dealt = dealt.repartition("label", "_share").drop("shares", "_share")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("label").parquet(path)
