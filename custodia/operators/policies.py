"""Records policies over file metadata: duplicates, retention, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wire
from ..functions.naming import leaf_name
from ..functions.values import strip
from .labels import has_any_label
from .skew import HOT_ROWS, join_by_weight


def has_hash(column: Column) -> Column:
    return column.isNotNull() & (strip(column) != "")


def duplicate_groups(files: DataFrame, hash_col: str = "content_sha256", keep_by: str = "file_id") -> DataFrame:
    """Content held by more than one file: how often, how many bytes, and the file to keep.

    Files without a hash are not compared. Only sums and minima cross the shuffle, so a group
    with most of the files costs one partial row per task.
    """
    groups = files.filter(has_hash(F.col(hash_col))).groupBy(hash_col)
    counted = groups.agg(
        F.count("*").alias("n_files"),
        F.sum("size").cast("bigint").alias("total_bytes"),
        F.min(keep_by).alias("keep_id"),
    )
    return counted.filter("n_files > 1")


def duplicates_to_archive(
    files: DataFrame,
    hash_col: str = "content_sha256",
    keep_by: str = "file_id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every file of a duplicate group but the one that is kept.

    The keeper comes from an aggregate and is joined back, never from a window over the group, so
    no task has to hold a group.
    """
    keepers = duplicate_groups(files, hash_col, keep_by).select(hash_col, "keep_id", "n_files")
    pairs = join_by_weight(files, keepers, [hash_col], "n_files", keep_by, hot_rows)
    return pairs.filter(F.col(keep_by) != F.col("keep_id")).drop("n_files")


def retention_gaps(
    files: DataFrame, as_of: str, years: int = 7, category: str = "Records", modified: str = "last_modified"
) -> DataFrame:
    """Files of a records category not changed for ``years`` before ``as_of``."""
    limit = F.add_months(F.lit(as_of).cast("date"), -12 * years)
    return files.filter((F.col("category") == category) & (F.col(modified) < limit))


def rot_files(files: DataFrame, label: str = "ROT") -> DataFrame:
    """Files labelled redundant, obsolete or trivial."""
    return files.filter(has_any_label(F.col("labels"), [label]))


def remediation_plan(rows: DataFrame, archive_root: str, separator: str = "/") -> DataFrame:
    """Where each file would go: ``<archive>/<hash>/<name>``, and the text left in its place.

    Rows without a path are skipped; rows without a hash go to ``unhashed``. Nothing is moved.
    """
    folder = F.when(has_hash(F.col("content_sha256")), F.col("content_sha256")).otherwise("unhashed")
    target = F.concat_ws(separator, F.lit(archive_root.rstrip("/\\")), folder, leaf_name(F.col("path")))
    named = rows.filter(F.col("path").isNotNull() & (strip(F.col("path")) != ""))
    return named.select(
        F.col("path").alias("source_path"),
        target.alias("archive_path"),
        F.lit(wire.STUB_TEXT).alias("stub_text"),
    )
