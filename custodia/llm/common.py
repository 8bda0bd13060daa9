"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed value of the contracts: what separates words of the lower-cased text.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; a null text has none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(low, NOT_WORD), "")


def fold(doc_id: Column, parts: int) -> Column:
    """Fold of a document: crc32 of its id as text; a null id falls into fold 0."""
    return F.pmod(F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)), F.lit(parts))


def union_length(spans: Column) -> Column:
    """Positions covered by an array of ``struct<start, end>`` (ends included), start at 1 or above."""
    start = F.struct(F.lit(0).cast("bigint").alias("covered"), F.lit(0).cast("bigint").alias("reach"))

    def step(state: Column, span: Column) -> Column:
        fresh = span["end"] - F.greatest(state["reach"], span["start"] - 1)
        return F.struct(
            (state["covered"] + F.greatest(fresh, F.lit(0))).cast("bigint").alias("covered"),
            F.greatest(state["reach"], span["end"]).cast("bigint").alias("reach"),
        )

    return F.aggregate(F.sort_array(spans), start, step, lambda state: state["covered"])


def digest_of(text: str) -> Column:
    return F.xxhash64(f"`{text}`")
