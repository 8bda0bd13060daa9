"""Stages of the corpus pipeline: each applies one operator's decisions to whole documents.

Defined results. Other columns pass through all stages but the last, whatever their names; ``n_chars`` follows the text. Documents with
null ids, null or empty texts are kept as documents of their own, unless an operator's decision says otherwise; of
repeated rows as many stay as the operator keeps. Empty tables give empty tables. Very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.llm import decontaminate, line_dedup, mixing, near_duplicates, toxicity
from custodia.llm.common import digest_of, table
from custodia.llm.decontaminate import bit_map, in_map
from custodia.session import checkpointed

MAP_BITS = 1 << 22


def decided(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decisions (doc_id, digest, kept)`` keeps, one decision for each row of ``docs``.

    Rows with equal ids and texts are told apart by number only: as many stay as are kept. Decisions that keep all
    rows of an id and text are the rule; only rows that may be concerned by others are shuffled.
    """
    own = F.xxhash64("doc_id", "digest")
    per_text = decisions.groupBy("doc_id", "digest").agg(F.count_if("kept").alias("kept"), F.count("*").alias("all"))
    partly = checkpointed(per_text.filter("kept < all").withColumn("hash", own))
    known = bit_map(partly.select("hash"), MAP_BITS)
    key = F.xxhash64("doc_id", digest_of("text"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    untouched = docs.filter(~in_map(known.scalar(), key, MAP_BITS)).select(*columns)
    # the whole row lies in one column, whatever its columns are called
    marked = docs.filter(in_map(known.scalar(), key, MAP_BITS)).select(F.struct(*columns).alias("row"), F.col("doc_id").alias("own"), digest_of("text").alias("text_digest"))
    met = marked.join(partly.select("doc_id", "digest", "kept"), F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("text_digest") == F.col("digest")), "left")
    met = met.filter("kept IS NULL OR kept > 0")
    single, several = met.filter("kept IS NULL"), met.filter("kept > 0").dropDuplicates(["doc_id", "digest"])
    several = several.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("kept"))))
    return untouched.unionByName(single.select("row.*")).unionByName(several.select("row.*"))


def with_digest(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", digest_of("text").alias("digest"))


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` follows the text, if there is such a column."""
    n_chars: Column = F.length("text").cast("bigint")
    return docs.withColumn("n_chars", n_chars).select(*columns) if "n_chars" in columns else docs


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"))
    return toxicity.scored(whole, table(spark, sf_dir, "labels")).filter("predicted = 0").select("whole_row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal or come near an earlier line go, and documents left without a line."""
    return counted(line_dedup.deduplicated(docs), docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return decided(docs, near_duplicates.near_duplicates(docs).select("doc_id", "digest", "kept"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.contamination(with_digest(docs), table(spark, sf_dir, "benchmark"))
    return decided(docs, found.select("doc_id", "digest", (~F.col("contaminated")).alias("kept")))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence of documents that realises the sources' weights."""
    return mixing.mixed(docs)
