"""The ``opN_`` queries and the pipeline, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.llm import (
    decontaminate,
    filter_audit,
    html_text,
    language,
    line_dedup,
    mixing,
    near_duplicates,
    quality_classifier,
    quality_rules,
    ranked_search,
    sql,
    token_counts,
    toxicity,
    vector_links,
)
from custodia.llm.common import table
from custodia.session import checkpointed


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("digest")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = checkpointed(token_counts.histogram(token_counts.lengths(docs)))  # several sums read it, texts are encoded once
    return token_counts.with_suffix_sums(counts)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, table(spark, sf_dir, "labels")).drop("text")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    judged = quality_rules.judged(docs, quality_rules.ratios(docs, trusted, "doc_id", "text"))
    return judged.select("doc_id", *[c for c in quality_rules.RESULTS if c != "mean_ratio"], "mean_ratio")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier.scored(docs, table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = line_dedup.line_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counts.withColumn("removed", F.array_join("removed", ","))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = checkpointed(ranked_search.index(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return ranked_search.search(blocks, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return filter_audit.audit(filter_audit.failure_sets(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_duplicates,
        op2_mixing,
        op3_token_counts,
        op4_toxicity,
        op5_language,
        op6_decontamination,
        op7_quality_rules,
        op8_quality,
        op9_line_dedup,
        op10_html_text,
        op11_vector_links,
        op12_ranked_search,
        op13_filter_audit,
    )
}
ORACLE = {
    "op6_decontamination": sql.OP6,
    "op9_line_dedup": sql.OP9,
    "op11_vector_links": sql.OP11,
    "op12_ranked_search": sql.OP12,
    "op13_filter_audit": sql.OP13,
}
