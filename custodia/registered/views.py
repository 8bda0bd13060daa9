"""The test tables seen as file metadata, hits, principals, mail and so on.

Every view covers its whole table. ``sql.py`` has the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-01"
TENANT = "acme"
LINK_BASE = "console.example.com/"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files(spark: SparkSession, sf: str) -> DataFrame:
    """File metadata of the documents, with the labels of those that were classified."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    names = F.array_compact(
        F.array(
            F.when(F.col("quality") == 1, "GATED").otherwise("ROT"),
            F.when(F.col("toxic") == 1, "CONFIDENTIAL"),
        )
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("file_id"),
        "doc_id",
        F.format_string("doc_%d.txt", "doc_id").alias("file_name"),
        F.concat(F.lit("/vol/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("n_chars").alias("size"),
        F.sha2("text", 256).alias("content_sha256"),
        category().alias("category"),
        F.date_add(F.lit("2014-01-01").cast("date"), ((F.col("doc_id") * 37) % 4000).cast("int")).alias("last_modified"),
        F.when(F.col("quality").isNotNull(), names).alias("labels"),
        "source",
        "lang",
    )


def category():
    kinds = ["Records", "Performance Review", "Code of Conduct", "Leave and Time-Off Policy", "Other"]
    return F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % 5 + 1).cast("int"))


def submitted(spark: SparkSession, sf: str) -> DataFrame:
    """The files of each batch; a batch is a source, half of the files lie in a second folder."""
    docs = table(spark, sf, "documents")
    name = F.format_string("doc_%d.txt", F.floor(F.col("doc_id") / 2) * 2)
    relative = F.concat(F.when(F.col("doc_id") % 2 == 0, "a/").otherwise("b/"), F.col("lang"), F.lit("/"), name)
    return docs.select(
        F.floor(F.col("doc_id") / 100).cast("string").alias("batch"),
        F.concat(F.lit("/vol/"), relative).alias("absolute_path"),
        relative.alias("relative_path"),
        F.col("n_chars").alias("size_bytes"),
        (F.lit(1_700_000_000) + F.col("doc_id")).alias("modification_time"),
        F.concat(F.lit("job-"), F.floor(F.col("doc_id") / 100).cast("string")).alias("job_id"),
    )


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """A classifier hit per document: a third names the exact path, a third another folder with the
    same base name, a third a file nobody knows. The record is open JSON."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    name = F.format_string("doc_%d.txt", F.floor(F.col("doc_id") / 2) * 2)
    exact = F.concat(F.when(F.col("doc_id") % 2 == 0, "a/").otherwise("b/"), F.col("lang"), F.lit("/"), name)
    key = (
        F.when(F.col("doc_id") % 3 == 0, exact)
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("elsewhere/"), name))
        .otherwise(F.format_string("unknown/none_%d.txt", "doc_id"))
    )
    tags = F.when(F.col("quality").isNotNull(), F.array(F.lit("checked"), F.col("lang")))
    record = F.to_json(
        F.struct(
            key.alias("ds#file_path"),
            F.concat(F.lit("  "), name, F.lit(" ")).alias("ds#file_name"),
            F.col("doc_id").cast("string").alias("dxr#file_id"),
            F.floor(F.col("doc_id") / 100).cast("string").alias("dxr#datasource_scan_id"),
            F.when(F.col("toxic") == 1, "yes").when(F.col("toxic") == 0, "No").otherwise("?").alias("dxr#is_processed"),
            F.col("toxic").alias("dxr#ocr_used"),
            F.col("lang").alias("dxr#doc_lang"),
            F.col("source").alias("ai#category"),
            tags.alias("dxr#tags"),
            F.sha2("text", 256).alias("dxr#sha_256_hash"),
            F.lit("   ").alias("folder_id"),
            F.col("n_chars").alias("annotation_stats#size"),
        )
    )
    return docs.select(
        F.floor(F.col("doc_id") / 100).cast("string").alias("batch"),
        F.col("doc_id").cast("string").alias("hit_id"),
        F.floor(F.col("doc_id") / 100).cast("string").alias("scan_id"),
        F.col("n_chars").alias("score"),
        F.parse_json(record).alias("source"),
    )


def principals(spark: SparkSession, sf: str) -> DataFrame:
    groups = F.array(F.lower("c_mktsegment"))
    reader = F.array_append(groups, F.lit("can_see_all_reviews"))
    return table(spark, sf, "customer").select(
        F.format_string("user%d@example.com", "c_custkey").alias("email"),
        F.format_string("E%d", "c_custkey").alias("employee_id"),
        F.when(F.col("c_custkey") % 10 == 0, reader).otherwise(groups).alias("groups"),
        "c_custkey",
    )


def secured_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").alias("document_id"),
        F.format_string("doc_%d.txt", "doc_id").alias("title"),
        F.col("text").alias("content"),
        category().alias("category"),
        F.array(F.format_string("user%d@example.com", F.col("doc_id") % 150)).alias("entitled_emails"),
        F.format_string("E%d", F.col("doc_id") % 150).alias("extracted_employee_id"),
        F.date_add(F.lit("2014-01-01").cast("date"), ((F.col("doc_id") * 37) % 4000).cast("int")).alias("created_at"),
        "source",
    )


def vec_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as chunks of documents; the title is the document's source."""
    docs = secured_docs(spark, sf)
    n_docs = table(spark, sf, "documents").agg(F.count("*").alias("n")).scalar()
    chunks = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % n_docs).alias("document_id"), "embedding"
    )
    info = docs.select(
        "document_id", F.col("source").alias("title"), "category", "entitled_emails", "extracted_employee_id"
    )
    return chunks.join(info, "document_id").withColumn("chunk_index", F.col("chunk_id"))


def text_chunks(spark: SparkSession, sf: str, chunks: DataFrame) -> DataFrame:
    """Chunks of the texts (document_id, chunk_index, chunk) with a vector each. Titles and places in the text are shared by several of them."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = table(spark, sf, "embeddings").agg(F.count("*").alias("n")).scalar()
    info = secured_docs(spark, sf).drop("title", "content", "created_at")
    named = chunks.join(info, "document_id").withColumn("vec_id", (F.col("document_id") * 31 + F.col("chunk_index")) % n)
    return named.join(vectors, "vec_id").select(
        (F.col("document_id") * 100_000 + F.col("chunk_index")).alias("chunk_id"),
        F.concat_ws(" ", "source", F.col("document_id") % 20).alias("title"),
        "chunk_index",
        F.col("chunk").alias("content"),
        "embedding",
        "category",
        "entitled_emails",
        "extracted_employee_id",
    )


def topic_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The mean vector of each embedding label, ``topic, embedding``: the questions of the tests."""
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    means = cells.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "x")))
    return means.groupBy(F.col("label").alias("topic")).agg(F.transform(ordered, lambda c: c["x"]).alias("embedding"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every principal asks one question, made of three topics, with the number of topics wrapping."""
    topics = topic_vectors(spark, sf)
    n_topics = table(spark, sf, "embeddings").agg(F.count_distinct("label").alias("n")).scalar()
    asked = principals(spark, sf).withColumn("query_pos", F.explode(F.sequence(F.lit(0), F.lit(2))))
    asked = asked.withColumn("topic", ((F.col("c_custkey") + F.col("query_pos")) % n_topics).cast("int"))
    return asked.join(topics, "topic").select(
        F.col("c_custkey").alias("request_id"),
        (F.col("c_custkey") * 3 + F.col("query_pos")).alias("query_id"),
        "query_pos",
        F.format_string("topic %d", "topic").alias("query"),
        "embedding",
        "email",
        "employee_id",
        "groups",
    )


def tagged_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files with label and datasource structs, as the catalog sync reads them."""
    rows = files(spark, sf)
    connector = F.struct(
        F.col("lang").alias("type"),
        F.lit(None).cast("string").alias("name"),
        F.lit("").alias("id"),
        F.concat(F.lit("c-"), "source").alias("connectorId"),
    )
    datasource = F.struct(
        F.col("source").alias("id"),
        F.format_string("%s v%d", "source", F.col("doc_id") % 7).alias("name"),
        connector.alias("connector"),
    )
    labels = F.transform("labels", lambda n: F.struct(F.concat(F.lit("L-"), n).alias("id"), n.alias("name")))
    return rows.select(F.col("doc_id").alias("pos"), "file_id", datasource.alias("datasource"), labels.alias("labels"))


def classifications(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog entries: the labels seen on files and the region names; ROT has an id no file carries."""
    seen = files(spark, sf).select(F.explode("labels").alias("name")).distinct()
    names = seen.unionByName(table(spark, sf, "region").select(F.col("r_name").alias("name")))
    ident = F.concat(F.when(F.col("name") == "ROT", "old-").otherwise("L-"), F.col("name"))
    return names.select(
        F.conv(F.left(F.md5(F.col("name").cast("binary")), F.lit(8)), 16, 10).cast("bigint").alias("pos"),
        ident.alias("id"),
        "name",
        F.when(F.col("name").startswith("A"), "annotator").otherwise("label").alias("type"),
        F.when(F.col("name") == "GATED", "smart").alias("subtype"),
        F.when(F.col("name") == "CONFIDENTIAL", "Not for everyone").alias("description"),
        F.when(F.col("name") != "ROT", "2024-01-01").alias("createdAt"),
        F.when(F.col("name") == "ROT", "2024-02-01").alias("updatedAt"),
        F.when(F.col("name") != "GATED", F.concat(F.lit("/search?label="), F.col("name"))).alias("searchLink"),
        F.lit(None).cast("string").alias("tenant"),
    )


def mail_messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("message_id"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise("sender@example.com").alias("sender"),
        F.lit(True).alias("has_content"),
        (F.col("o_orderpriority") != "5-LOW").alias("parse_ok"),
    )


def mail_attachments(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as attachments; their position is a struct, as line numbers repeat."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("message_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("att_pos"),
        F.format_string("line_%d_%d.txt", "l_linenumber", "l_partkey").alias("filename"),
        (F.col("l_linestatus") == "F").alias("classification_error"),
    )


def mail_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("message_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("att_pos"),
        F.lit(0).alias("hit_pos"),
        F.lit(0).alias("label_pos"),
        F.col("l_returnflag").alias("name"),
    )


def blocked_labels(spark: SparkSession) -> DataFrame:
    """The gate's configuration: R is listed twice, the second message counts."""
    rows = [(0, "R", "old message"), (1, "R", "Returned goods found")]
    return spark.createDataFrame(rows, "pos int, name string, message string")
