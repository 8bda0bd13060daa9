"""Work on what changed only: keyed rows told apart by fingerprints, and vectors kept by content."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from . import retrieval

#: Groups of keys that fingerprints are summed up in; each is a folder of what is remembered, so millions of keys want more of them.
GROUPS = 256
GROUP = "key_group"


def _known(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


@dataclass(frozen=True)
class Changes:
    """``rows``: ``key, change`` (created, updated, deleted) of what differs; ``groups``: the groups it lies in."""

    rows: DataFrame
    groups: list[int]
    prints: DataFrame
    path: str

    def remember(self) -> int:
        """Keep the new fingerprints, of the groups that differ; says how many. Call it once the changes are applied: a crash before
        shows the same changes again, one in between only compares a few groups again."""
        if self.groups:
            spark = self.prints.sparkSession
            mine = self.prints.filter(F.col(GROUP).isin(self.groups))
            # a group left without a key keeps one row without a key, as partitions are replaced, not removed
            every = spark.createDataFrame([(g,) for g in self.groups], f"{GROUP} int")
            rows = every.join(mine, GROUP, "left").select("key", "print", GROUP)
            writer = rows.repartition(GROUP).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy(GROUP).parquet(f"{self.path}/rows")
            _sums(self.prints).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/groups")
        return len(self.groups)


def _sums(prints: DataFrame) -> DataFrame:
    return prints.groupBy(GROUP).agg(F.bit_xor(F.xxhash64("key", "print")).alias("total"), F.count("*").alias("n"))


def changes(rows: DataFrame, path: str, key: str = "qualified_name", groups: int = GROUPS) -> Changes:
    """What differs between ``rows``, one for each key, and the rows remembered in ``path``, told from coarse to fine.

    Each row has a fingerprint of all its columns; keys fall into ``groups``, whose fingerprints are combined. Groups that are
    equal aren't looked at further, and only the others are read from what is remembered. Null keys are ignored.
    """
    spark = rows.sparkSession
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns) if c != key]))
    name = F.col(f"`{key}`").cast("string")
    prints = rows.select(name.alias("key"), F.xxhash64(content).alias("print"), F.pmod(F.xxhash64(name), F.lit(groups)).cast("int").alias(GROUP))
    prints = checkpointed(prints.filter("key IS NOT NULL"))
    old = _known(spark, f"{path}/groups", f"{GROUP} int, total bigint, n bigint").withColumnsRenamed({"total": "old_total", "n": "old_n"})
    differ = _sums(prints).join(old, GROUP, "full").filter("NOT (total <=> old_total AND n <=> old_n)")
    differing = sorted(r[0] for r in differ.select(GROUP).collect())  # at most one row for each group
    held = _known(spark, f"{path}/rows", f"key string, print bigint, {GROUP} int").filter(F.col(GROUP).isin(differing) & F.col("key").isNotNull())
    met = prints.filter(F.col(GROUP).isin(differing)).join(held.select("key", F.col("print").alias("old")), "key", "full")
    change = F.when(F.col("old").isNull(), "created").when(F.col("print").isNull(), "deleted").when(F.col("print") != F.col("old"), "updated")
    found = met.select(F.col("key").alias(key), change.alias("change")).filter("change IS NOT NULL")
    return Changes(checkpointed(found), differing, prints, path)


@dataclass(frozen=True)
class Embedded:
    """Chunks with their vectors, and how many texts were embedded and how many vectors dropped."""

    chunks: DataFrame
    embedded: int
    dropped: int


def embed_load(chunks: DataFrame, store: str, load: str, before: str | None = None, embedder: Callable | None = None, text: str = "chunk") -> Embedded:
    """Vectors for a load of chunks, embedding only texts that the load before didn't have.

    Vectors are kept by the SHA-256 of their text in ``store``, one folder a load: those of texts that still occur, taken over
    from the load named ``before``, and new ones. What no chunk refers to any more is left behind. Equal texts are embedded once.
    """
    spark = chunks.sparkSession
    hashed = chunks.withColumn("content_sha", F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))
    wanted = hashed.select("content_sha", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body")).dropDuplicates(["content_sha"])
    old = _known(spark, f"{store}/{before}" if before else f"{store}/none", "content_sha string, embedding array<float>")
    kept = old.join(wanted.select("content_sha"), "content_sha", "left_semi")
    fresh = wanted.join(old.select("content_sha"), "content_sha", "left_anti")
    fresh = checkpointed(retrieval.embed(fresh, embedder, text="body").select("content_sha", "embedding"))
    kept.unionByName(fresh).write.mode("overwrite").parquet(f"{store}/{load}")
    stored = spark.read.parquet(f"{store}/{load}")
    embedded = fresh.count()
    dropped = old.count() - (stored.count() - embedded)
    return Embedded(hashed.join(stored, "content_sha").drop("content_sha"), embedded, dropped)
