"""Exact length histogram: documents by encoded length, and what follows from it for every context limit.

Each text is encoded once, by a public byte-pair vocabulary whose file is a parameter; only its length is kept. The
histogram has one row for each length that occurs. With suffix sums over it, totals, quantiles and the tokens left after
cutting at a limit are exact, and need no second look at the texts.

Defined results. Null and empty texts have length 0. Repeated rows count each time. Ids and extra columns are ignored.
An empty table gives an empty histogram, totals of 0 and null quantiles.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's tokenizer splits a text before merging bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths that one block of the two-step suffix sums spans.
BLOCK = 1 << 12


def vocabulary(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def lengths(docs: DataFrame, text: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``n_tokens`` of each row. The driver reads the vocabulary, so executors need no file of their own; its size is
    that of the vocabulary, whatever the data."""
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        for batch in batches:
            found = [len(encoder.encode_ordinary(body)) if body else 0 for body in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["n_tokens"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(work, "n_tokens bigint")


def histogram(measured: DataFrame, length: str = "n_tokens") -> DataFrame:
    """``(n_tokens, n_docs)``, one row for each length."""
    return measured.groupBy(F.col(length).alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def with_suffix_sums(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length also ``tokens`` of these documents, ``docs_from`` and ``tokens_from`` (of documents at least as long),
    ``docs_upto``, and ``truncated_tokens``: all tokens if every text were cut at this length.

    Sums run inside blocks of lengths first and over the few block totals then, so no task sees the whole histogram.
    """
    rows = counts.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    rows = rows.withColumn("block", F.floor(F.col("n_tokens") / block))
    later = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({"docs_in": F.sum("n_docs").over(later), "tokens_in": F.sum("tokens").over(later)})
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("docs_block"), F.sum("tokens").alias("tokens_block"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)  # longest length / block rows
    blocks = totals.select(
        "block",
        F.coalesce(F.sum("docs_block").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("tokens_block").over(after), F.lit(0)).alias("tokens_after"),
    )
    whole = rows.agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("all_tokens"))
    out = inside.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        "tokens",
        (F.col("docs_in") + F.col("docs_after")).alias("docs_from"),
        (F.col("tokens_in") + F.col("tokens_after")).alias("tokens_from"),
    )
    sums = out.withColumns({"docs": whole.select("docs").scalar(), "all_tokens": whole.select("all_tokens").scalar()})
    return sums.select(
        "n_tokens",
        "n_docs",
        "tokens",
        "docs_from",
        "tokens_from",
        (F.col("docs") - F.col("docs_from") + F.col("n_docs")).alias("docs_upto"),
        (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_tokens"),
    )


def totals(counts: DataFrame) -> DataFrame:
    """One row: ``docs, tokens, longest``."""
    return counts.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"),
        F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("tokens"),
        F.max("n_tokens").alias("longest"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, n_tokens)``: the smallest length that at least this share of documents doesn't exceed."""
    docs = sums.agg(F.sum("n_docs")).first()[0] or 0
    wanted = [F.min(F.when(F.col("docs_upto") >= F.lit(docs * s), F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]
    one = sums.agg(*wanted)
    pairs = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)])
    return one.select(F.inline(pairs))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``(limit, tokens_kept, docs_cut)`` for any limits: the first longer length that occurs has the sums needed."""
    docs_longer = [F.sum(F.when(F.col("n_tokens") > n, F.col("n_docs")).otherwise(0)).alias(f"d{i}") for i, n in enumerate(limits)]
    kept = [F.sum(F.least(F.col("n_tokens"), F.lit(n)) * F.col("n_docs")).alias(f"t{i}") for i, n in enumerate(limits)]
    one = sums.agg(*docs_longer, *kept)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    parts = [F.struct(F.lit(n).cast("bigint").alias("limit"), zero(f"t{i}").alias("tokens_kept"), zero(f"d{i}").alias("docs_cut")) for i, n in enumerate(limits)]
    return one.select(F.inline(F.array(*parts)))
