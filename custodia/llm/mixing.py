"""Mixing sources: temperature weights, and a sequence of documents that realises them in budgeted blocks.

A source's weight is its token share to the power of an exponent, normalised. The exponent is found by bisection: the
largest one whose weights reach the target entropy, unless a source would then be repeated more often than the limit
allows; then the smallest one that keeps the limit. Both are searched over the table of sources alone.

Each source gets its weight's part of the token budget. Its documents are laid out epoch after epoch, each epoch in a new
pseudo-random order; a copy is taken if it begins before the source's part is full. The layout is cut into as many
blocks as the budget has block budgets, each block holding the same fraction of every source, and a block's copies are
permuted. Running sums go over ranges of the order first and over range totals then, so that a source with a third
of all rows is spread like any other.

Defined results. A null source is a source of its own. Null and empty texts have no tokens; they are laid out with their source if
it has tokens at all, while sources without tokens have weight 0 and aren't drawn. Repeated rows and ids are documents of
their own; ties of the order are broken by id and then by the words' digest. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custodia.llm.quality_rules import spaced_words
from custodia.session import checkpointed

#: Target entropy as a part of the largest possible one, and how often a document may be used.
ENTROPY = 0.95
REPEATS = 4.0
BLOCK_TOKENS = 1 << 20
#: Rows that one range of the order holds on average.
RANGE_ROWS = 2_000
STEPS = 40
SEED = 7
#: Sources in a partition; their table is read about 50 times, and each time a partition is a task.
SOURCES = 1 << 16


@dataclass(frozen=True)
class Exponent:
    """The exponent found, and what its weights give."""

    value: float
    entropy: float
    repeats: float


def token_table(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``(id, source, tokens, digest)`` of each row; tokens are words between white space."""
    words = spaced_words(F.col(f"`{text}`"))
    return docs.select(
        F.col(f"`{doc_id}`").alias("id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.size(words).cast("bigint").alias("tokens"),
        F.xxhash64(f"`{text}`").alias("digest"),
    )


def source_table(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("source_docs"))


def _at(sources: DataFrame, total: float, budget: float, exponent: float) -> Exponent:
    """Entropy and largest number of repeats at an exponent, in one aggregate over the sources."""
    share = F.ln(F.col("source_tokens") / total)
    power = F.exp(share * exponent)
    row = sources.agg(F.sum(power), F.sum(power * share * exponent), F.max(power / F.col("source_tokens"))).first()
    mass = float(row[0])
    return Exponent(exponent, math.log(mass) - float(row[1]) / mass, budget / mass * float(row[2]))


def bisected(sources: DataFrame, budget: float, entropy: float = ENTROPY, repeats: float | None = REPEATS, steps: int = STEPS) -> Exponent:
    """Exponent in [0, 1] for the sources with tokens; ``entropy`` is a part of the logarithm of their number.

    Entropy falls and the largest number of repeats falls as the exponent rises from equal to natural shares.
    """
    total, n = sources.agg(F.sum("source_tokens"), F.count("*")).first()
    if not n:
        return Exponent(1.0, 0.0, 0.0)
    target = entropy * math.log(n)
    at = lambda e: _at(sources, float(total), budget, e)

    def largest(good) -> Exponent:
        """Largest exponent that is good, where smaller ones are."""
        low, high = at(0.0), at(1.0)
        if good(high) or not good(low):
            return high if good(high) else low
        for _ in range(steps):
            middle = at((low.value + high.value) / 2)
            low, high = (middle, high) if good(middle) else (low, middle)
        return low

    found = largest(lambda e: e.entropy >= target)
    if repeats is not None and found.repeats > repeats:
        low, high = found, at(1.0)
        if high.repeats > repeats:
            return high
        for _ in range(steps):
            middle = at((low.value + high.value) / 2)
            low, high = (low, middle) if middle.repeats <= repeats else (middle, high)
        return high
    return found


def weights(sources: DataFrame, exponent: float) -> DataFrame:
    """``sources`` with ``share`` and ``weight``; both are 0 without tokens."""
    total = sources.agg(F.sum("source_tokens")).first()[0] or 0
    share = F.when(F.col("source_tokens") > 0, F.col("source_tokens") / F.lit(float(max(total, 1)))).otherwise(0.0)
    power = F.when(F.col("share") > 0, F.pow("share", F.lit(exponent))).otherwise(0.0)
    powers = sources.withColumn("share", share).withColumn("power", power)
    mass = powers.agg(F.sum("power")).first()[0] or 1.0
    return powers.withColumn("weight", F.col("power") / F.lit(float(mass))).drop("power")


def order_of(epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), epoch, "id", "digest")


def realised(tokens: DataFrame, weighted: DataFrame, budget: int, block_tokens: int = BLOCK_TOKENS, range_rows: int = RANGE_ROWS, seed: int = SEED) -> DataFrame:
    """Copies drawn: ``id, source, tokens, weight, epoch, block, position``.

    ``epoch`` counts from 0; ``position`` is the place in the block.
    """
    n_blocks = max(1, -(-int(budget) // block_tokens))
    quota = F.col("weight") * F.lit(float(budget))
    drawn = weighted.filter("weight > 0").withColumn("quota", quota)
    ranges = F.greatest(F.ceil(F.col("source_docs") / range_rows), F.lit(1))
    last = F.ceil(F.col("quota") / F.col("source_tokens"))  # epochs begun
    plan = drawn.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "weight", "quota", "source_tokens", ranges.alias("ranges"), last.alias("epochs"))
    plan = checkpointed(plan)
    keyed = tokens.withColumns({"s": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()})
    rows = keyed.join(plan, ["s", "none"]).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("epochs") - 1)))
    rows = rows.withColumn("order", order_of(F.col("epoch"), seed))
    # ranges of equal width over the 2^64 values of the order
    rows = rows.withColumn("range", F.least(F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * F.col("ranges")), F.col("ranges") - 1))
    rows = checkpointed(rows)
    key = ["s", "none", "epoch"]
    sums = rows.groupBy(*key, "range").agg(F.sum("tokens").alias("range_tokens"))
    before = Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpointed(sums.select(*key, "range", F.coalesce(F.sum("range_tokens").over(before), F.lit(0)).alias("range_start")))
    inside = Window.partitionBy(*key, "range").orderBy("order", "id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(starts, [*key, "range"])
    begin = F.col("epoch") * F.col("source_tokens") + F.col("range_start") + F.col("inner")
    taken = placed.withColumn("begin", begin).filter(F.col("begin") < F.col("quota"))
    block = F.least(F.floor(F.col("begin") / F.col("quota") * n_blocks), F.lit(n_blocks - 1))
    taken = taken.withColumn("block", block.cast("bigint")).withColumn("shuffled", F.xxhash64(F.lit(seed + 1), "epoch", "id", "digest", "source"))
    in_block = Window.partitionBy("block").orderBy("shuffled", "source", "epoch", "id", "digest")
    return taken.select("id", "source", "tokens", "weight", "epoch", "block", (F.row_number().over(in_block) - 1).cast("bigint").alias("position"))


def mixed(
    docs: DataFrame,
    budget: int | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    entropy: float = ENTROPY,
    repeats: float | None = REPEATS,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The mix of ``docs``; the budget is all their tokens unless it is given."""
    tokens = checkpointed(token_table(docs, doc_id, source, text))
    sources = checkpointed(source_table(tokens))
    total, n = sources.agg(F.sum("source_tokens"), F.count("*")).first()
    sources = sources.coalesce(max(1, -(-n // SOURCES)))
    goal = (total or 0) if budget is None else budget
    exponent = bisected(checkpointed(sources.filter("source_tokens > 0")), float(goal), entropy, repeats)
    out = realised(tokens, weights(sources, exponent.value), goal, block_tokens)
    return out.withColumnRenamed("id", doc_id)
