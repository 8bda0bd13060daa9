"""A set of hashes as a bit map of fixed size, to spare rows a join they can't pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a map; its size never grows with the set.
BITS = 1 << 20


def bit_map(hashes: DataFrame, bits: int = BITS) -> DataFrame:
    """One row with an array of ``bits / 64`` numbers that has a bit set for each value of the column ``hash``."""
    slot = F.pmod("hash", F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int"))
    held = hashes.select((slot / 64).cast("bigint").alias("place"), one.alias("bit"))
    held = held.groupBy("place").agg(F.bit_or("bit").alias("word"))
    places = hashes.sparkSession.range(bits // 64).withColumnRenamed("id", "place")
    filled = places.join(held, "place", "left").select(F.struct("place", F.coalesce("word", F.lit(0)).alias("word")).alias("s"))
    return filled.agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["word"]).alias("words"))


def in_map(words: Column, value: Column, bits: int = BITS) -> Column:
    """Whether the bit of ``value`` is set; a few others may be set too, so an exact join has to follow."""
    slot = F.pmod(value, F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int"))
    return F.get(words, (slot / 64).cast("int")).bitwiseAND(one) != 0
