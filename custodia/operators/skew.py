"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000


def heaviest(per_key: DataFrame, keys: list[str], weight: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys with more than ``hot_rows`` rows, at most ``MAX_HOT_KEYS`` of them.

    Both bounds are sure: never more than ``MAX_HOT_KEYS`` rows are broadcast, and a key that is
    left out has at most a ``MAX_HOT_KEYS``-th part of all rows.
    """
    order = [F.col(weight).desc(), *[F.col(k).asc() for k in keys]]
    return per_key.filter(F.col(weight) > hot_rows).orderBy(*order).limit(MAX_HOT_KEYS)


def join_by_weight(
    rows: DataFrame, per_key: DataFrame, keys: list[str], weight: str, row_id: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner join of ``rows`` with one row per key that says how many rows the key has.

    The rows of a heavy key are dealt out over as many shares as its weight asks for, and its one
    row of ``per_key`` is copied to each share; all other keys have a single share.

    AQE alone would not do: it splits a skewed partition only when the shuffle feeds the join
    directly, and here the other side is an aggregate.
    """
    n_shares = F.ceil(F.col(weight) / hot_rows).cast("int")
    shares = heaviest(per_key, keys, weight, hot_rows).select(*keys, n_shares.alias("shares"))
    one = F.coalesce("shares", F.lit(1))
    dealt = rows.join(F.broadcast(shares), keys, "left").withColumn("share", F.pmod(F.xxhash64(row_id), one).cast("int"))
    copied = per_key.join(F.broadcast(shares), keys, "left")
    copied = copied.withColumn("share", F.explode(F.sequence(F.lit(0), one - 1)))
    return dealt.drop("shares").join(copied.drop("shares"), [*keys, "share"]).drop("share")
