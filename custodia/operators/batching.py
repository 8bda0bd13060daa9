"""Packing files, in list order, into batches of bounded size.

A new batch begins when the next file would exceed the byte limit or the file limit, so where a batch begins depends on every file
before it. But the file that would begin the next batch, if a batch began here, depends on running sums alone: it is found for every
file at once, by merging the sums with the sums at which batches would be full.

Following these steps from the first file gives the batches. They are followed in a tree. The list is cut into blocks of equal
numbers of files. For every file at which a batch may enter a block, the block's map tells where a batch leaves it, and after how
many batches. The maps of two neighbours are joined into the map of both, and so on up to the whole list; of each map only the
entries that another block leads to are kept, which are fewer the larger the blocks are. Then, down the same tree, the one true
entry of a block gives that of each half. With its entry, a block numbers its files.

Nothing of this passes through the driver, no window or group holds more than a block, and a batch may be longer than a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpointed

#: Files of a block.
BLOCK_ROWS = 1 << 16


def running_sums(rows: DataFrame, by: list[str], values: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """``rows`` with a column for each of ``values`` (bigints): its sum over all rows before each one, in the order ``by``.

    Rows are dealt to sorted ranges; each range sums up its rows as they stream by, and starts at the totals of the ranges before,
    of which there is one row each.
    """
    names = list(values)
    dealt = rows.withColumns({f"_own_{name}": value.cast("bigint") for name, value in values.items()})
    dealt = dealt.repartitionByRange(*([ranges] if ranges else []), *by).sortWithinPartitions(*by)
    dealt = checkpointed(dealt.withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(*[F.sum(f"_own_{name}").alias(f"_own_{name}") for name in names])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_own_{name}").over(before), F.lit(0)).alias(f"_start_{name}") for name in names])

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = dict.fromkeys(names, 0)
        for batch in batches:
            if len(batch):
                own = {name: batch[f"_own_{name}"].to_numpy(dtype="int64") for name in names}
                ends = {name: total[name] + np.cumsum(own[name]) for name in names}
                yield batch.assign(**{name: ends[name] - own[name] for name in names})
                total = {name: int(ends[name][-1]) for name in names}

    schema = StructType([*dealt.schema.fields])
    for name in names:
        schema = schema.add(name, "long")
    summed = dealt.mapInPandas(add_up, schema).join(starts, "_part")
    summed = summed.withColumns({name: F.col(name) + F.col(f"_start_{name}") for name in names})
    return summed.drop("_part", *[f"_{kind}_{name}" for kind in ("own", "start") for name in names])


def next_starts(files: DataFrame, max_bytes: int, max_files: int) -> DataFrame:
    """``(at, next)`` of ``files (at, before, bytes)``: the file that begins the next batch if one begins at ``at``.

    That is the number of files that end within ``max_bytes`` from here, which is a running count over the ends of all files and
    the limits of all possible batches, in one order; at equal places ends come first.
    """
    ends = files.select((F.col("before") + F.col("bytes")).alias("place"), F.lit(0).alias("kind"), "at")
    limits = files.select((F.col("before") + max_bytes).alias("place"), F.lit(1).alias("kind"), "at")
    met = running_sums(ends.unionByName(limits), ["place", "kind", "at"], {"fitting": 1 - F.col("kind")})
    return met.filter("kind = 1").select("at", F.least("fitting", F.col("at") + max_files).alias("next"))


def _leaving(rows: pd.DataFrame) -> pd.DataFrame:
    """Where batches that begin at each file of a block leave it, and after how many batches: steps are doubled until all have left."""
    rows = rows.sort_values("at")
    first, n = int(rows["at"].iloc[0]), len(rows)
    leaves, steps = rows["next"].to_numpy(dtype="int64").copy(), np.ones(n, dtype="int64")
    while True:
        inside = np.flatnonzero(leaves < first + n)
        if not len(inside):
            return pd.DataFrame({"at": rows["at"].to_numpy(), "leaves": leaves, "steps": steps})
        at = leaves[inside] - first
        steps[inside], leaves[inside] = steps[inside] + steps[at], leaves[at]


def entries(steps: DataFrame, n: int, block: int) -> DataFrame:
    """``(at, batch)``: the first batch that begins in each block, for blocks in which one does; from ``steps (at, next)``."""
    own = lambda column, size: F.floor(F.col(column) / F.lit(size)).cast("bigint")
    true = steps.sparkSession.range(1).select(F.col("id").alias("at"), F.lit(0).cast("bigint").alias("batch"))
    if n <= block:
        return true
    maps = steps.groupBy(own("at", block).alias("block")).applyInPandas(_leaving, "at bigint, leaves bigint, steps bigint")
    levels, size = [checkpointed(maps)], block
    while size < n:
        size *= 2
        maps = levels[-1]
        led_to = maps.select(F.col("leaves").alias("at")).union(true.select("at")).distinct()
        maps = maps.join(led_to, "at", "left_semi")
        later = maps.select(F.col("at").alias("leaves"), F.col("leaves").alias("then"), F.col("steps").alias("more"))
        together = own("at", size) == own("leaves", size)  # the batch goes on in the other half of the larger block
        near = maps.filter(together).join(later, "leaves").select("at", F.col("then").alias("leaves"), (F.col("steps") + F.col("more")).alias("steps"))
        levels.append(checkpointed(maps.filter(~together).unionByName(near)))
    while len(levels) > 1:  # the smaller maps tell where the second half is entered
        levels.pop()
        found = true.join(levels[-1], "at").filter((own("at", size) == own("leaves", size)) & (F.col("leaves") < n))
        true = checkpointed(true.unionByName(found.select(F.col("leaves").alias("at"), (F.col("batch") + F.col("steps")).alias("batch"))))
        size //= 2
    return true


def plan_batches(
    files: DataFrame,
    max_bytes: int,
    max_files: int,
    path: str = "relative_path",
    size: str = "size_bytes",
    ranges: int | None = None,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """``files`` with a ``batch`` number, counted from 0 in path order; files of one path follow by size."""
    if max_bytes <= 0 or max_files <= 0:
        raise ValueError("max_bytes and max_files must be positive")
    refused = files.filter(F.col(size).isNull() | (F.col(size) < 0) | (F.col(size) > max_bytes)).select(path, size).first()
    if refused is not None:
        raise ValueError(f"{refused[0]}: size {refused[1]} is not between 0 and max_bytes")
    kept = [F.col(f"`{c}`") for c in files.columns]
    listed = files.select(F.struct(*kept).alias("file"), F.col(path).alias("path"), F.col(size).cast("bigint").alias("bytes"))
    sums = {"at": F.lit(1), "before": F.col("bytes")}
    placed = running_sums(listed.withColumn("tie", F.xxhash64("file")), ["path", "bytes", "tie"], sums, ranges)
    placed = checkpointed(placed.select("file", "bytes", "at", "before"))
    n = placed.count()
    own = F.floor(F.col("at") / F.lit(block)).cast("bigint").alias("block")
    steps = checkpointed(next_starts(placed.select("at", "before", "bytes"), max_bytes, max_files))
    first = entries(steps, n, block).select(own, F.col("at").alias("entry"), F.col("batch").alias("begun"))
    blocks = files.sparkSession.range(-(-n // block)).select(F.col("id").alias("block")).join(first, "block", "left")
    # the batch that is open where a block begins is the one before the next to begin, or else the very last
    ahead = W.orderBy("block").rowsBetween(0, W.unboundedFollowing)  # one row for each block
    known = blocks.select("block", "entry", "begun", (F.first("begun", ignorenulls=True).over(ahead) - 1).alias("open"))
    rows = steps.select("at", "next", own).join(known, "block")

    def number(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        start, following = int(group["at"].iloc[0]), group["next"].to_numpy(dtype="int64")
        begins, place = np.zeros(len(group), dtype="int64"), group["entry"].iloc[0]
        if pd.isna(place):
            return pd.DataFrame({"at": group["at"], "batch": -1 if pd.isna(group["open"].iloc[0]) else int(group["open"].iloc[0])})
        place = int(place) - start
        while place < len(group):
            begins[place] = 1
            place = int(following[place]) - start
        return pd.DataFrame({"at": group["at"], "batch": int(group["begun"].iloc[0]) - 1 + np.cumsum(begins)})

    batches = checkpointed(rows.groupBy("block").applyInPandas(number, "at bigint, batch bigint"))
    last = batches.agg(F.max("batch")).scalar()  # blocks behind the last begin
    return placed.join(batches, "at").select("file.*", F.when(F.col("batch") < 0, last).otherwise(F.col("batch")).alias("batch"))
