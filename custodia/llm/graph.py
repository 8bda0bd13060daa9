"""Connected components of a link table: links contracted within tasks, then repeated joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.session import checkpointed

#: Links that a task contracts at once (16 bytes each).
LINKS = 1 << 20


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(node, root)`` of the links ``u[i] - v[i]``: every node but the smallest of its component, with that smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        open_link = ra != rb
        if not open_link.any():
            break
        a, b, ra, rb = a[open_link], b[open_link], ra[open_link], rb[open_link]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def contracted(links: DataFrame, size: int) -> DataFrame:
    """``(u, v)`` with the components of ``links (u, v)``: of each ``size`` links of a partition, one from each node to the smallest it reaches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            node, root = smallest_reachable(*(np.concatenate([part[k] for part in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])

        for batch in batches:
            for start in range(0, batch.num_rows, size):
                piece = batch.slice(start, size)
                if held and n + piece.num_rows > size:
                    yield out()
                    held, n = [], 0
                held.append((piece.column(0).to_numpy(), piece.column(1).to_numpy()))
                n += piece.num_rows
        if n:
            yield out()

    return links.mapInArrow(work, "u bigint, v bigint")


def components(links: DataFrame, a: str = "a", b: str = "b", size: int | None = None) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (whole numbers); the root is the smallest node of the component.

    Tasks first contract what they hold, at most ``size`` (``LINKS``) links at once; if that is all, one such task is the whole work. Else
    two star steps follow, one plan a round: every node's larger neighbours, then its smaller ones, are linked to the
    smallest neighbour. Rounds grow with the logarithm of the size, not with the diameter; they end when every node has
    one root and no root has one. Minima come from partial aggregates, and a node's links are streamed, never collected.
    Merge joins keep the driver free of broadcast tables, of which many rounds would leave many.
    Null and self links are left out; no links give no rows.
    """
    size = size or LINKS
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # unions would double them every round
    edges = links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while True:
        tasks = max(1, -(-edges.count() // size))
        edges = checkpointed(contracted(edges.coalesce(tasks), size))
        if tasks == 1:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("below")))
        seen = ends.groupBy("node").agg(F.sum("below").alias("roots"), F.count("*").alias("all"))
        if seen.filter("roots > 1 OR roots = 1 AND all > 1").isEmpty():
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
