"""Embedding near-dedup: p-stable hashing of unit vectors into many tables, and an exact cosine check of what meets.

A hash is the cell of a random projection, ``floor((a . v + b) / width)`` with normal ``a``; two vectors fall into one cell with a
chance that depends on their distance alone. A table joins ``rows`` hashes into one bucket. ``rows`` follows from the number of
vectors, so that a vector meets few that are at right angles to it, and the number of tables from the chance with which a pair of
just the wanted similarity may be missed (``MISS``). Only vectors of one label and length meet.

Equal vectors are one from the start. A bucket is dealt into parts of bounded size, whose pairs are tested in blocks; a pair
counts in the first table alone in which it meets, and a block hands on counts and links that span its components, never
its pairs.

Defined results. Vectors that are null, zero, or hold null or non-finite components, and vectors without a label, link with nothing:
``n_links`` 0, alone in their component. So do vectors of other lengths than their label's others. Repeated rows and ids are vectors
of their own. A component's id is its smallest id; null ids can't name it unless it has no other. Ties don't arise. Extra columns are
ignored. Empty tables give no rows. Vectors of any length are read whole. Labels are told apart by 64-bit hashes, equal vectors
known by 128-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.llm.graph import components
from custodia.llm.spans import mixed, spread
from custodia.session import checkpointed

SIMILARITY = 0.93
#: Chance to miss a pair of exactly that similarity; the closer a pair, the smaller its chance.
MISS = 1e-3
#: Width of a cell, and how many vectors at right angles a vector is expected to meet in a table.
WIDTH = 2.0
CHANCE_MEETINGS = 0.05
#: Vectors in a part of a bucket, and pairs tested at once.
PART = 2048
PAIRS = 1 << 17
SEED = 11


def meeting_chance(distance: float, width: float) -> float:
    """Chance that two vectors at this distance fall into one cell."""
    t = width / distance
    beyond = math.erfc(t / math.sqrt(2))  # of a normal value, on both sides
    return 1 - beyond - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def table_plan(vectors: int, similarity: float = SIMILARITY, miss: float = MISS, width: float = WIDTH) -> tuple[int, int]:
    """``(tables, rows)`` for so many vectors of one label."""
    near, far = meeting_chance(math.sqrt(2 - 2 * similarity), width), meeting_chance(math.sqrt(2), width)
    rows = max(1, math.ceil(math.log(max(vectors, 1) / CHANCE_MEETINGS) / -math.log(far)))
    return max(1, math.ceil(math.log(miss) / math.log1p(-(near**rows)))), rows


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, also where squares would over- or underflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def table_keys(unit: np.ndarray, tables: int, rows: int, width: float = WIDTH) -> np.ndarray:
    """A number for the bucket of each vector in each table. Projections are made again for each table, from its seed."""
    keys = np.empty((len(unit), tables), dtype=np.uint64)
    for table in range(tables):
        dice = np.random.default_rng((SEED, table))
        shift = dice.uniform(0, width, rows)
        cells = np.floor((unit @ dice.standard_normal((unit.shape[1], rows)) + shift) / width).astype(np.int64).view(np.uint64)
        key = np.full(len(unit), table, dtype=np.uint64)
        for k in range(rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, k])
        keys[:, table] = key
    return keys.view(np.int64)


def sound(vector: Column) -> Column:
    """The vector can be compared: it has a direction and only finite components."""
    wrong = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, wrong) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Components of all lists of a column, and where each list begins and ends."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(places, unit vectors)`` of the lists of each length."""
    values, ends = _rows(column)
    sizes = np.diff(ends)
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        yield which, unit_rows(values[spread(ends[:-1][which], sizes[which])].astype(np.float64).reshape(len(which), size))


def with_keys(reps: DataFrame, tables: int, rows: int) -> DataFrame:
    """``reps (rep, own, copies, vector)`` with the bucket numbers of all tables in ``keys``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros((batch.num_rows, tables), dtype=np.int64)
            for which, unit in _units(batch.column(3)):
                keys[which] = table_keys(unit, tables, rows)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(tables))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], names=[*batch.schema.names, "keys"])

    return reps.mapInArrow(work, "rep bigint, own bigint, copies bigint, vector array<double>, keys array<bigint>")


def blocks(keyed: DataFrame) -> DataFrame:
    """Rows ``(bucket, i, j, part, place, rep, own, copies, vector, keys)``: for each bucket of two vectors or more, and each two
    of its parts, the vectors of both. A bucket with one part has the block (0, 0)."""
    held = keyed.select("rep", F.posexplode("keys").alias("place", "key"), "own")
    held = held.select(F.xxhash64("own", "place", "key").alias("bucket"), "place", "rep")
    shared = held.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    met = held.join(shared, "bucket").withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    met = met.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "place", "rep")
    return met.join(keyed, "rep").select("bucket", "i", "j", "part", "place", "rep", "own", "copies", "vector", "keys")


def _links_of(block: pa.RecordBatch, similarity: float) -> pa.RecordBatch:
    """Counts and spanning links of whole blocks that lie one after the other."""
    bucket, i, j, part, place, rep, own, copies = (block.column(k).to_numpy(zero_copy_only=False) for k in range(8))
    units = list(_units(block.column(8)))
    slot, kind = np.zeros(len(rep), dtype=np.int64), np.zeros(len(rep), dtype=np.int64)
    for k, (which, _) in enumerate(units):
        slot[which], kind[which] = np.arange(len(which)), k
    keys = block.column(9).flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1)
    begins = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    ends = np.append(begins[1:], len(rep))
    later = np.repeat(ends, ends - begins) - np.arange(len(rep)) - 1  # vectors behind each one in its block
    links, root = np.zeros(len(rep), dtype=np.int64), np.arange(len(rep))
    start, before = 0, np.concatenate([[0], np.cumsum(later)])
    while start < len(rep):
        stop = max(int(np.searchsorted(before, before[start] + PAIRS, side="right")) - 1, start + 1)
        a = np.repeat(np.arange(start, stop), later[start:stop])
        b = spread(np.arange(start, stop) + 1, later[start:stop])
        start = stop
        # parts of one block meet each other, unless the block is a part by itself
        meet = (own[a] == own[b]) & (kind[a] == kind[b]) & ((i[a] == j[a]) | (part[a] != part[b]))
        a, b = a[meet], b[meet]
        near = np.zeros(len(a), dtype=bool)
        for k, (_, unit) in enumerate(units):
            pairs = np.flatnonzero(kind[a] == k)
            near[pairs] = np.einsum("ij,ij->i", unit[slot[a[pairs]]], unit[slot[b[pairs]]]) >= similarity
        a, b = a[near], b[near]
        fresh = (keys[a] == keys[b]).argmax(axis=1) == place[a]  # the pair meets in no table before
        a, b = a[fresh], b[fresh]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        while len(a):  # one root for what is linked, the smallest place
            low = np.minimum(root[a], root[b])
            if (root[a] == low).all() and (root[b] == low).all():
                break
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            root = root[root]
    while (root != root[root]).any():
        root = root[root]
    told = np.flatnonzero(links > 0)
    return pa.RecordBatch.from_arrays([pa.array(rep[told]), pa.array(links[told]), pa.array(rep[root[told]])], names=["rep", "links", "other"])


def links(keyed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(rep, links, other)``: parts of the number of vectors that link with ``rep``, and links that join its component."""
    keys = ["bucket", "i", "j"]
    dealt = blocks(keyed).repartition(*keys).sortWithinPartitions(*keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            last = rest.slice(rest.num_rows - 1).to_pylist()[0]
            same = np.ones(rest.num_rows, dtype=bool)
            for k, name in enumerate(keys):
                same &= rest.column(k).to_numpy() == last[name]
            whole = rest.num_rows - int(same.sum())  # the last block may go on in the next batch
            if whole:
                yield _links_of(rest.slice(0, whole), similarity)
                rest = pa.concat_batches([rest.slice(whole)])
        if rest is not None:
            yield _links_of(rest, similarity)

    return dealt.mapInArrow(work, "rep bigint, links bigint, other bigint")


def near_vectors(docs: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", similarity: float = SIMILARITY, miss: float = MISS) -> DataFrame:
    """A row for each vector: its id, ``n_links`` (other vectors at ``similarity`` or more), ``component_id`` (smallest id that
    links lead to) and ``kept`` (it is that id)."""
    values = F.col(f"`{vector}`").cast("array<double>")
    own = F.when(sound(values) & F.col(f"`{label}`").isNotNull(), F.xxhash64(F.col(f"`{label}`").cast("string"), F.size(values)))
    read = docs.select(F.col(f"`{vec_id}`").alias("id"), own.alias("own"), values.alias("vector"))
    read = read.withColumns({"d1": F.xxhash64("own", "vector"), "d2": F.xxhash64(F.lit(17), "own", "vector")})
    able = read.filter("own IS NOT NULL")
    folded = able.groupBy("own", "d1", "d2").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("id").alias("id"))
    reps = checkpointed(folded.withColumn("rep", F.monotonically_increasing_id()))
    most = reps.groupBy("own").count().agg(F.max("count")).first()[0] or 0
    keyed = checkpointed(with_keys(reps.select("rep", "own", "copies", "vector"), *table_plan(most, similarity, miss)))
    found = checkpointed(links(keyed, similarity))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.filter("rep <> other"), "rep", "other").withColumnRenamed("node", "rep")
    own_part = reps.select("rep", "d1", "d2", "copies", "id").join(counts, "rep", "left").join(roots, "rep", "left")
    own_part = checkpointed(own_part.withColumns({"links": F.coalesce("links", F.lit(0)) + F.col("copies") - 1, "root": F.coalesce("root", "rep")}))
    heads = own_part.groupBy("root").agg(F.min("id").alias("component"))
    placed = checkpointed(own_part.join(heads, "root").select("d1", "d2", "links", "component"))
    met = read.select("id", "own", "d1", "d2").filter("own IS NOT NULL").join(placed, ["d1", "d2"]).select("id", "links", "component")
    alone = read.filter("own IS NULL").select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("component"))
    return met.unionByName(alone).select(
        F.col("id").alias(vec_id), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )
