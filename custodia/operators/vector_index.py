"""A stored vector index: inverted lists with compressed residuals, grants by list, and calibrated probing.

An index is a folder of tables:

* ``lists``: every chunk, one partition per list, with its vector, the ``code`` of its residual and, if secured, its grants;
* ``centroids``: a row for each list with its center, radius and number of chunks;
* ``grants``: for each grant how many chunks hold it, and a bit map of their lists;
* ``calibration``: the recall measured for numbers of lists probed and of chunks re-ranked.

A code has four bits a component: the chunk's distance from the center of its list, in steps of the chunk's own scale, an eighth
of the double vector. A search with a target recall looks up how many lists to probe and how many chunks to re-rank, scores the
codes of these lists, and reads the vectors of the best ones only. An exact search needs no calibration.

A secured search reads a list only if it holds a chunk with a grant of an asker who probes it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpointed
from . import retrieval
from .access import ACCESS_COLUMNS

#: Grants that many askers have; their bit maps are kept at hand instead of joined.
CLASS_GRANTS = ("public", "review")
#: Chunks asked for to calibrate, and results each.
CALIBRATION_QUERIES = 256
CALIBRATION_K = 10
LEVELS = 15


# --- codes ----------------------------------------------------------------------------------


def coded(unit: np.ndarray, centers: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Codes and scales of directions, given the center of each one's list."""
    rest = unit - centers
    scale = np.maximum(np.abs(rest).max(axis=1, initial=0.0), 1e-12).astype(np.float32)
    level = np.rint((rest / scale[:, None] + 1) * LEVELS / 2).clip(0, LEVELS).astype(np.uint8)
    level = np.pad(level, ((0, 0), (0, level.shape[1] % 2)))
    return [row.tobytes() for row in level[:, ::2] << 4 | level[:, 1::2]], scale


def decoded(codes: pd.Series, scale: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The directions that codes stand for, up to their rounding."""
    packed = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(len(codes), -1)
    level = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(codes), -1)[:, : centers.shape[1]]
    return centers + (level * (2.0 / LEVELS) - 1) * scale[:, None]


def _with_codes(dealt: DataFrame, centers: np.ndarray) -> DataFrame:
    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes, scale = coded(retrieval._unit(batch["embedding"], centers.shape[1]), centers[batch["list_id"].to_numpy()])
            yield batch.assign(code=codes, scale=scale)

    return dealt.mapInPandas(code, StructType([*dealt.schema.fields]).add("code", "binary").add("scale", "float"))


# --- building -------------------------------------------------------------------------------


def build(chunks: DataFrame, path: str, lists: int | None = None, seed: int = 7, rounds: int = 10) -> None:
    """Index all ``chunks`` (chunk_id, embedding and, for secured searches, ``ACCESS_COLUMNS``) and calibrate the index.

    Centers come from a bounded sample. Chunks without a direction are left out, as they match nothing.
    """
    spark = chunks.sparkSession
    secured = set(ACCESS_COLUMNS) <= set(chunks.columns)
    centers = retrieval._centers(chunks, lists, rounds, seed)
    rows = retrieval._with_grants(chunks, secured)
    if len(centers):
        rows = _with_codes(retrieval._dealt(rows, centers), centers)
    else:
        rows = rows.limit(0).withColumns({"list_id": F.lit(0), "gap": F.lit(0.0), "code": F.lit(b""), "scale": F.lit(0.0).cast("float")})
    rows = retrieval.numbered(rows, secured)
    rows.hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/lists")
    held = stored.groupBy("list_id").agg(F.max("gap").alias("radius"), F.count("*").alias("members"))
    known = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "list_id int, centroid array<double>")
    held.join(known, "list_id").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    if secured:
        _list_maps(stored, len(centers)).write.mode("overwrite").parquet(f"{path}/grants")
    calibrate(spark, path, seed)


def _list_maps(stored: DataFrame, lists: int) -> DataFrame:
    """``(grant, map, members)``: bit ``i`` of the map is set if list ``i`` holds a chunk with the grant; members are all such chunks."""
    pairs = stored.select("list_id", F.explode(F.array_distinct("grants")).alias("grant")).groupBy("list_id", "grant").agg(F.count("*").alias("n"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("list_id") % 64)
    words = pairs.select("grant", "n", (F.col("list_id") / 64).cast("int").alias("at"), bit.alias("bit")).groupBy("grant", "at").agg(F.bit_or("bit").alias("word"), F.sum("n").alias("n"))
    filled = words.groupBy("grant").agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("words"), F.sum("n").alias("members"))  # one for each 64 lists
    places = F.sequence(F.lit(0), F.lit(max(lists - 1, 0) // 64))
    return filled.select("grant", F.transform(places, lambda at: F.coalesce(F.get(F.map_values(F.map_filter("words", lambda k, _: k == at)), F.lit(0)), F.lit(0).cast("bigint"))).alias("map"), "members")


def opened(spark: SparkSession, path: str) -> retrieval.Lists | None:
    """The stored lists, and what the driver knows of them: a bounded number of rows. None if the index is empty."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()
    if not rows:
        return None
    column = lambda name, kind: np.array([r[name] for r in rows], dtype=kind)
    return retrieval.Lists(spark.read.parquet(f"{path}/lists"), column("list_id", "int64"), column("centroid", "float64"), column("radius", "float64"), column("members", "int64"), stored=True)


def _granted(lists: retrieval.Lists, spark: SparkSession, path: str) -> retrieval.Lists:
    return replace(lists, grants=spark.read.parquet(f"{path}/grants"))


# --- calibration ----------------------------------------------------------------------------


def calibrate(spark: SparkSession, path: str, seed: int = 7) -> None:
    """Ask for some chunks of the index themselves (a bounded sample, each without itself) and note what it takes to find their
    true neighbours: the place of a neighbour's list among the probed ones, and how many chunks have better codes.

    The table has ``nprobe, depth, recall``: neighbours found by probing ``nprobe`` lists and re-ranking ``depth`` chunks.
    """
    lists = opened(spark, path)
    schema = "nprobe int, depth bigint, recall double"
    if lists is None:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/calibration")
        return
    vectors = lists.chunks.select("chunk_id", "embedding")
    share = min(1.0, 1.2 * CALIBRATION_QUERIES / lists.members.sum())
    some = vectors.filter(F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    asked = checkpointed(some.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(CALIBRATION_QUERIES).withColumnRenamed("chunk_id", "query_id"))
    plain = retrieval.Lists(lists.chunks.select("chunk_id", "embedding", "list_id", "gap"), lists.ids, lists.centers, lists.radius, lists.members)
    true = retrieval._search(plain, asked, CALIBRATION_K + 1, -2.0, False, len(lists.ids), True)
    true = true.filter("query_id <> chunk_id").filter(F.col("rank") <= CALIBRATION_K + 1).select("query_id", "chunk_id")
    questions = asked.toPandas()
    codes = lists.chunks.select("chunk_id", "list_id", "code", "scale")
    sought = _code_scores(codes.join(F.broadcast(true), "chunk_id"), lists, questions).toPandas()  # queries times neighbours
    better = _better_codes(codes, lists, questions, sought).groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    depth = np.zeros(len(sought), dtype="int64")
    depth[better["at"]] = better["n"]
    order = np.argsort(lists.gaps(retrieval._unit(questions["embedding"], lists.centers.shape[1])), axis=1, kind="stable")
    place = {q: dict(zip(lists.ids[o].tolist(), range(1, len(o) + 1))) for q, o in zip(questions["query_id"], order)}
    probe = np.array([place[q][i] for q, i in zip(sought["query_id"], sought["list_id"])], dtype="int64")
    rows = [(int(p), int(d), float(np.mean((probe <= p) & (depth <= d)))) for p in sorted({*probe.tolist()}) for d in _depths(depth)]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/calibration")


def _depths(depth: np.ndarray) -> list[int]:
    """Depths to tell recalls for, each a quarter more than the one before."""
    out, most = [CALIBRATION_K], int(depth.max(initial=0))
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return out


def _approximate(rows: pd.DataFrame, lists: retrieval.Lists) -> np.ndarray:
    own = decoded(rows["code"], rows["scale"].to_numpy(dtype="float64"), lists.centers[np.searchsorted(lists.ids, rows["list_id"].to_numpy())])
    return own / np.linalg.norm(own, axis=1, keepdims=True)


def _code_scores(rows: DataFrame, lists: retrieval.Lists, questions: pd.DataFrame) -> DataFrame:
    """``(query_id, list_id, score)`` of pairs ``(query_id, chunk_id, list_id, code, scale)``."""
    unit = retrieval._unit(questions["embedding"], lists.centers.shape[1])
    place = pd.Series(np.arange(len(questions)), index=questions["query_id"])
    own = retrieval.Lists(None, lists.ids, lists.centers, lists.radius, lists.members)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                scores = (unit[place[batch["query_id"]].to_numpy()] * _approximate(batch, own)).sum(axis=1)
                yield batch[["query_id", "list_id"]].assign(score=scores)

    fields = {f.name: f for f in rows.schema.fields}
    return rows.mapInPandas(score, StructType([fields["query_id"], fields["list_id"]]).add("score", "double"))


def _better_codes(codes: DataFrame, lists: retrieval.Lists, questions: pd.DataFrame, sought: pd.DataFrame) -> DataFrame:
    """``(at, n)``: how many chunks of some rows have a code score as high as row ``at`` of ``sought``."""
    unit = retrieval._unit(questions["embedding"], lists.centers.shape[1])
    place = pd.Series(np.arange(len(questions)), index=questions["query_id"])
    query, score = place[sought["query_id"]].to_numpy(), sought["score"].to_numpy() - 1e-9
    own = retrieval.Lists(None, lists.ids, lists.centers, lists.radius, lists.members)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(query), dtype="int64")
        for batch in batches:
            for begin in range(0, len(batch), step := max(1, retrieval.SLICE_CELLS // max(1, len(unit)))):
                scores = np.sort(unit @ _approximate(batch.iloc[begin : begin + step], own).T, axis=1)
                for at in range(len(query)):
                    total[at] += scores.shape[1] - np.searchsorted(scores[query[at]], score[at])
        yield pd.DataFrame({"at": np.arange(len(query)), "n": total})

    return codes.mapInPandas(count, "at int, n bigint")


def plan_for(spark: SparkSession, path: str, recall: float) -> tuple[int, int]:
    """``(nprobe, depth)``: as few lists, and then as few chunks re-ranked, as the calibration says give the recall."""
    table = spark.read.parquet(f"{path}/calibration")
    best = table.filter(F.col("recall") >= recall).orderBy("nprobe", "depth").first()
    best = best or table.orderBy(F.col("recall").desc(), "nprobe", "depth").first()
    return (best["nprobe"], best["depth"]) if best else (1, CALIBRATION_K)


# --- searching ------------------------------------------------------------------------------


def with_list_maps(asked: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """``asked (query_id, embedding, grants)`` with ``maps``: the bit maps of lists that each of the asker's grants opens.

    An asker's own grants are joined by name; the maps of the few grants that many have are put in without a join.
    """
    maps = spark.read.parquet(f"{path}/grants")
    classes = {r["grant"]: r["map"] for r in maps.filter(F.col("grant").isin(*CLASS_GRANTS)).collect()}
    shared = [F.when(F.array_contains("grants", name), F.array(*[F.lit(word) for word in words]).cast("array<bigint>")) for name, words in classes.items()]
    own = asked.select("query_id", F.explode("grants").alias("grant")).filter(~F.col("grant").isin(*CLASS_GRANTS)).distinct()
    own = own.join(maps.select("grant", "map"), "grant").groupBy("query_id").agg(F.collect_list("map").alias("own"))  # one for each grant of the asker
    none = F.array().cast("array<array<bigint>>")
    all_ = F.concat(F.coalesce("own", none), F.array_compact(F.array(*shared)) if shared else none)
    return asked.join(own, "query_id", "left").withColumn("maps", all_).drop("own")


def search(path: str, queries: DataFrame, k: int = 5, threshold: float = 0.2, recall: float | None = None, secured: bool = False, nprobe: int = 4) -> DataFrame:
    """The ``k`` chunks most similar to each query: ``query_id, chunk_id, similarity, rank``.

    Without ``recall`` the result is exact, that of ``vector_search``. With it, lists and chunks are chosen by the calibration and
    similarities are exact, but some of the best chunks may be missing. ``secured`` applies the access policy.
    """
    spark = queries.sparkSession
    lists = opened(spark, path)
    if lists is None:
        return retrieval._nothing(spark.read.schema("chunk_id bigint").parquet(f"{path}/lists"), queries)
    if secured and "grants" not in lists.chunks.columns:
        raise ValueError("the index was built without access data")
    maps = (lambda asked: with_list_maps(asked, spark, path)) if secured else None
    lists = _granted(lists, spark, path) if secured else lists
    vectors = lists.chunks.select("chunk_id", "embedding", "list_id", "gap", *(["grants", "chunk_row"] if secured else []))
    if recall is None:
        return retrieval._search(lists.of(vectors), queries, k, threshold, secured, nprobe, True, maps)
    found = candidates(lists, queries, recall, path, k, secured, maps)
    scored = _exact(found, vectors, queries)
    return retrieval.top_k(scored.filter(F.col("similarity") > threshold), k)


def candidates(lists: retrieval.Lists, queries: DataFrame, recall: float, path: str, k: int, secured: bool, maps) -> DataFrame:
    """``(query_id, chunk_id)``: what the codes of the calibrated number of lists show as best for each query."""
    nprobe, depth = plan_for(queries.sparkSession, path, recall)
    own = retrieval.Lists(None, lists.ids, lists.centers, lists.radius, lists.members)
    codes = lists.of(lists.chunks.select("chunk_id", "list_id", "gap", "code", "scale", *(["grants", "chunk_row"] if secured else [])))
    decode = lambda rows: rows.assign(embedding=list(_approximate(rows, own)))
    return retrieval._search(codes, queries, max(k, depth), -2.0, secured, nprobe, False, maps, decode).select("query_id", "chunk_id")


def _exact(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, similarity)`` of pairs, from the stored vectors of the chunks that occur."""
    met = pairs.join(vectors.select("chunk_id", "embedding"), "chunk_id").join(queries.select("query_id", F.col("embedding").alias("asked")), "query_id")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit = retrieval._unit(batch["embedding"])
                scores = np.round((unit * retrieval._unit(batch["asked"], unit.shape[1])).sum(axis=1), retrieval.DIGITS)
                yield batch[["query_id", "chunk_id"]].assign(similarity=scores)

    fields = {f.name: f for f in met.schema.fields}
    return met.mapInPandas(score, StructType([fields["query_id"], fields["chunk_id"]]).add("similarity", "double"))
