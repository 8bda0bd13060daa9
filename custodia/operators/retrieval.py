"""Chunking, secured vector search, rank fusion and context building."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import wire
from ..functions.text import Tokenizer, is_blank, tokens
from ..session import checkpointed
from .access import ACCESS_COLUMNS

#: Chunks for which a list is made; chunks and queries that meet at once; cells of similarities held at once.
LIST_ROWS = 8192
BLOCK_ROWS = 16_384
QUERY_ROWS = 4096
SLICE_CELLS = 1_000_000
#: Probes that leave Python at once; each carries its query's vector.
PROBE_ROWS = 8192
#: A grant that at most so many chunks hold is searched by a join of its chunks and questions, without lists.
FEW_ROWS = 1024
#: Tables of at most so many narrow rows are broadcast; so are texts of at most so many bytes.
SMALL_ROWS = 100_000
SMALL_BYTES = 64 << 20
#: The centers of all lists have at most so many bytes, and are found from so many chunks a list.
CENTER_BYTES = 32 << 20
SAMPLE_PER_LIST = 64
DIGITS = 9


# --- chunks ---------------------------------------------------------------------------------


def chunk_text(
    docs: DataFrame,
    text: str = "content",
    max_tokens: int = wire.CHUNK_TOKENS,
    overlap: int = wire.CHUNK_OVERLAP,
    tokenizer: Tokenizer = tokens,
) -> DataFrame:
    """Overlapping chunks, ``chunk_index`` and ``chunk``; a text that fits is one chunk, unchanged.

    The chunks of a text are cut as one array before they become rows, so no row carries the whole
    text or its tokens along and the work stays linear in the text.
    """
    if not 0 <= overlap < max_tokens:
        raise ValueError("overlap must be smaller than max_tokens")
    words = docs.withColumn("words", tokenizer(F.col(text)))
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(max_tokens - overlap))
    pieces = F.transform(starts, lambda s: F.array_join(F.slice("words", s + 1, F.lit(max_tokens)), ""))
    chunks = F.when(F.size("words") <= max_tokens, F.array(F.col(text))).otherwise(pieces)
    kept = [c for c in docs.columns if c != text]
    return words.select(*kept, F.posexplode(chunks).alias("chunk_index", "chunk"))


# --- vectors --------------------------------------------------------------------------------


def embed(df: DataFrame, embedder: Callable[[pd.Series], list] | None = None, text: str = "chunk", out: str = "embedding") -> DataFrame:
    """Adds a vector per text, computed in Arrow batches by a function of the caller; without one, by ``hashed_words``."""
    if embedder is None:
        return df.withColumn("_places", word_places(F.col(text))).withColumn(out, hashed_words(F.col("_places"))).drop("_places")
    vectors = F.pandas_udf(lambda texts: pd.Series(list(embedder(texts))), "array<float>")
    return df.withColumn(out, vectors(F.col(text)))


#: Places of a hashed vector; place ``i`` is written as the character with the code ``FIRST_PLACE + i``.
PLACES = 64
FIRST_PLACE = 48


def word_places(text: Column) -> Column:
    """A character for each word of a text, by the first two digits of the word's md5."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")
    place = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 2), 16, 10).cast("int") % PLACES
    return F.array_join(F.transform(words, lambda w: F.char(F.lit(FIRST_PLACE) + place(w))), "")


def hashed_words(places: Column) -> Column:
    """A small deterministic vector from ``word_places``: counts scaled to length one, zeros without words."""

    def count(texts: pd.Series) -> pd.Series:
        sizes = texts.str.len().to_numpy(dtype="int64")
        at = np.frombuffer("".join(texts).encode(), dtype=np.uint8).astype("int64") - FIRST_PLACE
        counts = np.bincount(np.repeat(np.arange(len(texts)), sizes) * PLACES + at, minlength=len(texts) * PLACES).reshape(-1, PLACES)
        length = np.sqrt((counts.astype("float64") ** 2).sum(axis=1, keepdims=True))
        return pd.Series(list((counts / np.where(length > 0, length, 1)).astype("float32")))

    return F.pandas_udf(count, "array<float>")(places)


def _unit(vectors: pd.Series, width: int | None = None) -> np.ndarray:
    """Rows of length one; a zero or missing vector becomes NaN and matches nothing."""
    if width is None:
        width = max((len(v) for v in vectors if v is not None), default=0)
    rows = [np.full(width, np.nan) if v is None else np.asarray(v, dtype="float64") for v in vectors]
    matrix = np.vstack(rows) if rows else np.zeros((0, width))
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _grants_of_chunk() -> Column:
    """Whom the access policy lets see a chunk, as names that askers may bear."""
    review = F.coalesce(F.col("category") == wire.REVIEW_CATEGORY, F.lit(False))
    public = F.coalesce(F.col("category").isin(wire.PUBLIC_CATEGORIES), F.lit(False))
    mails = F.transform(F.coalesce("entitled_emails", F.array().cast("array<string>")), lambda e: F.concat(F.lit("mail "), e))
    others = F.array(
        F.when(public, F.lit("public")),
        F.when(review, F.lit("review")),
        F.when(review, F.concat(F.lit("employee "), "extracted_employee_id")),
    )
    return F.array_compact(F.concat(mails, others))


def _grants_of_asker() -> Column:
    given = lambda name: F.when(F.col(name) != "", F.col(name))
    reads = F.coalesce(F.array_contains("groups", wire.REVIEW_GROUP), F.lit(False))
    names = F.array(
        F.lit("public"),
        F.when(reads, F.lit("review")),
        F.concat(F.lit("mail "), given("email")),
        F.concat(F.lit("employee "), given("employee_id")),
    )
    return F.array_compact(names)


def _joined_grants(askers: pd.Series, chunks: pd.Series) -> np.ndarray:
    """Asker by chunk: do they share a grant? Grants of both sides meet by name, not row by row."""
    seen = np.zeros((len(askers), len(chunks)), dtype=bool)
    sides = [np.repeat(np.arange(len(side)), [len(g) for g in side]) for side in (askers, chunks)]
    names = [np.concatenate([*side, np.array([], dtype=object)]) for side in (askers, chunks)]
    codes, _ = pd.factorize(np.concatenate(names))
    mine, theirs = codes[: len(names[0])], codes[len(names[0]) :]
    own, other = np.argsort(mine, kind="stable"), np.argsort(theirs, kind="stable")
    for code in np.intersect1d(mine, theirs):
        asking = own[slice(*np.searchsorted(mine, [code, code + 1], sorter=own))]
        shown = other[slice(*np.searchsorted(theirs, [code, code + 1], sorter=other))]
        seen[np.ix_(sides[0][asking], sides[1][shown])] = True
    return seen


def _best(rows: pd.DataFrame, asked: pd.DataFrame, k: int, threshold: float) -> pd.DataFrame:
    """The ``k`` best of some chunks for each of some queries, slice by slice in bounded memory."""
    named = [c for c in ("chunk_id", "chunk_row") if c in rows]
    best = pd.DataFrame({"q": [], "similarity": [], **{c: [] for c in named}}).astype({"q": "int64"})
    unit = _unit(asked["embedding"])
    floor = np.full(len(asked), -np.inf)
    step = max(k + 1, SLICE_CELLS // len(asked))
    for begin in range(0, len(rows), step):
        part = rows.iloc[begin : begin + step]
        scores = np.round(unit @ _unit(part["embedding"], unit.shape[1]).T, DIGITS)
        fits = (scores > threshold) & (scores >= floor[:, None])
        if "grants" in part:
            fits &= _joined_grants(asked["grants"], part["grants"])
        scores[~fits] = -np.inf
        if len(part) > k:  # the slice alone rules out what is below its own k-th best
            fits &= scores >= np.partition(scores, -k, axis=1)[:, -k, None]
        query, chunk = np.nonzero(fits)
        if not len(chunk):
            continue
        found = pd.DataFrame({"q": query, "similarity": scores[query, chunk], **{c: part[c].to_numpy()[chunk] for c in named}})
        pool = found if best.empty else pd.concat([best, found], ignore_index=True)
        pool = pool.sort_values(["q", "similarity", "chunk_id"], ascending=[True, False, True])
        best = pool.groupby("q", sort=False).head(k)
        full = best.groupby("q")["similarity"].agg(["size", "min"])
        full = full[full["size"] >= k]
        floor[full.index.to_numpy()] = full["min"].to_numpy()
    out = best.assign(query_id=asked["query_id"].to_numpy()[best["q"].to_numpy(dtype="int64")] if len(best) else [])
    return out[["query_id", *named, "similarity"]]


@dataclass
class Lists:
    """Chunks dealt to inverted lists, and what the driver knows of the lists: a bounded number of rows."""

    chunks: DataFrame
    ids: np.ndarray
    centers: np.ndarray
    radius: np.ndarray
    members: np.ndarray
    stored: bool = False  # one partition of a table per list, so that other lists need not be read
    grants: DataFrame | None = None  # for each grant how many chunks hold it (members), and the bit map of their lists

    def of(self, chunks: DataFrame) -> Lists:
        return replace(self, chunks=chunks)

    def gaps(self, unit: np.ndarray) -> np.ndarray:
        """Distance of each direction to each center."""
        squares = (unit**2).sum(1)[:, None] + (self.centers**2).sum(1)[None, :] - 2 * unit @ self.centers.T
        return np.sqrt(np.maximum(0.0, squares))


def _dealt(chunks: DataFrame, centers: np.ndarray) -> DataFrame:
    """Each chunk with its nearest center (``list_id``) and distance (``gap``); chunks without a direction go."""
    squares = (centers**2).sum(1)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit = _unit(batch["embedding"], centers.shape[1])
            sound = ~np.isnan(unit).any(axis=1)
            unit = unit[sound]
            place, gap = np.zeros(len(unit), dtype="int32"), np.zeros(len(unit))
            for begin in range(0, len(unit), step := max(1, SLICE_CELLS // len(centers))):
                some = unit[begin : begin + step]
                apart = squares[None, :] - 2 * some @ centers.T
                place[begin : begin + step] = apart.argmin(axis=1)
                gap[begin : begin + step] = np.sqrt(np.maximum(0.0, apart.min(axis=1) + 1.0))
            yield batch[sound].assign(list_id=place, gap=gap)

    return chunks.mapInPandas(nearest, StructType([*chunks.schema.fields]).add("list_id", "integer").add("gap", "double"))


def _centers(chunks: DataFrame, lists: int | None, rounds: int, seed: int) -> np.ndarray:
    """Directions that the lists lie around: a bounded sample of the chunks, clustered if ``rounds`` says so."""
    sound = chunks.filter("embedding IS NOT NULL AND exists(embedding, x -> x <> 0)").select("chunk_id", "embedding")
    n, width = sound.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return np.zeros((0, 0))
    most = max(1, CENTER_BYTES // (8 * width))
    wanted = min(lists or -(-n // LIST_ROWS), most, n)
    share = min(1.0, 1.2 * min(wanted * SAMPLE_PER_LIST, most * 4) / n)
    some = sound.filter(F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    sample = some.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(min(wanted * SAMPLE_PER_LIST, most * 4)).select("embedding").toPandas()
    points = np.unique(_unit(sample["embedding"]), axis=0)
    order = np.random.default_rng(seed).permutation(len(points))
    centers = points[order[:wanted]]
    for _ in range(rounds if len(points) > wanted else 0):
        place = (-2 * points @ centers.T + (centers**2).sum(1)[None, :]).argmin(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, place, points)
        held = np.bincount(place, minlength=len(centers))
        centers = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centers)
    return centers


def _summary(placed: DataFrame, centers: np.ndarray) -> Lists:
    rows = placed.groupBy("list_id").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).orderBy("list_id").collect()
    ids = np.array([r["list_id"] for r in rows], dtype="int64")
    return Lists(placed, ids, centers[ids] if len(ids) else centers[:0], np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows], dtype="int64"))


def vector_search(
    chunks: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.2, secured: bool = False, lists: int | None = None, nprobe: int = 4
) -> DataFrame:
    """The ``k`` chunks most similar to each query, by cosine: ``query_id, chunk_id, similarity, rank``.

    ``chunks``: chunk_id, embedding. ``queries``: query_id, embedding. Exact; similarity must be
    above ``threshold``, ties go to the smaller chunk id. ``secured`` applies the access policy
    before the best are chosen; then ``chunks`` has the columns of ``ACCESS_COLUMNS`` and
    ``queries`` has email, employee_id, groups. The chunks are dealt to lists first, by default one for ``LIST_ROWS``
    of them, and searched like an index.
    """
    columns = ["chunk_id", "embedding", *(ACCESS_COLUMNS if secured else [])]
    centers = _centers(chunks, lists, 0, 7)
    if not len(centers):
        return _nothing(chunks, queries)
    placed = checkpointed(numbered(_dealt(_with_grants(chunks.select(*columns), secured), centers), secured))
    return _search(_summary(placed, centers), queries, k, threshold, secured, nprobe, True)


def _with_grants(chunks: DataFrame, secured: bool) -> DataFrame:
    return chunks.select("chunk_id", "embedding", _grants_of_chunk().alias("grants")) if secured else chunks.select("chunk_id", "embedding")


def numbered(rows: DataFrame, secured: bool) -> DataFrame:
    """Chunks with a number each (``chunk_row``), which tells rows of one id apart; to be stored right after."""
    return rows.withColumn("chunk_row", F.monotonically_increasing_id()) if secured else rows


def small(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A checkpointed table of narrow rows, to be broadcast if it is small."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def _nothing(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    types = dict(queries.dtypes)["query_id"], dict(chunks.dtypes)["chunk_id"]
    return chunks.sparkSession.createDataFrame([], f"query_id {types[0]}, chunk_id {types[1]}, similarity double, rank int")


def _search(
    lists: Lists,
    queries: DataFrame,
    k: int,
    threshold: float,
    secured: bool,
    nprobe: int,
    exact: bool,
    maps: Callable[[DataFrame], DataFrame] | None = None,
    decode: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
) -> DataFrame:
    """Without ``secured``, ``_search_lists``. With it, every question is asked once for each grant that some chunk holds.

    A question is a direction and a grant; askers who share both share its ``k`` best chunks, and the best of an asker are
    among those of the asker's grants. Questions of grants that few chunks hold meet these chunks in a join.

    ``maps`` adds bit maps of the lists that are open to a query; ``decode`` makes the vectors of rows that have none.
    """
    if not len(lists.ids):
        return _nothing(lists.chunks, queries)
    if not secured:
        return _search_lists(lists, queries.select("query_id", "embedding"), k, threshold, nprobe, exact, None, decode)
    asked = queries.filter("embedding IS NOT NULL").select("query_id", "embedding", F.array_distinct(_grants_of_asker()).alias("grants"))
    asked = checkpointed(asked.withColumn("asker", F.monotonically_increasing_id()))
    directions = checkpointed(asked.select("embedding").distinct().withColumn("direction", F.monotonically_increasing_id()))
    held = lists.grants or checkpointed(lists.chunks.select(F.explode(F.array_distinct("grants")).alias("grant")).groupBy("grant").agg(F.count("*").alias("members")))
    many = F.broadcast(held.filter(F.col("members") > FEW_ROWS).select("grant"))  # at most a row for every FEW_ROWS chunks
    few = small(checkpointed(held.filter(F.col("members") <= FEW_ROWS).select("grant")))

    told = asked.join(small(directions, SMALL_ROWS // 10), "embedding").select("asker", "query_id", "direction", F.explode("grants").alias("grant"))
    common, rare = told.join(many, "grant").withColumn("common", F.lit(True)), told.join(many, "grant", "left_anti").join(few, "grant").withColumn("common", F.lit(False))
    told = checkpointed(common.unionByName(rare))
    questions = told.select("direction", "grant", "common").distinct().join(directions, "direction")
    questions = checkpointed(questions.withColumn("query_id", F.monotonically_increasing_id()))
    usual = questions.filter("common").select("query_id", "embedding", F.array("grant").alias("grants"))
    best = _search_lists(lists, usual, k, threshold, nprobe, exact, maps, decode)
    best = best.unionByName(top_k(_search_few(lists, questions.filter("NOT common"), many, threshold, decode), k)).drop("rank")
    best = best.withColumnRenamed("query_id", "question").join(questions.select(F.col("query_id").alias("question"), "direction", "grant"), "question").drop("question")
    # a chunk that an asker may see by several grants counts once
    found = told.join(small(checkpointed(best)), ["direction", "grant"]).select("query_id", "asker", "chunk_row", "chunk_id", "similarity")
    return top_k(found.repartition("query_id").dropDuplicates(["query_id", "asker", "chunk_row"]).drop("asker", "chunk_row"), k)


def _search_lists(
    lists: Lists,
    asked: DataFrame,
    k: int,
    threshold: float,
    nprobe: int,
    exact: bool,
    maps: Callable[[DataFrame], DataFrame] | None,
    decode: Callable[[pd.DataFrame], pd.DataFrame] | None,
) -> DataFrame:
    """First every query's ``nprobe`` nearest lists, then, if ``exact``, each list whose center and radius still allow
    a chunk as good as the ``k``-th found. Queries stay rows of a table all the way.
    """
    asked = checkpointed(maps(asked) if maps else asked)
    nearest = _probes(asked.withColumn("limit", F.lit(None).cast("double")), lists, nprobe, threshold)
    first = checkpointed(top_k(_search_pairs(lists, nearest, k, threshold, decode), k))
    if not exact or nprobe >= len(lists.ids):
        return first
    kth = first.filter(F.col("rank") == k).select("query_id", F.col("similarity").alias("limit"))
    open_queries = asked.join(kth, "query_id", "left").withColumn("limit", F.coalesce("limit", F.lit(float(threshold))))
    rest = _search_pairs(lists, _probes(open_queries, lists, nprobe, threshold), k, threshold)
    return top_k(first.drop("rank").unionByName(rest), k)


def _search_few(lists: Lists, questions: DataFrame, many: DataFrame, threshold: float, decode: Callable[[pd.DataFrame], pd.DataFrame] | None) -> DataFrame:
    """Every chunk above the threshold for questions (query_id, grant, embedding) of grants that few chunks hold."""
    chunks = lists.chunks.drop("gap")
    if lists.stored:  # only lists that hold a chunk with such a grant are read
        places = F.filter(F.sequence(F.lit(0), F.size("map") * 64 - 1), lambda i: F.getbit(F.get("map", (i / 64).cast("int")), i % 64) == 1)
        opened = lists.grants.join(small(checkpointed(questions.select("grant").distinct())), "grant", "left_semi").select(F.explode(places).alias("list_id")).distinct()
        chunks = chunks.filter(F.col("list_id").isin([row["list_id"] for row in opened.collect()]))
    chunks = chunks.withColumn("grant", F.explode(F.array_distinct("grants"))).drop("grants").join(many, "grant", "left_anti")
    met = chunks.join(questions.select("query_id", "grant", F.col("embedding").alias("asked")), "grant")
    fields = {f.name: f for f in met.schema.fields}
    named = ["query_id", "chunk_id", "chunk_row"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit = _unit((decode(batch) if decode else batch)["embedding"])
                scores = np.round((unit * _unit(batch["asked"], unit.shape[1])).sum(axis=1), DIGITS)
                yield batch[named].assign(similarity=scores)[scores > threshold]

    return met.mapInPandas(score, StructType([fields[c] for c in named]).add("similarity", "double"))


def _probes(asked: DataFrame, lists: Lists, nprobe: int, threshold: float) -> DataFrame:
    """A row for each query and list to search: the nearest lists without a ``limit``, the other open ones with it."""
    own = Lists(None, lists.ids, lists.centers, lists.radius, lists.members)
    names = [c for c in asked.columns if c not in ("limit", "maps")]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for begin in range(0, len(whole), step := max(1, SLICE_CELLS // len(own.ids))):
                batch = whole.iloc[begin : begin + step]
                unit = _unit(batch["embedding"], own.centers.shape[1])
                sound = ~np.isnan(unit).any(axis=1)
                batch, gaps = batch[sound], own.gaps(unit[sound])
                closed = _closed(batch["maps"], own.ids) if "maps" in batch else np.zeros(gaps.shape, dtype=bool)
                gaps[closed] = np.inf
                wanted = np.zeros(gaps.shape, dtype=bool)
                np.put_along_axis(wanted, np.argsort(gaps, axis=1, kind="stable")[:, :nprobe], True, axis=1)
                limit = batch["limit"].to_numpy(dtype="float64")
                if not np.isnan(limit).all():
                    reach = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * limit)) + 1e-6
                    wanted = (gaps - own.radius[None, :] <= reach[:, None]) & ~wanted
                query, place = np.nonzero(wanted & ~closed)
                for at in range(0, len(query), PROBE_ROWS):
                    some = slice(at, at + PROBE_ROWS)
                    yield batch[names].iloc[query[some]].assign(list_id=own.ids[place[some]].astype("int32"))

    return asked.mapInPandas(probe, StructType([f for f in asked.schema.fields if f.name in names]).add("list_id", "integer"))


def _closed(maps: pd.Series, ids: np.ndarray) -> np.ndarray:
    """Query by list: no bit map of the query has the list's bit set."""
    shut = np.ones((len(maps), len(ids)), dtype=bool)
    for row, some in enumerate(maps):
        for words in some:
            bits = np.asarray(words, dtype="int64")[ids // 64] >> (ids % 64) & 1
            shut[row] &= bits == 0
    return shut


def _search_pairs(lists: Lists, probes: DataFrame, k: int, threshold: float, decode: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Chunks and queries meet by list. A long list is dealt over shares, the queries of a list over groups, so a meeting
    has at most about ``BLOCK_ROWS`` chunks and ``QUERY_ROWS`` queries; only queries that probe a list are scored in it."""
    spark = probes.sparkSession
    probes = checkpointed(probes)
    asked = probes.groupBy("list_id").agg(F.count("*").alias("asked"))
    sizes = spark.createDataFrame([(int(i), -(-int(n) // BLOCK_ROWS)) for i, n in zip(lists.ids, lists.members)], "list_id int, shares int")
    plan = sizes.join(asked, "list_id").withColumn("parts", F.ceil(F.col("asked") / QUERY_ROWS).cast("int")).drop("asked")
    plan = checkpointed(plan)  # one row for each list
    chunks = lists.chunks.drop("gap")
    if lists.stored:
        chunks = chunks.filter(F.col("list_id").isin([row["list_id"] for row in plan.select("list_id").collect()]))
    share, part = F.pmod(F.xxhash64("chunk_id"), F.col("shares")), F.pmod(F.xxhash64("query_id"), F.col("parts"))
    left = chunks.join(plan, "list_id").withColumn("share", share.cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = probes.join(plan, "list_id").withColumn("part", part.cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    keys = ["list_id", "share", "part"]
    types = dict(probes.dtypes)["query_id"], dict(lists.chunks.dtypes)["chunk_id"]
    named = {"query_id": types[0], "chunk_id": types[1]} | ({"chunk_row": "bigint"} if "chunk_row" in chunks.columns else {}) | {"similarity": "double"}

    def search(rows: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(some):
            return pd.DataFrame({name: [] for name in named})
        return _best(decode(rows) if decode else rows, some, k, threshold)

    left, right = left.drop("shares", "parts"), right.drop("shares", "parts")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    return met.applyInPandas(search, ", ".join(f"{name} {kind}" for name, kind in named.items()))


def top_k(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("chunk_id").asc())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# --- inverted lists -------------------------------------------------------------------------


def build_ivf(chunks: DataFrame, path: str, lists: int | None = None, seed: int = 7, rounds: int = 10) -> None:
    """Deal the chunks to inverted lists and write them with their access data, one partition per list.

    Centers are clustered from a bounded sample; every chunk is indexed. Next to the lists go the centers. The rebalance hint
    spreads a list that holds much of the data.
    """
    spark = chunks.sparkSession
    secured = set(ACCESS_COLUMNS) <= set(chunks.columns)
    centers = _centers(chunks, lists, rounds, seed)
    dealt = _dealt(_with_grants(chunks, secured), centers) if len(centers) else _with_grants(chunks, secured).limit(0).withColumns({"list_id": F.lit(0), "gap": F.lit(0.0)})
    numbered(dealt, secured).hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    spark.createDataFrame(rows, "list_id int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def ivf_search(
    path: str, queries: DataFrame, k: int = 5, threshold: float = 0.2, nprobe: int = 10, exact: bool = True, secured: bool = False
) -> DataFrame:
    """Search an index: each query's ``nprobe`` nearest lists, whatever other queries are asked with it.

    That alone may miss chunks. ``exact`` adds every list that could still hold a better chunk; the result then equals
    ``vector_search``. ``secured`` needs an index built with the access columns.
    """
    spark = queries.sparkSession
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()
    centers = np.array([row["centroid"] for row in centroids]) if centroids else np.zeros((0, 0))
    if not len(centers):
        return _nothing(spark.read.schema("chunk_id bigint").parquet(f"{path}/lists"), queries)
    chunks = spark.read.parquet(f"{path}/lists")
    if secured and "grants" not in chunks.columns:
        raise ValueError("the index was built without access data")
    return _search(_summary(chunks if secured else chunks.drop("grants", "chunk_row"), centers), queries, k, threshold, secured, nprobe, exact)


# --- fusion and context ---------------------------------------------------------------------


def rank_fusion(results: DataFrame, max_results: int = 15, k: int = 0, identity: tuple[str, ...] = ("title", "chunk_index")) -> DataFrame:
    """Merge the ranked results of several queries of one request.

    ``results``: request_id, query_pos, query, rank, title, chunk_index, chunk_id, category. A chunk
    scores the sum of ``1 / (k + rank)``; equal scores keep the order in which they were first seen,
    and a chunk is shown as it was first seen; what was first seen at the same place goes by chunk id. A group holds at most
    the results of one request.
    """
    results = results.repartition("request_id")  # one shuffle for all that follows
    seen = F.sort_array(F.collect_list(F.struct("query_pos", "rank", "query", "chunk_id", "category")))
    merged = results.groupBy("request_id", *identity).agg(seen.alias("seen"))
    score = F.aggregate("seen", F.lit(0.0), lambda acc, s: acc + F.lit(1.0) / (s["rank"] + F.lit(k)))
    scored = merged.select(
        "request_id",
        *identity,
        F.col("seen")[0]["chunk_id"].alias("chunk_id"),
        F.col("seen")[0]["category"].alias("category"),
        F.round(score, DIGITS).alias("score"),
        F.transform("seen", lambda s: s["query"]).alias("matching_queries"),
        F.struct(F.col("seen")[0]["query_pos"], F.col("seen")[0]["rank"]).alias("first_seen"),
    )
    order = W.partitionBy("request_id").orderBy(F.col("score").desc(), F.col("first_seen").asc(), "chunk_id", *identity)
    placed = scored.withColumn("position", F.row_number().over(order))
    return placed.filter(F.col("position") <= max_results).drop("first_seen")


def described(found: DataFrame, info: DataFrame, key: str = "chunk_id", rows: int = SMALL_ROWS) -> DataFrame:
    """``found`` with what ``info`` says of its chunks. Few chunks may answer very many queries; if few are found in all, what is
    known of them is broadcast, so no task gets all rows of one chunk."""
    found = checkpointed(found)
    needed = checkpointed(info.join(found.select(key).distinct(), key, "left_semi"))
    return found.join(small(needed, rows), key)


def context_rows(fused: DataFrame, per_doc: int = 3, total: int = 15) -> DataFrame:
    """At most ``per_doc`` chunks of one title and ``total`` of one request, in fused order."""
    by_title = W.partitionBy("request_id", "title").orderBy("position")
    by_request = W.partitionBy("request_id").orderBy("position")
    few = fused.withColumn("of_title", F.row_number().over(by_title)).filter(F.col("of_title") <= per_doc)
    numbered = few.withColumn("number", F.row_number().over(by_request)).filter(F.col("number") <= total)
    return numbered.drop("of_title")


def format_context(rows: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """The context rows of each request as one text; ``rows`` needs ``content``.

    With ``requests`` (request_id) those that found nothing get the standard sentence.
    """
    part = F.format_string(
        wire.CONTEXT_PART,
        "number", "title", "category", "score", F.array_join("matching_queries", ", "), "content",
    )
    parts = F.sort_array(F.collect_list(F.struct("number", part.alias("part"))))
    texts = rows.groupBy("request_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), wire.CONTEXT_BREAK).alias("context"))
    if requests is None:
        return texts
    asked = requests.select("request_id").join(texts, "request_id", "left")
    return asked.withColumn("context", F.coalesce("context", F.lit(wire.NO_CONTEXT)))


def recent_turns(turns: DataFrame, n: int = 20, user: str = "user_id", order: str = "turn") -> DataFrame:
    """The last ``n`` turns of each user, oldest first by ``turn_number``.

    Spark limits the rows of a user within each task before the shuffle, so a user with very many
    turns costs ``n`` rows per task.
    """
    last = W.partitionBy(user).orderBy(F.col(order).desc())
    kept = turns.withColumn("back", F.row_number().over(last)).filter(F.col("back") <= n)
    return kept.withColumn("turn_number", F.row_number().over(W.partitionBy(user).orderBy(order))).drop("back")


def document_rows(hits: DataFrame) -> DataFrame:
    """Documents of classifier hits: those with text, titled by file name, metadata title or a default.

    ``hits``: hit_id, file_name, title, text, and whatever else is to be kept.
    """
    titled = F.coalesce(F.nullif("file_name", F.lit("")), "title", F.lit(wire.UNTITLED))
    return hits.filter(~is_blank(F.col("text"))).withColumn("title", titled).withColumnRenamed("text", "content")
