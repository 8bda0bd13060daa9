"""Ranked lexical search: best-first document intervals under range-maximum bounds from the posting lists.

The index is a table of blocks. A block holds some successive documents, in the order of their ids: their lengths, and a posting list
(documents and occurrences, as places in the block) for each of their terms. It is made in one pass over the texts, by a
table-driven automaton over bytes (``spans.py``), without a shuffle.

A search scores with integers only: a term adds its weight times the impact of its posting. Over the impacts of each posting list
of a block stands a sparse table that answers the maximum of any range. For an interval of documents, the weighted maxima of all
terms sum up to a bound on every score in it. Intervals are taken best bound first, some at a time, and split at the document where the
largest of these maxima lies; that document is scored, and the two rests get bounds of their own. An interval goes when its bound is
below the last of the best found so far, or equal with only larger ids. What a task finds in a block bounds the next one; only its best
rows per query leave it. Blocks meet queries in groups of bounded size, each a pass over the index.

Defined results. Null and empty texts have no terms; such documents count for nothing and aren't found, items without terms have no rows.
Rows of one item id are one item with the terms of all; a null item id is no item. Equal scores are ranked by document id, null ids
last. Repeated rows are documents of their own. Extra columns are ignored. No documents, or none with a score above 0, give no rows.
A very long text is one block by itself. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from custodia.llm.spans import BETWEEN, INSIDE, Words, pieces, spread, steps
from custodia.session import checkpointed

BEST = 50
#: Bytes of text in a block, terms of the queries that are asked in one pass, and intervals split at a time.
BLOCK_BYTES = 8 << 20
GROUP_TERMS = 1 << 18
SPLIT_AT_ONCE = 512
#: Stands for a null id, behind all others.
NO_ID = np.iinfo(np.int64).max

INDEX = "doc_ids array<bigint>, lengths array<bigint>, terms array<bigint>, ends array<int>, docs array<int>, counts array<int>"


def machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case (A-Z only); classes (1: in a term), moves and marks (1: a term begins) of the automaton."""
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    classes = np.zeros(256, dtype=np.uint8)
    for first, last in (("0", "9"), ("A", "Z"), ("a", "z")):
        classes[ord(first) : ord(last) + 1] = 1
    classes[0x80:] = 1
    return lower, classes, np.array([BETWEEN, INSIDE], dtype=np.uint8), np.array([[0, 1], [0, 0]], dtype=np.uint8)


def terms_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, term)`` of all terms of some texts, in the order of rows, piece by piece."""
    lower, *tables = machine()
    for first, rows, data, bounds in pieces(texts):
        small = lower[data]
        marks, after = steps(small, bounds, *tables)
        words = Words(small, bounds, marks == 1, after)
        yield words.owner + first, words.hashes().view(np.int64)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], type=pa.int32()), pa.array(values, type=kind))


def block_of(ids: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    """The block of some documents (``INDEX``)."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    found = [(place[row], term) for row, term in terms_of(texts)]
    row, term = (np.concatenate([f[k] for f in found] or [np.zeros(0, dtype=np.int64)]) for k in range(2))
    lengths = np.bincount(row, minlength=len(ids))
    known, number = np.unique(term, return_inverse=True)
    posting, count = np.unique(number * len(ids) + row, return_counts=True)
    ends = np.cumsum(np.bincount(posting // max(len(ids), 1), minlength=len(known)))
    big, small = pa.int64(), pa.int32()
    columns = [_lists(ids[order], big), _lists(lengths, big), _lists(known, big), _lists(ends, small), _lists(posting % max(len(ids), 1), small), _lists(count, small)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_ids", "lengths", "terms", "ends", "docs", "counts"])


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The blocks of all documents. Write it, or checkpoint it: searches read it several times."""
    read = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(int(NO_ID))).alias("id"), F.col(f"`{text}`").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for first, rows, data, _ in pieces(batch.column(1), block_bytes // 8):
                ids.append(batch.column(0).slice(first, rows).to_numpy())
                texts.append(batch.column(1).slice(first, rows))
                held += len(data)
                if held >= block_bytes:
                    yield block_of(np.concatenate(ids), pa.concat_arrays(texts))
                    ids, texts, held = [], [], 0
        if ids:
            yield block_of(np.concatenate(ids), pa.concat_arrays(texts))

    return read.mapInArrow(work, INDEX)


def query_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, term)``, each term of an item once."""
    read = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").alias("text")).filter("item IS NOT NULL")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, term in terms_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(term)], names=["item", "term"])

    return read.mapInArrow(work, f"item {items.schema[item_id].dataType.simpleString()}, term bigint").distinct()


def holders(blocks: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``(term, df)``: documents that hold each of the terms ``wanted`` (sorted)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                terms, ends = (batch.column(k)[row].values.to_numpy() for k in range(2))
                at = np.searchsorted(terms, wanted)
                there = np.flatnonzero(at < len(terms))
                there = there[terms[at[there]] == wanted[there]]
                total[there] += np.diff(ends, prepend=0)[at[there]]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[seen]), pa.array(total[seen])], names=["term", "df"])

    return blocks.select("terms", "ends").mapInArrow(work, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def weight(n: int, df: int) -> int:
    """Fixed by the contract."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Maxima:
    """Sparse tables over the impacts of posting lists: the largest value in any range of a list, and where it lies."""

    def __init__(self, impact: np.ndarray, start: np.ndarray, size: np.ndarray):
        # value and place in one number; of equal impacts the one that comes first is larger
        place = spread(np.zeros(len(size), dtype=np.int64), size)
        level = (impact << np.int64(32)) | (np.int64((1 << 32) - 1) - place)
        levels, base, begin, kept = [level], [start], 0, start
        width = 1
        while (size >= 2 * width).any():
            begin += len(level)
            lists = np.flatnonzero(size >= 2 * width)
            made = size[lists] - 2 * width + 1
            left = spread(kept[lists], made)
            kept = np.zeros(len(size), dtype=np.int64)
            kept[lists] = np.cumsum(made) - made
            level = np.maximum(level[left], level[left + width])
            levels.append(level)
            base.append(kept + begin)
            width *= 2
        self.table, self.base = np.concatenate(levels), np.array(base)

    def of(self, lists: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(impact, place in the list)`` of the maximum in ``low <= place < high`` of each list; 0 where nothing lies there."""
        filled = high > low
        size = np.where(filled, high - low, 1)
        power = np.frexp(size.astype(np.float64))[1] - 1
        at = self.base[power, lists]
        low, end = np.where(filled, low, 0), np.where(filled, high - (1 << power), 0)
        best = np.where(filled, np.maximum(self.table[at + low], self.table[at + end]), 0)
        return best >> np.int64(32), np.int64((1 << 32) - 1) - (best & np.int64((1 << 32) - 1))


class Block:
    """A block of the index with what the terms of some queries need of it."""

    def __init__(self, row: dict[str, np.ndarray], wanted: np.ndarray, n: int, total: int):
        self.ids, lengths = row["doc_ids"], row["lengths"]
        at = np.searchsorted(row["terms"], wanted)
        there = np.flatnonzero(at < len(row["terms"]))
        there = there[row["terms"][at[there]] == wanted[there]]
        ends = row["ends"].astype(np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        size = (ends - begins)[at[there]]
        taken = spread(begins[at[there]], size)
        self.list_of = np.full(len(wanted), -1)
        self.list_of[there] = np.arange(len(there))
        self.size, self.start = size, np.cumsum(size) - size
        self.docs, tf = row["docs"][taken].astype(np.int64), row["counts"][taken].astype(np.int64)
        m = 100 - 50 + (50 * lengths * n) // total  # fixed by the contract, as is the next line
        self.impact = (1000000000 * tf) // (1000 * tf + 20 * m[self.docs])
        self.sought = np.repeat(np.arange(len(size)), size) * len(self.ids) + self.docs
        self.maxima = Maxima(self.impact, self.start, size) if len(taken) else None

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best of this block and of ``(score, ids)``, which are ranked; ``terms`` are places in the terms wanted."""
        own = self.list_of[terms]
        lists, weights = own[own >= 0], weights[own >= 0]
        if not len(lists):
            return score, ids
        low, high = np.zeros((1, len(lists)), dtype=np.int64), self.size[lists][None, :]
        first = np.zeros(1, dtype=np.int64)  # the interval's first document
        last = np.full(1, len(self.ids), dtype=np.int64)
        top, at = self.maxima.of(lists[None, :], low, high)
        bound = (top * weights).sum(axis=1)
        while True:
            held = (bound > 0) & (first < last)
            if len(score) == k:
                held &= (bound > score[-1]) | ((bound == score[-1]) & (self.ids[np.minimum(first, len(self.ids) - 1)] < ids[-1]))
            open_ = np.flatnonzero(held)
            if not len(open_):
                return score, ids
            if len(open_) > SPLIT_AT_ONCE:
                ranked = np.argpartition(-bound[open_], SPLIT_AT_ONCE)
                now, later = open_[ranked[:SPLIT_AT_ONCE]], open_[ranked[SPLIT_AT_ONCE:]]
            else:
                now, later = open_, open_[:0]
            # split at the document with the largest of the weighted maxima
            heaviest = (top[now] * weights).argmax(axis=1)
            doc = self.docs[self.start[lists[heaviest]] + at[now, heaviest]]
            key = lists[None, :] * len(self.ids) + doc[:, None]
            place = np.searchsorted(self.sought, key)
            hit = (place < len(self.sought)) & (self.sought[np.minimum(place, len(self.sought) - 1)] == key)
            gained = np.where(hit, self.impact[np.minimum(place, len(self.sought) - 1)], 0)
            found = (gained * weights).sum(axis=1)
            good = np.flatnonzero(found > 0)
            score, ids = np.concatenate([score, found[good]]), np.concatenate([ids, self.ids[doc[good]]])
            ranked = np.lexsort((ids, -score))[:k]
            score, ids = score[ranked], ids[ranked]
            cut = place - self.start[lists]
            rest = [(low[now], cut, first[now], doc), (cut + hit, high[now], doc + 1, last[now])]
            new_low, new_high, new_first, new_last = (np.concatenate([side[i] for side in rest]) for i in range(4))
            new_top, new_at = self.maxima.of(lists[None, :], new_low, new_high)
            parts = [(low[later], new_low), (high[later], new_high), (first[later], new_first), (last[later], new_last), (top[later], new_top), (at[later], new_at)]
            low, high, first, last, top, at = (np.concatenate(part) for part in parts)
            bound = np.concatenate([bound[later], (new_top * weights).sum(axis=1)])


def search(blocks: DataFrame, items: DataFrame, k: int = BEST, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The ``k`` documents of an index with the highest scores for each item: ``item_id, rank, doc_id, score``."""
    terms = checkpointed(query_terms(items, item_id, text))
    some = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda total, x: total + F.when(x > 0, 1).otherwise(0))
    all_ = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda total, x: total + x)
    n, total = blocks.agg(F.coalesce(F.sum(some), F.lit(0)), F.coalesce(F.sum(all_), F.lit(0))).first()
    groups = -(-terms.count() // GROUP_TERMS) if n else 0
    found = None
    for group in range(groups):  # the queries of a group are bounded; documents never pass through here
        asked = terms.filter(F.pmod(F.xxhash64("item"), F.lit(groups)) == group).toPandas().sort_values(["item", "term"])
        wanted = np.unique(asked["term"].to_numpy(dtype=np.int64))
        df = holders(blocks, wanted).toPandas()
        weights = np.zeros(len(wanted), dtype=np.int64)
        weights[np.searchsorted(wanted, df["term"].to_numpy(dtype=np.int64))] = [weight(n, d) for d in df["df"]]
        part = _ranked(blocks, asked, wanted, weights, k, n, total, items.schema[item_id].dataType.simpleString())
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind = items.schema[item_id].dataType.simpleString()
        found = items.sparkSession.createDataFrame([], f"item {kind}, doc_id bigint, score bigint")
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_id), "rank", F.nullif("doc_id", F.lit(int(NO_ID))).alias("doc_id"), "score")


def _ranked(blocks: DataFrame, asked, wanted: np.ndarray, weights: np.ndarray, k: int, n: int, total: int, kind: str) -> DataFrame:
    names = asked["item"].drop_duplicates().tolist()
    places = [np.searchsorted(wanted, terms.to_numpy(dtype=np.int64)) for _, terms in asked.groupby("item", sort=False)["term"]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        best = [(none, none)] * len(names)
        for batch in batches:
            for row in range(batch.num_rows):
                columns = {name: batch.column(i)[row].values.to_numpy() for i, name in enumerate(batch.schema.names)}
                block = Block(columns, wanted, n, total)
                for query, terms in enumerate(places):
                    best[query] = block.best(terms, weights[terms], k, *best[query])
        for query, (score, ids) in enumerate(best):
            if len(score):
                item = pa.array([names[query]] * len(score))
                yield pa.RecordBatch.from_arrays([item, pa.array(ids), pa.array(score)], names=["item", "doc_id", "score"])

    return blocks.mapInArrow(work, f"item {kind}, doc_id bigint, score bigint")
