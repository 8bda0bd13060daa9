"""Dictionary annotators and the label rules built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Bytes of the piece by which a keyword is looked up; shorter keywords are looked up whole.
GRAM = 6
#: Bits of the map of pieces for each keyword, and of the smallest and largest map.
BITS_PER_KEYWORD, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 28
#: Bytes of text that are worked on at once; one text at least.
PIECE = 1 << 20


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(20)) & np.uint64(bits - 1)


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, bounds)`` of successive texts with about ``PIECE`` bytes; a null text is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    start = 0
    while start < len(column):
        stop = min(max(int(np.searchsorted(bounds, bounds[start] + PIECE, side="right")) - 1, start + 1), len(column))
        yield start, data[bounds[start] : bounds[stop]], bounds[start : stop + 1] - bounds[start]
        start = stop


def _keys(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes at each place of some texts as a number; the size is part of it."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    lanes = np.ndarray((len(data),), dtype="<u8", buffer=padded, strides=(1,))
    return (lanes & np.uint64((1 << (8 * size)) - 1)) | np.uint64(size << 56)


def _pieces(needles: DataFrame) -> DataFrame:
    """``(needle, key, before, after)``: every piece of each keyword, and how many bytes of it stand before and behind."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, bounds in _texts(batch.column(0)):
                sizes = np.diff(bounds)
                size = np.minimum(sizes, GRAM)
                made = sizes - size + 1
                owner = np.repeat(np.arange(len(sizes)), made)
                before = np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made)
                at, key = bounds[:-1][owner] + before, np.zeros(len(owner), dtype=np.uint64)
                for n in np.unique(size):
                    own = size[owner] == n
                    key[own] = _keys(data, int(n))[at[own]]
                after = sizes[owner] - before - size[owner]
                needle = batch.column(0).take(pa.array(owner + first))
                yield pa.RecordBatch.from_arrays([needle, pa.array(key.view(np.int64)), pa.array(before), pa.array(after)], names=["needle", "key", "before", "after"])

    return needles.mapInArrow(work, "needle string, key bigint, before bigint, after bigint")


def annotate(docs: DataFrame, dictionary: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Keywords found in each text, ignoring case: ``<ident>, annotator, keyword``.

    ``dictionary``: annotator, keyword. Every text is read whole and once, whatever the length of the list. Of the pieces of
    ``GRAM`` bytes that a keyword has, one stands for it: the one that the fewest keywords have. Of all places of a text only those
    become rows whose piece stands for some keyword, as a bit map tells; they are joined to the keywords with the bytes around them, in
    which the keyword is then looked for.
    """
    words = dictionary.filter("keyword <> ''").select("annotator", "keyword", F.lower("keyword").alias("needle"))
    pieces = checkpointed(_pieces(words.select("needle").distinct()))
    held = pieces.select("needle", "key").distinct().groupBy("key").agg(F.count("*").alias("keywords"))
    best = F.min_by(F.struct("key", "before", "after"), F.struct("keywords", "key", "before")).alias("best")
    keyed = checkpointed(pieces.join(held, "key").groupBy("needle").agg(best).select("needle", "best.*"))
    n, before, after = keyed.agg(F.count("*"), F.max("before"), F.max("after")).first()
    sizes = sorted(r[0] for r in keyed.select(F.shiftrightunsigned("key", 56)).distinct().collect())  # GRAM at most
    bits = min(max(LEAST_BITS, 1 << (BITS_PER_KEYWORD * n).bit_length()), MOST_BITS)
    known = _map_of(keyed.select("key"), bits)
    read = docs.select(F.col(ident).alias("ident"), F.lower(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, bounds in _texts(batch.column(1)):
                for size in sizes:
                    key = _keys(data, size)
                    slot = _slots(key, bits)
                    at = np.flatnonzero(known[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
                    owner = np.searchsorted(bounds, at, side="right") - 1
                    fits = at + size <= bounds[owner + 1]
                    at, owner = at[fits], owner[fits]
                    if size < GRAM:  # whole keywords: one place in a text is enough
                        _, once = np.unique(np.stack([owner, key[at].view(np.int64)]), axis=1, return_index=True)
                        at, owner = at[once], owner[once]
                    begin, end = np.maximum(at - before, bounds[owner]), np.minimum(at + size + after, bounds[owner + 1])
                    near = pa.array([data[b:e].tobytes() for b, e in zip(begin, end)], type=pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner + first)), pa.array(key[at].view(np.int64)), near], names=["ident", "key", "near"])

    kind = docs.schema[ident].dataType.simpleString()
    found = read.mapInArrow(work, f"ident {kind}, key bigint, near binary")
    met = found.join(keyed.select("needle", "key"), "key").filter(F.contains("near", F.col("needle").cast("binary"))).select("ident", "needle").distinct()
    return met.join(words, "needle").select(F.col("ident").alias(ident), "annotator", "keyword")


def _map_of(keys: DataFrame, bits: int) -> np.ndarray:
    """A bit for each key; the map has at most ``MOST_BITS``, whatever the number of keys."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slots(batch.column(0).to_numpy().view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(slot.view(np.int64))], names=["hash"])

    words = keys.mapInArrow(slots, "hash bigint").groupBy(F.shiftright("hash", 6).alias("place")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("hash") % 64).cast("int"))).alias("word")
    ).toPandas()
    known = np.zeros(bits // 64, dtype=np.uint64)
    known[words["place"].to_numpy(dtype=np.int64)] = words["word"].to_numpy(dtype=np.int64).view(np.uint64)
    return known


def apply_label_rules(annotations: DataFrame, rules: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Labels of each document: a rule gives its label when its annotator found something.

    ``rules``: annotator, label. One document has at most as many labels as there are rules.
    """
    hits = annotations.select(ident, "annotator").join(rules, "annotator")
    return hits.groupBy(ident).agg(F.array_sort(F.collect_set("label")).alias("labels"))
