"""Language identification by rank-order profiles of character n-grams.

A text's n-grams (one to three characters, a blank standing for every run of other characters than letters) are
ranked by frequency. The same is done for all sampled texts of a language. The distance of a text to a language adds
up how far each of its most frequent n-grams is out of place in the language's ranking; the nearest language wins.

Defined results. Null texts and texts without a letter are ``und`` with score 0. Ties in frequency fall to the smaller
code points, ties in distance to the smaller language name. Rows without a language or text aren't learned from; without any
learned language every text is ``und``. Repeated rows are predicted one by one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custodia.llm.common import fold

#: Ranks that a profile and a text have at most.
RANKS = 300
#: About so many labelled rows are learned from; beyond, those with the smallest hashes of their ids.
FIT_ROWS = 20_000
#: Code points handled at once, so that very long texts need bounded memory.
PIECE = 1 << 18
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points below 0x20000 are letters; the others count as letters."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x20000)]))
    return _LETTERS[0]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(place, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as numbers (21 bits a character, 1 for a blank) and how often each occurs."""
    table, keys, counts = letter_table(), [], []
    left = np.ones(1, dtype=np.int64)
    for start in range(0, len(text), PIECE):
        codes = np.frombuffer(text[start : start + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = table[np.minimum(codes, 0x1FFFF)] | (codes >= 0x20000)
        c = np.where(letter, codes.astype(np.int64) + 1, 1)
        c = np.concatenate([left, c])
        c = c[np.concatenate([[True] * len(left), (c[len(left) :] > 1) | (c[len(left) - 1 : -1] > 1)])]
        new = len(left)
        left = c[-2:]
        parts = [c[new:][c[new:] > 1]]
        if len(c) > new:
            parts.append((c[new - 1 : -1] << 21) | c[new:])
        if len(c) > 2:
            first = max(new, 2)
            three = (c[first - 2 : -2] << 42) | (c[first - 1 : -1] << 21) | c[first:]
            parts.append(three[c[first - 1 : -1] > 1])
        own, n = np.unique(np.concatenate(parts), return_counts=True)
        keys.append(own)
        counts.append(n)
    if not keys:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return (keys[0], counts[0]) if len(keys) == 1 else _summed(keys, counts)


def ranked(keys: np.ndarray, counts: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent n-grams, the most frequent first."""
    return keys[np.argsort(-counts, kind="stable")[:ranks]]


def profiles(labelled: DataFrame, text: str, lang: str, ranks: int = RANKS) -> dict[str, list[int]]:
    """Ranked n-grams of every language: ``ranks`` numbers for each, so the result is as small as the list of languages."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            fresh: dict[str, list] = {}
            for body, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fresh.setdefault(name, []).append(grams(body))
            for name, found in fresh.items():
                found = [*found, held[name]] if name in held else found
                held[name] = _summed([k for k, _ in found], [n for _, n in found])
        for name, (keys, counts) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"]
            )

    rows = labelled.select(F.col(text), F.col(lang)).filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counted = rows.mapInArrow(work, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    best = counted.withColumn("place", place).filter(F.col("place") <= ranks)
    out: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "place").collect():
        out.setdefault(r.lang, []).append(r.gram)
    return out


class Ranking:
    """Profiles of all languages as one sorted table: n-gram -> rank in each language."""

    def __init__(self, learned: dict[str, list[int]], ranks: int):
        self.names = sorted(learned)
        self.keys = np.unique(np.array([g for own in learned.values() for g in own], dtype=np.int64))
        self.ranks = ranks
        self.places = np.full((len(self.names), len(self.keys) + 1), ranks, dtype=np.int64)
        self.known = np.zeros((len(self.names), len(self.keys) + 1), dtype=bool)
        for i, name in enumerate(self.names):
            at = np.searchsorted(self.keys, learned[name])
            self.places[i, at] = np.arange(len(at))
            self.known[i, at] = True

    def nearest(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 for equal rankings, 0 if nothing is shared."""
        keys, counts = grams(text or "")
        if not self.names or not (keys < 1 << 21).any():  # single characters are letters
            return UNKNOWN, 0.0
        own = ranked(keys, counts, self.ranks)
        at = np.searchsorted(self.keys, own)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != own] = len(self.keys)
        out_of_place = np.where(self.known[:, at], np.abs(self.places[:, at] - np.arange(len(own))), self.ranks).sum(axis=1)
        best = int(out_of_place.argmin())
        return self.names[best], float(1 - out_of_place[best] / (self.ranks * len(own)))


def languages(docs: DataFrame, learned: dict[str, list[int]], text: str = "text", ranks: int = RANKS) -> DataFrame:
    """``docs`` without the text, with ``lang_pred`` and ``score``; columns with these names are replaced."""
    others = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    kept = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`"))
    schema = kept.drop(text).schema.add("lang_pred", "string").add("score", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = Ranking(learned, ranks)
        for batch in batches:
            found = [ranking.nearest(body) for body in batch.column(len(others)).to_pylist()]
            columns = [batch.column(i) for i in range(len(others))]
            columns += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "lang_pred", "score"])

    return kept.mapInArrow(work, schema)


def sampled(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """About ``limit`` rows at most: those whose id's hash falls into that share of its range."""
    n = rows.count()
    if n <= limit:
        return rows
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int((1 << 20) * limit / n))


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Learn from the documents outside the held-out fold and predict all: ``doc_id, held_out, lang_pred, score``."""
    held = fold(F.col(doc_id), 4) == 2
    train = docs.filter(~held & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(doc_id, text, lang)
    learned = profiles(sampled(train, doc_id, fit_rows), text, lang)
    return languages(docs.select(doc_id, held.alias("held_out"), text), learned, text)
