"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic steps.

The statistics of a text (shares of characters, repeated words, lines and pairs, lengths) are scaled by their mean and
deviation over the sampled labelled rows; cosines of random projections approximate a Gaussian kernel on them. Each
partition adds up its part of the normal equations, and the sum of a fixed number of them is solved on the driver.
A fifth of the sampled rows stays out of the fit and calibrates the scores, through counts in a fixed number of bins.

Defined results. Null and empty texts have all statistics 0 and are scored like others. Rows with a null id or label
aren't learned from; of repeated ids each row counts. Without labels, or with one kind only, every score is the mean label
(0.5 without any). Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia.llm.common import fold
from custodia.llm.language import sampled
from custodia.session import checkpointed

FEATURES = 256
#: Width of the Gaussian kernel, in deviations for each statistic.
WIDTH = 1.0
RIDGE = 1.0
BINS = 1000
SUMMED_PARTS = 8
#: About so many labelled rows are learned from; beyond, those with the smallest hashes of their ids.
FIT_ROWS = 50_000
THRESHOLD = 0.3
STATISTICS = (
    "log_words", "word_length", "longest", "distinct", "same_as_last", "top_word", "distinct_pairs", "log_lines", "repeated_lines",
    "line_words", "lower", "upper", "digits", "spaces", "stops", "symbols", "marks", "other", "symbol_words", "upper_words",
)
_KINDS: list[np.ndarray] = []


def byte_kinds() -> np.ndarray:
    """Kind of each byte: lower, upper, digit, space, stop, symbol, mark, other (parts of longer characters)."""
    if not _KINDS:
        kinds = np.full(256, 7, dtype=np.uint8)
        for kind, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r\x0b\x0c", ".,;:", "#*$%&|<>=+~^_@/\\{}[]", "!?\"'()-`")):
            kinds[[ord(c) for c in chars]] = kind
        _KINDS.append(kinds)
    return _KINDS[0]


def statistics(text: str | None) -> list[float]:
    if not text:
        return [0.0] * len(STATISTICS)
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    kinds = np.bincount(byte_kinds()[data], minlength=8) / len(data)
    words, lines = text.split(), [line for line in text.split("\n") if line.strip()]
    n = max(len(words), 1)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:]))) / max(n - 1, 1)
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    marked = sum(w[-1] in "#*$%&|<>!" for w in words) / n
    upper = sum(w.isupper() for w in words) / n
    return [
        math.log1p(len(words)), min(len(text) / n, 50.0), math.log1p(max(map(len, words), default=0)), len(seen) / n, same,
        max(seen.values(), default=0) / n, pairs, math.log1p(len(lines)), 1 - len(set(lines)) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)), *kinds.tolist(), marked, upper,
    ]


def with_statistics(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` without the text, with ``stats array<double>``."""
    others = [c for c in docs.columns if c not in (text, "stats")]
    kept = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([statistics(t) for t in batch.column(len(others)).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(others))], made], names=[*others, "stats"])

    return kept.mapInArrow(work, kept.drop(text).schema.add("stats", T.ArrayType(T.DoubleType())))


class Model:
    """Scaling, random features, ridge weights and calibration."""

    def __init__(self, mean, deviation, features: int, width: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = np.asarray(mean), np.maximum(np.asarray(deviation), 1e-9)
        self.turn = rng.normal(size=(len(self.mean), features)) / (width * math.sqrt(len(self.mean)))
        self.shift = rng.uniform(0, 2 * math.pi, features)
        self.weights = np.zeros(features + 1)
        self.steps: tuple[np.ndarray, np.ndarray] | None = None
        self.constant: float | None = None

    def mapped(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.deviation, -8, 8)
        waves = np.cos(scaled @ self.turn + self.shift) * math.sqrt(2 / len(self.shift))
        return np.concatenate([waves, np.ones((len(stats), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.mapped(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        return np.clip(np.interp(self.raw(stats), *self.steps), 0, 1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to ``values`` (weighted least squares), by pooling neighbours that fall."""
    level, mass, length = [], [], []
    for v, w in zip(values, weights):
        level.append(v), mass.append(w), length.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            total = mass[-2] + mass[-1]
            level[-2:] = [(level[-2] * mass[-2] + level[-1] * mass[-1]) / total]
            mass[-2:], length[-2:] = [total], [length[-2] + length[-1]]
    return np.repeat(level, length)


def _stacked(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATISTICS))


def fitted(labelled: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, bins: int = BINS) -> Model:
    """Model from ``labelled (stats, label 0/1, calibrates boolean)``; the driver sees sums of fixed size only."""
    each = [F.avg(F.get("stats", F.lit(i))) for i in range(len(STATISTICS))] + [F.stddev_pop(F.get("stats", F.lit(i))) for i in range(len(STATISTICS))]
    sums = labelled.agg(F.avg("label"), *each).first()
    moments = [0.0 if x is None else float(x) for x in sums[1:]]
    model = Model(moments[: len(STATISTICS)], moments[len(STATISTICS) :], features, width)
    if sums[0] in (None, 0.0, 1.0):
        model.constant = 0.5 if sums[0] is None else float(sums[0])
        return model
    size = features + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = model.mapped(_stacked(batch, "stats"))
            left += z.T @ z
            right += z.T @ batch.column(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([left.ravel().tolist()]), pa.array([right.tolist()])], names=["a", "b"])

    parts = labelled.filter("NOT calibrates").select("stats", F.col("label").cast("double")).repartition(SUMMED_PARTS)
    solved = parts.mapInArrow(equations, "a array<double>, b array<double>").collect()
    left, right = sum(np.array(r.a).reshape(size, size) for r in solved), sum(np.array(r.b) for r in solved)
    model.weights = np.linalg.solve(left + ridge * np.eye(size), right)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.clip((model.raw(_stacked(batch, "stats")) + 0.5) / 2 * bins, 0, bins - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column(1)], names=["bin", "label"])

    held = labelled.filter("calibrates").select("stats", F.col("label").cast("double"))
    counts = held.mapInArrow(binned, "bin bigint, label double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    found = counts.orderBy("bin").collect()  # at most ``bins`` rows
    if found:
        n = np.array([r.n for r in found], dtype=float)
        level = isotonic(np.array([r.y for r in found]) / n, n)
        model.steps = (np.array([(r.bin + 0.5) / bins * 2 - 0.5 for r in found]), level)
    else:
        model.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def scored(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD
) -> DataFrame:
    """Learn from labelled rows outside the held-out fold and score all: ``doc_id, held_out, score, predicted``."""
    stats = checkpointed(with_statistics(docs.select(doc_id, text), text))  # the only pass over the texts
    known = labels.select(F.col(doc_id), F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull())
    known = sampled(known.filter(fold(F.col(doc_id), 5) != 0), doc_id, fit_rows)
    calibrates = (F.pmod(F.xxhash64(F.col(doc_id), F.lit(3)), F.lit(5)) == 0).alias("calibrates")
    model = fitted(checkpointed(stats.join(known, doc_id).select("stats", "label", calibrates)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_stacked(batch, "stats")))], names=[doc_id, "score"])

    out = stats.select(doc_id, "stats").mapInArrow(work, docs.select(doc_id).schema.add("score", "double"))
    return out.select(doc_id, (fold(F.col(doc_id), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
