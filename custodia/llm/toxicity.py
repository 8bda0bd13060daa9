"""Toxicity of noisily spelled text: restore words through a noisy channel, then score what was restored.

A character language model (trigrams with back-off) is counted over all documents. Words with digits or signs among
their letters, with a letter three times or more in a row, or spelled in single characters become lattices: each run of
equal characters offers the letters it may stand for, one or two copies of a repeated letter, or nothing; each gap
between single characters offers a word boundary or nothing. The Viterbi path under language model and channel costs is the
restored text. Words (plain or restored) are scored by their whole form and their first three to eight letters, with
log odds learned from labelled documents; a logistic curve over a document's evidence gives its score.

Defined results. Null and empty texts have no evidence and the score that follows from that. Rows with a null id or label
aren't learned from. Without toxic or without other labels every score is the share of toxic labels (0 without any).
Repeated rows are scored one by one; extra columns are ignored; empty tables give no rows. Ties of paths fall to the
option listed first.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import fold
from custodia.llm.language import sampled
from custodia.session import checkpointed

#: About so many labelled rows are learned from; beyond, those with the smallest hashes of their ids.
FIT_ROWS = 30_000
THRESHOLD = 0.5
#: Documents that have to show a word or beginning, and its least log odds, for it to be evidence.
LEAST_DOCS = 4
LEAST_ODDS = 2.0
MAX_FEATURES = 50_000
PIECE = 1 << 20

# Letters of the model's alphabet, and what other characters may stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøœùúûüýß"
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
ANY_LETTER = "*"
EDGES = ".,;:!?\"'()[]{}<>«»…-–—_/\\=~^`#%&"
JOINTS = re.compile(r"[.\-_/:;=,\"'()\[\]~&?%#]+")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
SPELLED = re.compile("1{4,}")
SAME_RUN = re.compile(r"(.)\1*", re.S)
EDGE_RUNS = re.compile(r"^(?:([^\w\s])\1+)+|(?:([^\w\s])\2+)+$")

# Channel costs (log probabilities) of a run of characters.
LITERAL, LEET, WILD, DROPPED, ONE_OF_MANY, TWO_OF_MANY, ALL_OF_MANY, JOINED, APART = -0.05, -1.0, -4.0, -9.0, -0.7, -1.5, -3.0, -0.1, -4.0

BOUNDARY, OTHER, SYMBOLS = 0, 63, 64
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
_TABLE: list[np.ndarray] = []


def symbol_table() -> np.ndarray:
    """Symbol of each code point below 0x20000: a letter's number, OTHER for other letters, else the boundary."""
    if not _TABLE:
        table = np.array([OTHER if chr(i).isalpha() else BOUNDARY for i in range(0x20000)], dtype=np.int64)
        for c, i in CODE.items():
            table[ord(c)] = i
        _TABLE.append(table)
    return _TABLE[0]


def one_by_one(column: pa.Array) -> Iterator[str | None]:
    """The texts of a batch, of which Python holds one at a time."""
    return (value.as_py() for value in column)


def trigram_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Counts of all symbol trigrams of all texts; at most 64^3 sums leave the cluster."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for body in one_by_one(batch.column(0)):
                last = np.array([BOUNDARY, BOUNDARY])
                for start in range(0, len(body or ""), PIECE):
                    codes = np.frombuffer(body[start : start + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                    own = np.concatenate([last, symbol_table()[np.minimum(codes, 0x1FFFF)]])
                    last = own[-2:]
                    at = own[:-2] * SYMBOLS**2 + own[1:-1] * SYMBOLS + own[2:]
                    if len(at) < 20_000:  # short texts: add up the distinct ones
                        np.add.at(total, at, 1)
                    else:
                        total += np.bincount(at, minlength=SYMBOLS**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["at", "n"])

    rows = docs.select(F.col(text).alias("text")).filter(F.col("text").isNotNull())
    sums = rows.mapInArrow(work, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS**3)
    for r in sums:
        out[r.at] = r.n
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def language_model(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """Log probability of a symbol after two others; each order backs off to the one below."""
    counts = counts.copy()
    counts[:, BOUNDARY, BOUNDARY] = 0
    one = counts.sum(axis=(0, 1)) + 1
    one = one / one.sum()
    two = counts.sum(axis=0)
    two = (two + weight * one) / (two.sum(axis=1, keepdims=True) + weight)
    three = (counts + weight * two) / (counts.sum(axis=2, keepdims=True) + weight)
    return np.log(three)


def lattice(spelled: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters, what it may stand for and at what cost; a space is an open gap."""
    out = []
    for run in SAME_RUN.finditer(spelled):
        char, n = run.group(1), len(run.group())
        if char == " ":
            out.append([("", JOINED), (" ", APART)])
            continue
        if char.isalpha():
            options = [(char, LITERAL if n == 1 else ONE_OF_MANY)]
            if n > 1:
                options.append((char * 2, LITERAL if n == 2 else TWO_OF_MANY))
            if n > 2:
                options.append((char * n, ALL_OF_MANY))
        elif char in STANDS_FOR:
            options = [(c, LEET) for c in STANDS_FOR[char]]
            options += [(c * 2, LEET + LEET) for c in STANDS_FOR[char] if n > 1]
            options.append(("", DROPPED))
        elif char == ANY_LETTER and n == 1:
            options = [(c, WILD) for c in LETTERS[:26]] + [("", DROPPED)]
        else:
            options = [("", DROPPED)]
        out.append(options)
    return out


def viterbi(options: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The best path through a lattice; a state is the last two symbols."""
    states: dict[tuple[int, int], tuple[float, tuple]] = {(BOUNDARY, BOUNDARY): (0.0, ())}
    for choices in options:
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (points, path) in states.items():
            for emitted, cost in choices:
                p, x, y = points + cost, a, b
                for c in emitted:
                    s = BOUNDARY if c == " " else CODE.get(c, OTHER)
                    p, x, y = p + model[x, y, s], y, s
                if (x, y) not in new or p > new[x, y][0]:
                    new[x, y] = (p, (path, emitted) if emitted else path)
        states = new
    ends = [(p + model[a, b, BOUNDARY], path) for (a, b), (p, path) in states.items()]
    path = max(ends, key=lambda e: e[0])[1]
    parts = []
    while path:
        path, last = path
        parts.append(last)
    return "".join(reversed(parts))


class Restorer:
    """Words of a text, with noisy ones restored; results for words seen before are kept, at most ``kept`` of them."""

    def __init__(self, model: np.ndarray, kept: int = 100_000):
        self.model, self.kept, self.seen = model, kept, {}

    def restored(self, spelled: str) -> list[str]:
        found = self.seen.get(spelled)
        if found is None:
            found = viterbi(lattice(spelled), self.model).split()
            if len(self.seen) >= self.kept:
                self.seen.clear()
            self.seen[spelled] = found
        return found

    def noisy(self, token: str) -> list[str]:
        """Words behind a token that isn't a plain word."""
        core = EDGE_RUNS.sub("", token)
        if not any(c.isalpha() for c in core):
            return []
        parts = [p for p in JOINTS.split(core) if p]
        if len(parts) > 3 and all(len(p) == 1 for p in parts):
            return self.restored(" ".join(parts))
        out = self.restored(" ".join(parts)) if 1 < len(parts) < 5 else []  # one word may stand behind them
        for part in parts:
            part = part.rstrip("!|") or part
            if part.isalpha() and not TRIPLE.search(part):
                out = [*out, part]
            elif any(c.isalpha() for c in part):
                out = [*out, *self.restored(part)]
        return out

    def words(self, text: str | None) -> tuple[set[str], int]:
        """Distinct words of the restored text, and the number of its tokens."""
        tokens = (text or "").lower().split()
        plain, triple = set(), TRIPLE.search((text or "").lower())
        for token in set(tokens):
            core = token.strip(EDGES)
            if core.isalpha() and not (triple and TRIPLE.search(core)):
                plain.add(core)
            elif core:
                plain.update(self.noisy(token.strip(".,;:?\"'")))
        flags = "".join(["1" if len(t) == 1 or len(t.strip(EDGES)) == 1 else "0" for t in tokens])
        for run in SPELLED.finditer(flags):
            own = [t.strip(EDGES) or t for t in tokens[run.start() : run.end()]]
            plain.update(self.restored(" ".join(own)))
        return plain, len(tokens)


def features(word: str) -> list[str]:
    """The whole word and its first three to eight letters."""
    return [f"={word}", *[word[:n] for n in range(3, min(8, len(word)) + 1)]]


def evidence(words: set[str], weights: dict[str, float], starts: set[str]) -> list[float]:
    """Log odds of the words that have any, the largest first."""
    found = []
    for w in words:
        if w[:3] in starts:
            best = max((weights.get(f, 0.0) for f in features(w)), default=0.0)
            if best > 0:
                found.append(best)
    return sorted(found, reverse=True)


def summary(found: list[float], n_tokens: int) -> list[float]:
    """What the logistic curve sees."""
    return [1.0, found[0] if found else 0.0, found[1] if len(found) > 1 else 0.0, math.log1p(sum(found)), math.log1p(n_tokens) * bool(found)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge-penalised logistic curve, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Scorer:
    def __init__(self, model: np.ndarray, weights: dict[str, float], curve: np.ndarray | None, constant: float | None):
        self.model, self.weights, self.curve, self.constant = model, weights, curve, constant
        self.starts = {f.lstrip("=")[:3] for f in weights}

    def summaries(self, texts: Iterable[str | None]) -> list[list[float]]:
        restorer = Restorer(self.model) if not hasattr(self, "restorer") else self.restorer
        self.restorer = restorer
        out = []
        for text in texts:
            words, n = restorer.words(text)
            out.append(summary(evidence(words, self.weights, self.starts), n))
        return out

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.array([self.constant for _ in texts])
        return 1 / (1 + np.exp(-np.clip(np.array(self.summaries(texts)).reshape(-1, 5) @ self.curve, -30, 30)))


def learned(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, fit_rows: int) -> Scorer:
    """Language model over all documents; evidence and curve from labelled rows outside the held-out fold."""
    model = language_model(trigram_counts(docs, text))
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (fold(F.col("id"), 5) != 0))
    known = checkpointed(sampled(known, "id", fit_rows).withColumn("second", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(3)) == 0))
    share = known.agg(F.avg("label"), F.count("*")).first()
    if share[0] in (None, 0.0, 1.0):
        return Scorer(model, {}, None, float(share[0] or 0.0))
    # ids are at most about ``fit_rows`` (see sampled); equal texts are learned from once
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")
    rows = checkpointed(rows.select("label", "second", "text").distinct())
    first = rows.filter("NOT second").select("label", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, shown = Restorer(model), {0: Counter(), 1: Counter()}
        for batch in batches:
            for y, body in zip(batch.column(0).to_pylist(), one_by_one(batch.column(1))):
                own = set()
                for w in restorer.words(body)[0]:
                    own.update(features(w))
                shown[int(y > 0)].update(own)
        names = list(shown[0].keys() | shown[1].keys())
        columns = [pa.array(names, pa.string()), *[pa.array([shown[y][f] for f in names], pa.int64()) for y in (0, 1)]]
        yield pa.RecordBatch.from_arrays(columns, names=["feature", "clean", "toxic"])

    size = first.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first()
    sums = first.mapInArrow(counted, "feature string, clean bigint, toxic bigint")
    sums = sums.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.ln((F.col("toxic") + 0.5) / (size[0] + 1)) - F.ln((F.col("clean") + 0.5) / (size[1] + 1))
    best = sums.filter(F.col("toxic") >= LEAST_DOCS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    found = best.orderBy(F.col("odds").desc(), "feature").limit(MAX_FEATURES).collect()
    scorer = Scorer(model, {r.feature: r.odds for r in found}, None, None)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(scorer.summaries(one_by_one(batch.column(1))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["label", "x"])

    seen = rows.filter("second").select("label", "text").mapInArrow(summed, "label int, x array<double>").collect()
    y = np.array([float(r.label > 0) for r in seen])
    if not len(seen) or y.min() == y.max():
        scorer.constant = float(share[0])
        return scorer
    scorer.curve = logistic(np.array([r.x for r in seen]), y)
    return scorer


def scored(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD
) -> DataFrame:
    """All columns of ``docs`` with ``held_out, score, predicted``; columns with these names are replaced.

    Only the text goes to Python, and only the score comes back.
    """
    scorer = learned(docs, labels, label, doc_id, text, fit_rows)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted")]

    def work(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(scorer.scores(one_by_one(column)), pa.float64())

    out = docs.select(*others, F.arrow_udf(work, "double")(F.col(text)).alias("score"))
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return out.select(*others, (fold(F.col(doc_id), 5) == 0).alias("held_out"), "score", predicted)
