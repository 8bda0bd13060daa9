"""Filter interaction audit: what each of several filters removes in every order they can be applied in.

A table-driven byte transducer measures each text in one pass over its bytes: words, code points, capitals and symbols are marked
by the state and the class of a byte, and word spans go into a hash table that compares bytes, which tells how many words are
distinct (``spans.py``). The filters are conditions on these numbers and on whether an earlier document has the same text.

A document's failures are a set of filters. Per part and set, documents are counted (partial sums first), which leaves at most
``2^filters`` rows a part. From these counts follows, for every subset of the filters, how many documents pass all of it; what a
step keeps or removes is a difference of two such numbers, so no document is looked at once for each order.

Defined results. A null text is empty; an empty text has no words and fails only conditions that say so. Texts are equal by a
128-bit hash and by length. A document with a null id never repeats another and is never repeated; rows with one id and text
don't repeat each other. A null source is the part ``''``. A label of a document is set if any of its rows in ``labels`` sets it;
labels of unknown ids are ignored, null labels are not set. Repeated rows count as often as they stand. Extra columns are ignored.
No documents give no rows. A very long text is measured in one task, in about fifteen times its bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.llm.spans import BETWEEN, INSIDE, Words, pieces, per_text, steps
from custodia.session import checkpointed

# Classes of bytes and what they mark.
SPACE, CAPITAL, SYMBOL, PLAIN, INNER = range(5)
WORD_BEGINS, IS_POINT, IS_CAPITAL, IS_SYMBOL = 1, 2, 4, 8
#: Fixed values of the contract.
SYMBOLS = b"#$%&*|"
SPACES = b" \t\n\x0b\x0c\r"

MEASURES = ["n_words", "n_distinct", "n_chars", "n_capitals", "n_symbols"]

#: Fixed values of the contract: when a document fails each filter.
FILTERS = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_capitals > 5 * n_chars",
    "D": "n_symbols > 0",
    "E": "repeated",
}


def machine() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of bytes, the state after each class, and the marks of each class by the state before it."""
    classes = np.full(256, PLAIN, dtype=np.uint8)
    classes[list(SPACES)] = SPACE
    classes[ord("A") : ord("Z") + 1] = CAPITAL
    classes[list(SYMBOLS)] = SYMBOL
    classes[0x80:0xC0] = INNER  # bytes of a code point behind its first
    moves = np.array([BETWEEN, INSIDE, INSIDE, INSIDE, INSIDE], dtype=np.uint8)
    inside = [IS_POINT, IS_POINT | IS_CAPITAL, IS_POINT | IS_SYMBOL, IS_POINT, 0]
    begins = [inside[SPACE], *[mark | WORD_BEGINS for mark in inside[1:]]]
    return classes, moves, np.array([begins, inside], dtype=np.uint8)


def measures(texts: pa.Array) -> np.ndarray:
    """The columns ``MEASURES`` of some texts."""
    out = np.zeros((len(MEASURES), len(texts)), dtype=np.int64)
    tables = machine()
    for first, rows, data, bounds in pieces(texts):
        marks, after = steps(data, bounds, *tables)
        words = Words(data, bounds, marks & WORD_BEGINS != 0, after)
        here = slice(first, first + rows)
        out[0, here] = np.bincount(words.owner, minlength=rows)
        out[1, here] = np.bincount(words.owner[words.new_in_text()], minlength=rows)
        for place, flag in enumerate((IS_POINT, IS_CAPITAL, IS_SYMBOL), start=2):
            out[place, here] = per_text(marks & flag != 0, bounds)
    return out


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, part``, the ``MEASURES`` and the text's hashes ``d1, d2`` of every document."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    read = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("part"),
        F.xxhash64(whole).alias("d1"),
        F.xxhash64(F.length(whole), whole).alias("d2"),
        whole.alias("text"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measures(batch.column(4))
            columns = [*[batch.column(i) for i in range(4)], *[pa.array(found[k]) for k in range(len(MEASURES))]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "d1", "d2", *MEASURES])

    kind = docs.schema[doc_id].dataType.simpleString()
    return read.mapInArrow(work, f"doc_id {kind}, part string, d1 bigint, d2 bigint, " + ", ".join(f"{m} bigint" for m in MEASURES))


def failure_sets(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How many documents of each part fail exactly the filters of ``failed`` (bit ``i``: the i-th filter):
    ``part, failed, n, good, toxic``."""
    facts = checkpointed(measured(docs, doc_id, text, source))
    # The first document of each text comes from partial minima and is looked up by its own id, so that no task gets all copies.
    firsts = facts.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = facts.join(marks, "doc_id", "left").join(firsts, ["doc_id", "d1", "d2"], "left")
    repeated = F.col("first").isNull() & F.col("doc_id").isNotNull()
    failed = sum((F.when(F.expr(condition), 1 << i).otherwise(0) for i, condition in enumerate(filters.values())), F.lit(0))
    rows = known.withColumn("repeated", repeated).select("part", failed.alias("failed"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return rows.groupBy("part", "failed").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def audit(sets: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from the counts of ``failure_sets``.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``. A part may have very
    many documents, but only ``2^filters`` rows come here for it.
    """
    names, full = list(filters), 1 << len(filters)
    passing = lambda what: F.array(*[F.sum(F.when(F.col("failed").bitwiseAND(F.lit(s)) == 0, F.col(what)).otherwise(0)) for s in range(full)])
    only = F.array(*[F.sum(F.when(F.col("failed") == 1 << i, F.col("n")).otherwise(0)) for i in range(len(names))])
    parts = sets.groupBy("part").agg(passing("n").alias("n"), passing("good").alias("good"), passing("toxic").alias("toxic"), only.alias("only"))

    def shapley(i: int) -> Column:
        """Documents that filter ``i`` removes, summed over all orders: those in which it comes right behind the set ``s``."""
        others = [s for s in range(full) if not s >> i & 1]
        orders = lambda s: factorial(s.bit_count()) * factorial(len(names) - 1 - s.bit_count())
        return sum((F.lit(orders(s)) * (F.get("n", F.lit(s)) - F.get("n", F.lit(s | 1 << i))) for s in others), F.lit(0).cast("bigint"))

    parts = parts.withColumn("shapley", F.array(*[shapley(i) for i in range(len(names))]))
    rows = []
    for order in permutations(range(len(names))):
        before = 0
        for step, i in enumerate(order, start=1):
            rows.append({"filter_order": "".join(names[k] for k in order), "step": step, "i": i, "before": before, "after": before | 1 << i})
            before |= 1 << i
    plan = F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, i: int, before: int, after: int>>")
    each = parts.withColumn("at", F.explode(plan)).select("*", "at.*")
    lost = lambda what: F.get(what, F.col("before")) - F.get(what, F.col("after"))
    failing = F.get("n", F.lit(0)) - F.get("n", F.call_function("shiftleft", F.lit(1), F.col("i")))
    return each.select(
        "part",
        "filter_order",
        "step",
        F.get("n", F.col("after")).alias("kept"),
        lost("n").alias("removed"),
        (failing - lost("n")).alias("redundant"),
        F.get("only", F.col("i")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shapley", F.col("i")).alias("shapley"),
    )
