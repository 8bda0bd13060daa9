"""The best documents of each item against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from custodia.llm import ranked_search

DOCS = "doc_id long, text string, item_id string, rank string"
ITEMS = "item_id long, text string, doc_id long, score string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=50):
    counted = [(d[0], Counter(terms(d[1]))) for d in docs]
    n = sum(1 for _, c in counted if c)
    total = sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for item, text, *_ in items:
        if item is not None:
            wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        scores = []
        for doc, c in counted:
            if c:
                m = 100 - 50 + (50 * c.total() * n) // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
                if s > 0:
                    scores.append((-s, doc is None, doc or 0))
        for rank, (s, none, doc) in enumerate(sorted(scores)[:k], start=1):
            out.append((item, rank, None if none else doc, -s))
    return sorted(out, key=repr)


def run(spark, docs, items, k=50, **index):
    blocks = ranked_search.index(spark.createDataFrame(docs, DOCS), **index)
    found = ranked_search.search(blocks, spark.createDataFrame(items, ITEMS), k)
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Éa", "ñu", "x9", "x" * 70, "x" * 69 + "y"]
    pick = lambda: words[min(int(rng.expovariate(0.02)), len(words) - 1)]
    text = lambda size: rng.choice([" ", "_", ", "]).join(pick() for _ in range(size))
    docs = [(i, text(rng.choice([1, 5, 30, 120])).upper() if i % 7 == 0 else text(rng.choice([0, 5, 40])), "a", "b") for i in range(n)]
    items = [(i, text(rng.choice([1, 4, 20, 60])), 0, None) for i in range(12)]
    return docs, items, text


@pytest.mark.parametrize("split", [1, 3, 512])
def test_against_all_scores(spark, monkeypatch, split):
    monkeypatch.setattr(ranked_search, "SPLIT_AT_ONCE", split)
    docs, items, text = corpus(split, 260)
    docs += [(500 + i, docs[14][1], None, None) for i in range(60)] + [(14, docs[14][1], "", ""), (None, docs[7][1], None, None), (None, None, None, None), (900, " .,; ", "", "")]
    docs += [(901, text(30_000), None, None)]
    items += [(20, None, 0, ""), (21, " ?! ", 0, ""), (None, docs[0][1], 0, ""), (3, docs[14][1], 0, ""), (22, "nowhere", 1, ""), (23, docs[14][1], 1, "")]
    random.Random(1).shuffle(docs)
    assert run(spark, docs, items, block_bytes=4000) == brute(docs, items)
    assert run(spark, docs, items, k=3) == brute(docs, items, 3)


def test_groups_of_queries(spark, monkeypatch):
    docs, items, _ = corpus(8, 90)
    monkeypatch.setattr(ranked_search, "GROUP_TERMS", 40)
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items, _ = corpus(3, 5)
    assert run(spark, [], items) == run(spark, docs, []) == run(spark, [(1, None, "", ""), (2, "", "", "")], items) == []


def test_maxima_of_all_ranges():
    rng = np.random.default_rng(4)
    size = np.array([1, 7, 2, 16, 5])
    start = np.cumsum(size) - size
    impact = rng.integers(1, 9, size.sum())
    maxima = ranked_search.Maxima(impact.astype(np.int64), start, size)
    for k in range(len(size)):
        for low in range(size[k] + 1):
            for high in range(low, size[k] + 1):
                own = impact[start[k] + low : start[k] + high]
                value, place = maxima.of(np.array([k]), np.array([low]), np.array([high]))
                assert value[0] == own.max(initial=0)
                assert not len(own) or place[0] == low + own.argmax()


def test_few_documents_are_scored():
    """Bounds end a search long before all documents that hold a term are scored."""
    rng = np.random.default_rng(6)
    texts = ["common " * int(rng.integers(1, 4)) + ("rare " * 3 if i % 400 == 0 else "") + "other " * int(rng.integers(0, 30)) for i in range(4000)]
    made = ranked_search.block_of(np.arange(4000), pa.array(texts))
    row = {name: made.column(i)[0].values.to_numpy() for i, name in enumerate(made.schema.names)}
    wanted = np.unique(np.concatenate([t for _, t in ranked_search.terms_of(pa.array(["common rare"]))]))
    block = ranked_search.Block(row, wanted, 4000, int(row["lengths"].sum()))
    asked, of = [], block.maxima.of
    block.maxima.of = lambda *a: asked.append(len(a[1])) or of(*a)
    none = np.zeros(0, dtype=np.int64)
    score, _ = block.best(np.arange(2), np.array([1000, 4000]), 5, none, none)
    assert len(score) == 5 and sum(asked) < 1500
