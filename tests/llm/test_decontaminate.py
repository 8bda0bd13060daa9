"""Item windows in documents against a brute-force search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from custodia.llm import decontaminate

DOCS = "doc_id long, text string, row string, items string"
ITEMS = "item_id string, text string, doc_id long"


def brute(docs, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = []
    for doc_id, text, *_ in docs:
        w, hit, named = words(text), set(), set()
        for item, item_text, *_ in items:
            own = words(item_text)
            size = min(window, len(own))
            if not own or item is None:
                continue
            for s in range(len(own) - size + 1):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == own[s : s + size]:
                        hit.update(range(p, p + size))
                        named.add(item)
        out.append((doc_id, len(w), len(hit), sorted(named), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    found = decontaminate.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    return sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(25)] + ["É", "ñu"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(f"i{i}", text(rng.choice([0, 1, 2, 4, 7, 10, 14, 30])), i) for i in range(14)]
    items += [("i3", items[5][1], 0), ("copy", items[9][1], 0), (None, "w1", 0), ("none", None, 1), ("i0", items[0][1], 0)]
    docs = []
    for i in range(40):
        body = text(rng.choice([0, 3, 30, 200]))
        for _ in range(rng.randrange(3)):
            own = rng.choice(items)[1] or ""
            body += "; " + own.upper() + "\n" + text(3)
        docs.append((i, body, "x", "y"))
    docs += [(None, items[5][1], None, None), (None, None, None, None), (7, docs[7][1], "z", None), (50, " . , ", None, "")]
    docs.append((51, (text(50) + " " + (items[8][1] or "w1") + " ") * 60, None, None))
    assert run(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("empty", ["docs", "items"])
def test_empty_tables(spark, empty):
    docs = [] if empty == "docs" else [(1, "a b", None, None), (2, None, None, None)]
    items = [] if empty == "items" else [("i", "a b", 0)]
    assert run(spark, docs, items) == brute(docs, items)


def test_no_python_and_no_cross_join(spark):
    docs, items = spark.createDataFrame([(1, "a b c", "", "")], DOCS), spark.createDataFrame([("i", "b c", 1)], ITEMS)
    rows, found, _ = decontaminate.leaks(docs, items)
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Cartesian", plan)
    assert rows.count() == 1 and found.filter(F.col("start") == 2).count() == 1
