"""Counts of every order of the filters against filters applied one after the other."""

import random
import re
from itertools import permutations

import pyarrow as pa
import pytest

from custodia.llm import filter_audit
from custodia.llm.spans import pieces

DOCS = "doc_id long, text string, source string, part string, n_words int, good boolean"
LABELS = "doc_id long, quality int, toxic int, source string"


def brute(docs, labels):
    least = {}
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    rows = []
    for doc_id, text, source, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and doc_id > least[text],
        }
        good, toxic = (any(r[k] == 1 for r in labels if r[0] == doc_id and doc_id is not None) for k in (1, 2))
        rows.append((source or "", fails, good, toxic))
    out, shapley = [], {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, start=1):
                gone = [r for r in left if r[1][name]]
                left = [r for r in left if not r[1][name]]
                failing = sum(r[1][name] for r in own)
                only = sum(r[1][name] and sum(r[1].values()) == 1 for r in own)
                shapley[part, name] = shapley.get((part, name), 0) + len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), failing - len(gone), only, sum(r[2] for r in gone), sum(r[3] for r in gone), name])
    return sorted((tuple(r[:-1]) + (shapley[r[0], r[-1]],) for r in out), key=repr)


def run(spark, docs, labels):
    found = filter_audit.audit(filter_audit.failure_sets(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_against_filters_in_turn(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(90)] + ["Ünter", "日本語", "ABC", "#tag", "a|b", "x" * 80, "é"]
    docs = []
    for i in range(150):
        pool = rng.sample(words, rng.choice([5, 40, 97]))
        docs.append((i, rng.choice([" ", "\n", "\t  "]).join(rng.choice(pool) for _ in range(rng.choice([0, 3, 49, 50, 70, 200]))), rng.choice("xyz"), "p", 1, None))
    docs += [(200 + i, docs[9][1], "x", "p", 1, None) for i in range(30)] + [(4, docs[9][1], "y", None, None, None), (4, docs[9][1], "y", None, None, None)]
    docs += [(300, None, None, None, None, None), (301, "", "", None, None, None), (None, docs[9][1], "z", None, None, None), (None, None, None, None, None, None), (302, " \t ", "z", None, None, None)]
    docs += [(303, " ".join(f"Very{i % 900} long" for i in range(40_000)), "x", None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "q") for i in range(0, 250, 2)] + [(6, 1, 0, ""), (6, 0, 1, ""), (None, 1, 1, ""), (9999, 1, 1, "")]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "a", None, None, None, None)], []) == brute([(1, "a", None)], [])


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_measures_do_not_depend_on_pieces(monkeypatch, most):
    rng = random.Random(most)
    texts = ["".join(rng.choice(" \n\x0baA#é日𝄞x") for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(200)] + [None, ""]
    monkeypatch.setattr(filter_audit, "pieces", lambda column: pieces(column, most))
    found = filter_audit.measures(pa.array(texts))
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert found[:, i].tolist() == [len(words), len(set(words)), len(text or ""), len(re.findall("[A-Z]", text or "")), (text or "").count("#")]


def test_equal_hashes_are_told_apart(monkeypatch):
    """With one hash for all words the table still compares their bytes."""
    from custodia.llm import spans

    monkeypatch.setattr(spans.Words, "hashes", lambda self: self.size.astype("uint64") * 0)
    text = " ".join(["ab", "ba", "ab", "x" * 70, "x" * 69 + "y", "x" * 70, "b"])
    assert filter_audit.measures(pa.array([text, "ab ba"]))[1].tolist() == [5, 2]
