"""Rankings against plain Python, and accuracy on the held-out fold."""

import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from custodia.llm import language

SCHEMA = "doc_id long, text string, lang string, score string, lang_pred string"


def plain_grams(text):
    flat = " " + re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in text.lower()))
    flat = " " + flat.lstrip(" ") if flat.strip() else " "
    out = Counter(c for c in flat if c != " ")
    out.update(flat[i : i + 2] for i in range(len(flat) - 1))
    out.update(flat[i : i + 3] for i in range(len(flat) - 2) if flat[i + 1] != " ")
    return out


def spelled(keys, counts):
    out = Counter()
    for k, n in zip(keys.tolist(), counts.tolist()):
        codes = [k >> 42, (k >> 21) & 0x1FFFFF, k & 0x1FFFFF]
        out["".join(" " if c == 1 else chr(c - 1) for c in codes if c)] = n
    return out


@pytest.mark.parametrize("piece", [1 << 18, 3, 1])
def test_grams(piece, monkeypatch):
    monkeypatch.setattr(language, "PIECE", piece)
    rng = random.Random(1)
    for _ in range(80):
        text = "".join(rng.choice("abÉñß .,1\n𝔘中") for _ in range(rng.randrange(30)))
        assert spelled(*language.grams(text)) == plain_grams(text), repr(text)


def brute(learned, text, ranks):
    own = plain_grams(text or "")
    if not any(len(g) == 1 for g in own) or not learned:
        return "und"
    code = lambda g: sum((ord(c) + 1 if c != " " else 1) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    best = sorted(own, key=lambda g: (-own[g], code(g)))[:ranks]
    far = {
        name: sum(abs(p.index(code(g)) - i) if code(g) in p else ranks for i, g in enumerate(best)) for name, p in learned.items()
    }
    return min(sorted(far), key=far.get)


def test_predictions_against_brute_force(spark):
    rng = random.Random(7)
    letters = {"aa": "abcde", "bb": "efghi", "cc": "ijklö"}
    docs = []
    for i in range(90):
        name = rng.choice(list(letters))
        words = [" ".join("".join(rng.choice(letters[name]) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 40)))]
        docs.append((i, words[0], name if i % 9 else None, "x", "y"))
    docs += [(None, None, "aa", "", ""), (900, "12 .", "bb", "", ""), (901, "", None, None, None), (3, docs[3][1], "aa", "", "")]
    df = spark.createDataFrame(docs, SCHEMA)
    train = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 4 != 2 and d[2]]
    learned = language.profiles(spark.createDataFrame(train, SCHEMA), "text", "lang", 40)
    for name, grams in learned.items():
        total = Counter()
        for d in train:
            if d[2] == name and d[1]:
                total.update(plain_grams(d[1]))
        assert sorted(total.values(), reverse=True)[: len(grams)] == [total[g] for g in [next(iter(spelled_one(k))) for k in grams]]
    got = language.languages(df, learned, ranks=40).select("doc_id", "text" if False else "lang_pred").collect()
    want = sorted(((d[0], brute(learned, d[1], 40)) for d in docs), key=repr)
    assert sorted(((r.doc_id, r.lang_pred) for r in got), key=repr) == want


def spelled_one(key):
    codes = [key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF]
    return ["".join(" " if c == 1 else chr(c - 1) for c in codes if c)]


def test_empty_tables(spark):
    assert language.identified(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = language.identified(spark.createDataFrame([(1, "abc", None, "", "")], SCHEMA)).first()
    assert alone.lang_pred == "und" and alone.score == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not there")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
