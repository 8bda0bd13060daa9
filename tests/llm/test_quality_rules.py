"""Base counts and log ratios against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from custodia.llm import quality_rules

SCHEMA = "doc_id long, text string, h string, kept string"


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def word_hash(word):
    return signed(xxhash.xxh64_intdigest(word.encode(), seed=42))


def pair_hash(a, b):
    first = xxhash.xxh64_intdigest((a & (1 << 64) - 1).to_bytes(8, "little"), seed=42)
    return signed(xxhash.xxh64_intdigest((b & (1 << 64) - 1).to_bytes(8, "little"), seed=first))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def grams(text, buckets):
    h = [word_hash(w) for w in words_of(text)]
    return [x % buckets for x in h] + [pair_hash(a, b) % buckets for a, b in zip(h, h[1:])]


def brute(docs, trusted, buckets, threshold):
    raw, target = Counter(), Counter()
    for doc_id, text, *_ in docs:
        own = Counter(grams(text, buckets))
        raw += own
        if doc_id in trusted:
            target += own
    n_raw, n_target = sum(raw.values()), sum(target.values())
    share = lambda c, b, n: math.log((c[b] + 1) / (n + buckets))
    ratio = [round((share(target, b, n_target) - share(raw, b, n_raw)) * 1e6) if n_target else 0 for b in range(buckets)]
    out = []
    for doc_id, text, *_ in docs:
        t, w = text or "", words_of(text)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words_of(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        g = grams(text, buckets)
        mean = sum(ratio[b] for b in g) / max(len(g), 1) / 1e6
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        symbols = sum(c in "#*$%&|<>" for c in t)
        out.append((doc_id, len(w), sum(map(len, w)), symbols, dup, len(hit), failed, not failed and mean >= threshold))
    return sorted(out, key=repr)


def run(spark, docs, trusted, buckets, threshold):
    df = spark.createDataFrame(docs, SCHEMA)
    ids = spark.createDataFrame([(t,) for t in trusted], "doc_id long")
    model = quality_rules.ratios(df, ids, "doc_id", "text", buckets)
    got = quality_rules.judged(df, model, buckets=buckets, threshold=threshold)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return sorted((tuple(r) for r in got.select(*names).collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["##", "a|b", "é x", "𝔘"]
    docs = []
    for i in range(60):
        body = "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "\t", " \n\x0b"]) for _ in range(rng.choice([0, 4, 12, 60, 300])))
        docs.append((i, body + (body if i % 7 == 0 else ""), "x", "y"))
    docs += [(1, None, None, None), (None, "a b c d e f a b c d e f", None, None), (None, None, None, None), (70, "x " * 500, "", ""), (71, "\n\n \n", None, None)]
    trusted = [2, 3, 9, 9, None, 12, 71]
    assert run(spark, docs, trusted, 64, -0.01) == brute(docs, {2, 3, 9, 12, 71}, 64, -0.01)


@pytest.mark.parametrize("docs, trusted", [([], [1]), ([(1, "a b c d e f g h i j k", "", "")], []), ([], [])])
def test_empty_tables(spark, docs, trusted):
    assert run(spark, docs, trusted, 16, 0.0) == brute(docs, set(trusted), 16, 0.0)


def test_no_python(spark):
    df = spark.createDataFrame([(1, "a b", "", "")], SCHEMA)
    model = quality_rules.ratios(df, df.select("doc_id"), "doc_id", "text", 16)
    assert not re.search("Python|Arrow|Cartesian", quality_rules.judged(df, model, buckets=16)._jdf.queryExecution().toString())


def test_every_trusted_document_counts(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    model = quality_rules.ratios(docs, docs.select("doc_id"), "doc_id", "text", 16)
    assert tuple(model.agg(F.sum("raw"), F.sum("target")).first()) == (60_000, 60_000)
