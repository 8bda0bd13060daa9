"""Exponent, parts and block sequences against plain Python."""

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from custodia.llm import mixing

SCHEMA = "doc_id long, source string, text string, tokens string, weight string"


def made(rng, sizes):
    docs, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            docs.append((i, source, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 12))), "", ""))
            i += 1
    return docs


def tokens_of(docs):
    out = defaultdict(int)
    for _, source, text, *_ in docs:
        out[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return {s: n for s, n in out.items() if n}


def at(totals, budget, e):
    power = {s: (n / sum(totals.values())) ** e for s, n in totals.items()}
    w = {s: p / sum(power.values()) for s, p in power.items()}
    return w, -sum(p * math.log(p) for p in w.values()), max(budget * w[s] / totals[s] for s in totals)


def brute_exponent(totals, budget, entropy, repeats):
    grid = [i / 4000 for i in range(4001)]
    good = [e for e in grid if at(totals, budget, e)[1] >= entropy * math.log(len(totals)) - 1e-12]
    e = max(good, default=0.0)
    if repeats is not None and at(totals, budget, e)[2] > repeats:
        fine = [x for x in grid if x >= e and at(totals, budget, x)[2] <= repeats]
        e = min(fine, default=1.0)
    return e


@pytest.mark.parametrize("entropy, repeats", [(0.9, None), (0.9, 3.0), (0.99, 2.0), (0.5, 4.0), (1.0, 1.0), (1.0, None)])
def test_exponent(spark, entropy, repeats):
    totals = {"a": 9000, "b": 700, None: 60, "c": 300}
    sources = spark.createDataFrame([(s, n, 5) for s, n in totals.items()], "source string, source_tokens long, source_docs long")
    found = mixing.bisected(sources, 10_060.0, entropy, repeats, steps=16)
    assert found.value == pytest.approx(brute_exponent(totals, 10_060, entropy, repeats), abs=5e-4)
    w, h, r = at(totals, 10_060, found.value)
    assert found.entropy == pytest.approx(h) and found.repeats == pytest.approx(r)
    got = {x.source: x.weight for x in mixing.weights(sources, found.value).collect()}
    assert all(got[s] == pytest.approx(w[s]) for s in totals)


@pytest.mark.parametrize("range_rows", [7, 10_000])
def test_sequence(spark, range_rows):
    docs = made(random.Random(4), {"hot": 300, "b": 40, "c": 25, "tiny": 3})
    docs += [(900, None, "a b c", "", ""), (901, "empty", None, "", ""), (901, "empty", "", "", ""), (None, "b", "x y", None, None), (5, "hot", docs[5][2], "", "")]
    totals, budget, block = tokens_of(docs), sum(tokens_of(docs).values()), 200
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    tokens = mixing.token_table(df)
    exponent = mixing.bisected(mixing.source_table(tokens).filter("source_tokens > 0"), float(budget), 0.9, 3.0, steps=16).value
    w, _, _ = at(totals, budget, exponent)
    got = mixing.realised(tokens, mixing.weights(mixing.source_table(tokens), exponent), budget, block, range_rows).collect()
    assert {r.source for r in got} == set(totals)
    n_blocks = -(-budget // block)
    for source, total in totals.items():
        own = [r for r in got if r.source == source]
        quota = w[source] * budget
        rows = sum(d[1] == source for d in docs)
        epochs = defaultdict(list)
        for r in own:
            epochs[r.epoch].append(r)
        last = max(epochs)
        for e in range(last):  # whole epochs hold every document of the source once
            assert len(epochs[e]) == rows and sum(r.tokens for r in epochs[e]) == total
        longest = max(r.tokens for r in own)
        assert quota - 1e-6 <= sum(r.tokens for r in own) <= quota + longest or sum(r.tokens for r in own) == total * (last + 1)
        for b in range(n_blocks):  # every block holds its part of every source, up to one document at either end
            assert abs(sum(r.tokens for r in own if r.block == b) - quota / n_blocks) <= 2 * longest
    for b in range(n_blocks):
        assert sorted(r.position for r in got if r.block == b) == list(range(sum(r.block == b for r in got)))
    again = mixing.realised(tokens, mixing.weights(mixing.source_table(tokens), exponent), budget, block, range_rows).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@pytest.mark.parametrize("docs", [[], [(1, "a", None, "", "")], [(1, None, "x y", "", "")]])
def test_small_tables(spark, docs):
    got = mixing.mixed(spark.createDataFrame(docs, SCHEMA))
    assert got.count() == sum(bool(d[2]) for d in docs)
    assert got.columns == ["doc_id", "source", "tokens", "weight", "epoch", "block", "position"]


def test_few_sources_are_one_task(spark, monkeypatch):
    parts, bisected = [], mixing.bisected
    monkeypatch.setattr(mixing, "bisected", lambda sources, *a: parts.append(sources.rdd.getNumPartitions()) or bisected(sources, *a))
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for key, value in zip(was, ("9", "false")):
            spark.conf.set(key, value)
        docs = spark.createDataFrame([(i, f"s{i % 5}", "x y", "", "") for i in range(50)], SCHEMA)
        whole = sorted(map(str, mixing.mixed(docs).collect()))
        monkeypatch.setattr(mixing, "SOURCES", 2)
        assert sorted(map(str, mixing.mixed(docs).collect())) == whole
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)
    assert parts == [1, 3]


def test_epochs_are_permuted_differently(spark):
    docs = [(i, "a", "x", "", "") for i in range(60)] + [(100 + i, "b", "x", "", "") for i in range(600)]
    got = mixing.mixed(spark.createDataFrame(docs, SCHEMA), entropy=1.0, repeats=3.0, block_tokens=60)
    rows = got.filter(F.col("source") == "a").orderBy("epoch", "block", "position").collect()
    orders = [[r.doc_id for r in rows if r.epoch == e] for e in range(2)]
    assert orders[0] != orders[1] and sorted(orders[0]) == sorted(orders[1])
