"""The histogram and its answers against encoding and counting in plain Python."""

import os
import random

import pytest
import tiktoken

from custodia.llm import token_counts

SCHEMA = "doc_id long, text string, n_tokens string, tokens string"
pytestmark = pytest.mark.skipif(not os.path.exists(token_counts.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def encoder():
    ranks = token_counts.vocabulary(token_counts.VOCABULARY)
    return tiktoken.Encoding("test", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_against_plain_counts(spark, encoder):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["the ", "Zu ", "é", "\n", "12", "##", "𝔘 "]) for _ in range(rng.choice([0, 1, 9, 300]))) for _ in range(70)]
    texts += [None, "", texts[3], texts[3], "word " * 40_000, "<|endoftext|>", "x" * 3000]
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA).repartition(4)
    n = [len(encoder.encode_ordinary(t)) if t else 0 for t in texts]
    sums = token_counts.with_suffix_sums(token_counts.histogram(token_counts.lengths(df)), block=16).cache()
    got = {r.n_tokens: tuple(r)[1:] for r in sums.collect()}
    want = {
        L: (n.count(L), L * n.count(L), sum(x >= L for x in n), sum(x for x in n if x >= L), sum(x <= L for x in n), sum(min(x, L) for x in n)) for L in set(n)
    }
    assert got == want
    assert tuple(token_counts.totals(sums).first()) == (len(n), sum(n), max(n))
    for share, length in (tuple(r) for r in token_counts.quantiles(sums, [0.0, 0.1, 0.5, 0.99, 1.0]).collect()):
        assert length == min(x for x in n if sum(y <= x for y in n) >= share * len(n))
    for limit, kept, cut in (tuple(r) for r in token_counts.truncated_totals(sums, [0, 3, 17, 10**6]).collect()):
        assert kept == sum(min(x, limit) for x in n) and cut == sum(x > limit for x in n)


def test_round_trip(encoder):
    for text in ("Zu und. Dieüauß der.", " a\n\n b\t", "𝔘 é"):
        assert encoder.decode(encoder.encode_ordinary(text)) == text


def test_empty_table(spark):
    sums = token_counts.with_suffix_sums(token_counts.histogram(token_counts.lengths(spark.createDataFrame([], SCHEMA))))
    assert sums.count() == 0 and tuple(token_counts.totals(sums).first()) == (0, 0, None)
    assert tuple(token_counts.quantiles(sums, [0.5]).first()) == (0.5, None)
    assert tuple(token_counts.truncated_totals(sums, [4]).first()) == (4, 0, 0)
