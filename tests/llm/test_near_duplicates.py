"""Signatures, classes and components against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from custodia.llm import graph, near_duplicates

SCHEMA = "doc_id long, text string, row string, n string"


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    size = min(5, len(w))
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if w else Counter()


def similarity(a, b):
    return sum((a & b).values()) / sum((a | b).values()) if a and b else 0.0


def brute(docs):
    sets, root = [shingles(t) for _, t, *_ in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(docs[i][0])
    return sorted((sorted(g, key=repr) for g in groups.values()), key=repr)


def run(spark, docs):
    got = near_duplicates.near_duplicates(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    groups = {}
    for i, r in enumerate(got):
        groups.setdefault(r.class_id if r.class_size > 1 else ("alone", i), []).append(r)
    for g in groups.values():
        ids = [r.doc_id for r in g if r.doc_id is not None]
        assert sum(r.kept for r in g) == 1 and all(r.class_size == len(g) for r in g)
        assert all(r.class_id == (min(ids) if ids else None) for r in g)
    return sorted((sorted((r.doc_id for r in g), key=repr) for g in groups.values()), key=repr)


def texts(rng, n_groups=12):
    docs = []
    for g in range(n_groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 40, 150]))]
        docs.append(base)
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            docs.append(copy if rng.random() < 0.8 else copy * 2)
    return [(100 + i, " ".join(d), "x", "y") for i, d in enumerate(docs)]


def test_classes_against_brute_force(spark):
    docs = texts(random.Random(11))
    docs += [(1, None, None, None), (2, "", "", ""), (3, " .,", "", ""), (4, docs[0][1].upper(), "", ""), (4, docs[0][1], "", "")]
    docs += [(5, "la " * 3000, "", ""), (6, "la " * 2900, "", ""), (7, "la " * 200, "", "")]
    assert run(spark, docs) == brute(docs)


def test_leader_rounds_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "PAIRS_PER_MEMBER", 0.2)
    monkeypatch.setattr(near_duplicates, "LEADERS", 2)
    monkeypatch.setattr(near_duplicates, "LEADER_PAIRS", 2)  # leaders' pairs are dealt over shares
    docs = texts(random.Random(12), 5)
    base = [f"v{i}" for i in range(120)]
    for i in range(14):  # a chain of texts: neighbours are similar, ends are not
        docs.append((500 + i, " ".join(base[3 * i : 3 * i + 80]), "", ""))
    assert run(spark, docs) == brute(docs)


@pytest.mark.parametrize("per_member", [2000, 0.2])  # the rest of a bucket at once; leaders in rounds
def test_multisets_do_not_meet_by_bucket(spark, monkeypatch, per_member):
    """A text is in up to 25 buckets and its multiset is by far its widest column: buckets deal ids and sketches only."""
    plans, cut = [], near_duplicates.checkpointed

    def recorded(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(near_duplicates, "checkpointed", recorded)
    monkeypatch.setattr(near_duplicates, "PAIRS_PER_MEMBER", per_member)
    base = [f"v{i}" for i in range(130)]
    docs = [(i, " ".join(base[9 * i : 9 * i + 80]), "", "") for i in range(5)]  # neighbours share bands, but 0.79 isn't enough
    assert run(spark, docs) == brute(docs)
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    assert any("bucket" in line and "sketch" in line for line in joins)
    assert not [line for line in joins if "bucket" in line and "members" in line]


def test_parities_never_rule_out_a_similar_pair(spark):
    rng = np.random.default_rng(2)
    rows, sims = [], []
    for n in (1, 3, 40, 300, 5000):
        for lost in (0, 0.05, 0.1, 0.11, 0.12, 0.2, 0.5):
            a = rng.integers(-(2**63), 2**63, n)
            b = np.concatenate([a[int(n * lost) :], rng.integers(-(2**63), 2**63, int(n * lost))])
            x, y = near_duplicates.parity_words(np.concatenate([a, b]), np.array([n, len(b)])).tolist()
            rows.append((len(sims), n, x, len(b), y))
            sims.append(len(set(a) & set(b)) / len(set(a) | set(b)))
    df = spark.createDataFrame(rows, "i long, n long, parity array<long>, other_n long, other_parity array<long>")
    left = {r.i for r in df.filter(near_duplicates._near(0.8)).select("i").collect()}
    assert {i for i, s in enumerate(sims) if s >= 0.8} <= left
    assert not [i for i, s in enumerate(sims) if s < 0.7 and 3 < rows[i][1] < 5000 and i in left]


def test_similar_pairs_over_cells(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 40)
    monkeypatch.setattr(near_duplicates, "CELL_PAIRS", 3)
    monkeypatch.setattr(near_duplicates, "PIECE", 25)
    rng = random.Random(5)
    sets = [rng.sample(range(-9, 9), rng.randrange(1, 18)) for _ in range(24)]
    pairs = sorted({tuple(sorted(rng.sample(range(24), 2))) for _ in range(150)} | {(0, i) for i in range(1, 24)})
    texts = spark.createDataFrame([(i, len(m), m) for i, m in enumerate(sets)], "rep long, n long, members array<long>")
    want = [(a, b) for a, b in pairs if len(set(sets[a]) & set(sets[b])) >= 0.5 * len(set(sets[a]) | set(sets[b]))]
    for some in (pairs, []):
        got = near_duplicates._similar(spark.createDataFrame(some, "a long, rep long"), texts, 0.5).collect()
        assert sorted((r.a, r.b) for r in got) == (want if some else [])
    assert 5 < len(want) < len(pairs) - 5


@pytest.mark.parametrize("docs", [[], [(1, None, None, None)], [(None, "a b", None, None), (None, "a b", None, None)]])
def test_small_tables(spark, docs):
    got = near_duplicates.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(got) == len(docs) and sum(r.kept for r in got) == min(len(docs), 1)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(20):
        keys = rng.integers(0, 2**63, 50).astype(np.uint64)
        a = dict(zip(keys[:40].tolist(), rng.integers(1, 20, 40).tolist()))
        b = {k: max(1, a.get(k, 3) + int(d)) for k, d in zip(keys[6:].tolist(), rng.integers(-3, 4, 44))}
        true = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
        owner = np.repeat([0, 2], [len(a), len(b)])
        made = near_duplicates.signatures(owner, np.array([*a, *b], dtype=np.uint64), np.array([*a.values(), *b.values()]), 3, 2000)
        assert np.isinf(made[1]).all() and np.isfinite(made[[0, 2]]).all()
        errors.append((made[0] == made[2]).mean() - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_shingles_of_many_texts():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 4, n) for n in (0, 1, 3, 4, 5, 9, 0, 40, 200)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    owner, keys, counts = near_duplicates.shingles(np.concatenate(texts), ends)
    for i, t in enumerate(texts):
        size = min(5, len(t))
        own = Counter(tuple(t[j : j + size]) for j in range(len(t) - size + 1)) if size else Counter()
        assert sorted(counts[owner == i]) == sorted(own.values())
    alone = [near_duplicates.shingles(t, np.array([0, len(t)]))[1].tolist() for t in texts]
    assert [keys[owner == i].tolist() for i in range(len(texts))] == alone


def test_sketches_count_differing_slots(spark):
    rng = np.random.default_rng(8)
    best = rng.random((2, 125))
    best[1, 30:] = best[0, 30:]
    words = near_duplicates.sketch_words(best)
    codes = [[int(w) >> (4 * k) & 15 for w in row for k in range(16)] for row in words]
    differ = sum(x != y for x, y in zip(*codes))
    assert 15 <= differ <= 30
    df = spark.createDataFrame([(9, words[0].tolist(), 9, words[1].tolist())], "n long, sketch array<long>, other_n long, other_sketch array<long>")
    assert df.filter(near_duplicates._possible(0.8, 125)).count() == 1
    far = spark.createDataFrame([(9, words[0].tolist(), 9, (~words[1]).tolist())], df.schema)
    assert far.filter(near_duplicates._possible(0.8, 125)).count() == 0


@pytest.mark.parametrize("size", [None, 8])  # in one task; over tasks with star rounds
def test_components(spark, size):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + rng.randrange(1, 50)) for _ in range(80)] + [(7, 7), (None, 3), (200, 100)]
    rng.shuffle(links)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long"), size=size).collect()}
    assert {got[i] for i in range(61)} == {0} and got[200] == 100 and all(r == 100 for n, r in got.items() if n >= 100)
    assert set(got) == {n for link in links for n in link if n is not None}


def test_contraction_of_links():
    rng = np.random.default_rng(6)
    for _ in range(30):
        u, v = rng.integers(0, 60, (2, rng.integers(1, 70))) * 1000 - 7
        root = {n: n for n in [*u.tolist(), *v.tolist()]}
        for _ in root:
            for x, y in zip(u.tolist(), v.tolist()):
                root[x] = root[y] = min(root[x], root[y])
        node, least = graph.smallest_reachable(u, v)
        assert dict(zip(node.tolist(), least.tolist())) == {n: r for n, r in root.items() if n != r}


def test_bit_maps_grow_with_the_texts():
    bits = [near_duplicates._map_bits(n) for n in (0, 1, 70_000, 2_000_000, 10**10)]
    assert bits == [1 << 20, 1 << 20, 1 << 21, 1 << 25, 1 << 28]


def test_no_links(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
