"""Links between vectors against all pairs in double precision."""

import math

import numpy as np
import pytest

from custodia.llm import vector_links

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, own string, links int"


def brute(rows, similarity=0.93):
    vectors = []
    for vec_id, v, label, *_ in rows:
        fine = v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        vectors.append((vec_id, np.array(v, dtype=np.float32).astype(float) if fine else None, label))
    n, root, links = len(vectors), list(range(len(vectors))), [0] * len(vectors)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = vectors[i], vectors[j]
            if a is None or b is None or la != lb or len(a) != len(b):
                continue
            a, b = a / np.abs(a).max(), b / np.abs(b).max()
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= similarity:
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[find(i)] = find(j)
    out = []
    for i in range(n):
        ids = [vectors[k][0] for k in range(n) if find(k) == find(i) and vectors[k][0] is not None]
        least = min(ids, default=None)
        out.append((vectors[i][0], links[i], least, vectors[i][0] == least))
    return sorted(out, key=repr)


def run(spark, rows):
    found = vector_links.near_vectors(spark.createDataFrame(rows, SCHEMA))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def planted(rng, n, dims=24):
    """Vectors, and near ones at similarities from just below the threshold on."""
    out = []
    while len(out) < n:
        base = rng.standard_normal(dims)
        base /= np.linalg.norm(base)
        label = int(rng.integers(0, 3))
        out.append((base, label))
        for _ in range(int(rng.integers(0, 4))):
            other = rng.standard_normal(dims)
            other -= (other @ base) * base
            other /= np.linalg.norm(other)
            cos = rng.choice([0.9, 0.925, 0.935, 0.95, 0.97, 0.999])
            out.append((3 * (cos * base + math.sqrt(1 - cos * cos) * other), label))
    return [(i, [float(x) for x in v], label, i, "x", 0) for i, (v, label) in enumerate(out)]


def test_against_all_pairs(spark):
    rows = planted(np.random.default_rng(5), 150)
    rows += [(1000 + i, rows[i][1], rows[i][2], 0, None, None) for i in range(12)] + [(2000 + i, rows[3][1], rows[3][2], 0, None, None) for i in range(9)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    v, w = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0]
    rows = [
        (1, v, 1), (2, w, 1), (2, w, 1), (3, None, 1), (4, [0.0, 0.0, 0.0], 1), (5, [1.0, None, 0.0], 1), (6, [1.0, float("nan"), 0.0], 1),
        (7, [1.0, float("inf"), 0.0], 1), (8, v, None), (9, v, 2), (None, v, 1), (None, [0.0, 1.0, 0.0], 1), (10, [1.0, 0.0], 1), (11, [], 1), (12, [1e30, 0.0, 0.0], 1), (13, [1e-30, 0.0, -0.0], 1),
    ]
    rows = [(*r, None, None, None) for r in rows]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_dense_group_is_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(vector_links, "PART", 16)
    monkeypatch.setattr(vector_links, "PAIRS", 64)
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rows = [(i, [float(x) for x in base + 0.06 * rng.standard_normal(16)], 0, None, None, None) for i in range(130)] + planted(rng, 30, 16)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("vectors", [2, 500, 5_000_000])
def test_planned_tables_find_pairs(vectors):
    tables, rows = vector_links.table_plan(vectors)
    near = vector_links.meeting_chance(math.sqrt(2 - 2 * 0.93), vector_links.WIDTH)
    assert (1 - near**rows) ** tables <= vector_links.MISS
    assert vectors * vector_links.meeting_chance(math.sqrt(2), vector_links.WIDTH) ** rows <= vector_links.CHANCE_MEETINGS


def test_recall_at_the_threshold():
    """Pairs of exactly the threshold meet as often as planned."""
    rng = np.random.default_rng(9)
    a = vector_links.unit_rows(rng.standard_normal((400, 64)))
    b = rng.standard_normal((400, 64))
    b = vector_links.unit_rows(b - (a * b).sum(axis=1, keepdims=True) * a)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * b
    tables, rows = vector_links.table_plan(5000)
    met = (vector_links.table_keys(a, tables, rows) == vector_links.table_keys(b, tables, rows)).any(axis=1)
    assert met.mean() >= 0.99
