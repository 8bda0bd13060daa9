"""Keys, the bit-parallel distance and removed lines against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from custodia.llm import line_dedup

SCHEMA = "doc_id long, text string, lines string, digest string, n_chars long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(at, rng.choice("abé x"))
        elif out and at < len(out):
            out[at : at + 1] = [rng.choice("abé x")] if kind == 1 else []
    return "".join(out)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_distance_and_shared_keys(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(250):
        a = "".join(rng.choice("abcdé 𝔘") for _ in range(rng.randrange(edits + 1, 40)))
        pairs.append((a, edited(rng, a, rng.randrange(edits + 3)) or "a"))
    df = spark.createDataFrame(pairs, "a string, b string")
    df = df.withColumn("n", F.monotonically_increasing_id()).cache()
    index, probes = (line_dedup.key_rows(df.select("n", line_dedup.wide(F.col(c)).alias("wide")), edits) for c in ("b", "a"))
    met = {r.n for r in index.filter("entry = 1").join(probes, ["n", "key"]).select("n").distinct().collect()}
    for r in line_dedup.with_near(df, "a", "b", edits).collect():
        assert r.near == (distance(r.a, r.b) <= edits), (r.a, r.b)
        if r.near and len(r.a) >= len(r.b) > edits:
            assert r.n in met, (r.a, r.b)


def brute(docs, edits, min_chars):
    places = {}
    order = lambda i, n: (i is None, i or 0, n)
    for i, text, *_ in docs:
        for n, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.strip(" \t\n\x0b\x0c\r"):
                places[line] = min(places.get(line, order(i, n)), order(i, n))
    long = [x for x in places if len(x) >= min_chars]
    near = {
        a for a in long for b in long if (places[b], b) < (places[a], a) and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits
    }
    out = []
    for i, text, *_ in docs:
        lines = [(n, x) for n, x in enumerate((text or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
        repeated = [n for n, x in lines if order(i, n) > places[x]]
        gone = sorted({*repeated, *[n for n, x in lines if x in near]})
        out.append((i, len(lines), len(repeated), len(gone) - len(repeated), gone))
    return out


def corpus():
    rng = random.Random(9)
    sentence = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(n))
    base = [sentence(rng.randrange(1, 14)) for _ in range(40)]
    template = "page {} of three hundred and more, printed at night"
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(7)):
            kind = rng.random()
            lines.append(edited(rng, rng.choice(base), rng.randrange(4)) if kind < 0.5 else sentence(6) if kind < 0.7 else rng.choice(["", " ", base[0], template.format(rng.randrange(60))]))
        docs.append((i * 7 % 61, "\n".join(lines), "", "", 0))
    docs += [(None, base[0] + "\n" + base[1] + "x", "", "", 0), (None, None, None, None, None), (3, None, "", "", 0), (500, "\n \n", "", "", 0)]
    docs += [(502, "a line of some length, first", "", "", 0), (502, "a line of some length, firsts", "", "", 0)]
    return docs + [(501, base[2] * 300 + "\n" + base[2] * 300 + "ab\n" + base[3], "", "", 0), (docs[4][0], docs[4][1], "", "", 0)]


def test_removed_lines_against_brute_force(spark):
    docs = corpus()
    got = line_dedup.line_counts(spark.createDataFrame(docs, SCHEMA).repartition(4)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(brute(docs, 2, 24), key=repr)


def test_texts_without_removed_lines(spark):
    docs = corpus()
    gone = {(d[0], d[1]): b[4] for d, b in zip(docs, brute(docs, 2, 24))}
    want = []
    for i, text, *_ in docs:
        kept = [x for n, x in enumerate((text or "").split("\n")) if n not in gone[i, text]]
        if not gone[i, text]:
            want.append((i, text))
        elif any(x.strip() for x in kept):
            want.append((i, "\n".join(kept)))
    got = line_dedup.deduplicated(spark.createDataFrame(docs, SCHEMA))
    assert got.columns == ["doc_id", "text", "lines", "digest", "n_chars"]
    assert sorted((tuple(r) for r in got.select("doc_id", "text").collect()), key=repr) == sorted(want, key=repr)


def test_small_tables_and_plan(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert line_dedup.line_counts(empty).count() == 0 and line_dedup.deduplicated(empty).count() == 0
    one = spark.createDataFrame([(1, "a\na\n\nb", "", "", 0)], SCHEMA)
    counts = line_dedup.line_counts(one)
    assert tuple(counts.first()) == (1, 3, 1, 0, [1])
    assert not re.search("Python|Arrow|Cartesian|NestedLoop", counts._jdf.queryExecution().toString())
