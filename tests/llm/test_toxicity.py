"""Lattices against all paths, the language model against counting, and scores of planted noise."""

import itertools
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from custodia.llm import toxicity

DOCS = "doc_id long, text string, score string, held_out string"
LABELS = "doc_id long, toxic int, text string"


def model_of(*texts):
    counts = np.zeros((64, 64, 64))
    for t in texts:
        s = [0, 0, *[toxicity.CODE.get(c, 63) if c.isalpha() else 0 for c in t]]
        for a, b, c in zip(s, s[1:], s[2:]):
            counts[a, b, c] += 1
    return toxicity.language_model(counts)


def test_viterbi_equals_the_best_of_all_paths():
    model = model_of("stupid idiot loser the quick brown fox is here", "a list of words to lose")
    rng = random.Random(1)
    for _ in range(60):
        spelled = "".join(rng.choice("is10$lo t") for _ in range(rng.randrange(1, 7)))
        options = toxicity.lattice(spelled)

        def points(path):
            a = b = 0
            total = 0.0
            for emitted, cost in path:
                total += cost
                for c in emitted:
                    s = 0 if c == " " else toxicity.CODE[c]
                    total += model[a, b, s]
                    a, b = b, s
            return total + model[a, b, 0]

        best = max(points(p) for p in itertools.product(*options))
        text = toxicity.viterbi(options, model)
        same = [p for p in itertools.product(*options) if "".join(e for e, _ in p) == text]
        assert same and max(points(p) for p in same) == pytest.approx(best)


def test_counts_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 3)
    texts = ["Abc, dé 1", None, "", "𝔘中ß a", "abc " * 9000]
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS).repartition(3)
    want = Counter()
    for t in texts:
        s = [0, 0, *[toxicity.CODE.get(c, 63) if c.isalpha() else 0 for c in (t or "").lower()]]
        want.update(zip(s, s[1:], s[2:]))
    got = toxicity.trigram_counts(df, "text")
    assert {tuple(i): int(got[tuple(i)]) for i in np.argwhere(got).tolist()} == dict(want)


def test_restored_words():
    words = "stupid idiot loser worthless pathetic clown trash the of and that with this from"
    restorer = toxicity.Restorer(model_of(*[words] * 30))
    for noisy, plain in {
        "5tup1d": "stupid", "1d10t!!": "idiot", "l0$er": "loser", "s.t.u.p.i.d": "stupid", "w o r t h l e s s": "worthless",
        "p4th3t1c": "pathetic", "stuuuupid": "stupid", "cl0wn***": "clown", "tr@sh": "trash", "LO-SER": "loser", "$$$idiot": "idiot",
    }.items():
        assert plain in restorer.words(f"the {noisy} of")[0], noisy
    assert restorer.words("the of, *** 12 $$ --")[0] == {"the", "of"}
    assert restorer.words(None) == (set(), 0)
    assert restorer.words("a1" * 3000)[1] == 1


def corpus(rng, n):
    vocabulary = ["".join(rng.choice("abdefghiklmnoprstu") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["stupid", "moron", "clown", "wretchly", "wretched"])
        docs.append((i, " ".join(words), "", ""))
        labels.append((i, int(toxic), ""))
    return docs, labels


def test_scores_of_planted_noise(spark):
    docs, labels = corpus(random.Random(6), 600)
    base = docs[1][1].split()
    planted = {9001: ["5tup1d", "m0r0n"], 9002: ["s t u p i d", "cl0wn"], 9003: ["mooooron", "STUPID!!"], 9004: ["wretchful", "moron"]}
    clean = {9101: ["edha$$$", "be***"], 9102: ["1999", "a b"], 9103: []}
    docs += [(i, " ".join(base[:20] + p + base[20:]), "", "") for i, p in {**planted, **clean}.items()]
    docs += [(None, None, None, None), (5, None, "", ""), (6, "", "", ""), (7, "x" * 200_000, "", "")]
    labels += [(None, 1, ""), (3, None, ""), (5, 0, ""), (5, 0, "")]
    got = toxicity.scored(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    found = {r.doc_id: r.predicted for r in got}
    assert all(found[i] == 1 for i in planted) and all(found[i] == 0 for i in clean)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) / len(held) > 0.97


def test_texts_with_one_header_are_all_learned_from(spark):
    docs, labels = corpus(random.Random(8), 600)
    header = "from the archive of one hot source, all pages of which begin alike, "
    docs = [(i, header + text, "", "") for i, text, *_ in docs]
    got = toxicity.scored(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).filter("held_out").collect()
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in got) / len(got) > 0.97


@pytest.mark.parametrize("labels", [[], [(1, 1, "")], [(i, 0, "") for i in range(9)]])
def test_few_labels(spark, labels):
    docs = [(1, "a b", "", ""), (2, None, "", "")]
    scores = {r.score for r in toxicity.scored(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert len(scores) == 1
    assert toxicity.scored(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).count() == 0


def test_only_texts_go_to_python_one_at_a_time(spark, monkeypatch):
    docs, labels = corpus(random.Random(7), 200)
    df = spark.createDataFrame(docs, DOCS).withColumn("row", F.struct("doc_id", "text"))
    got = toxicity.scored(df, spark.createDataFrame(labels, LABELS))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
    assert got.columns == ["doc_id", "text", "row", "held_out", "score", "predicted"]
    assert all(r.row.text == r.text and r.row.doc_id == r.doc_id for r in got.collect())
    scorer = toxicity.Scorer(model_of("a b"), {}, np.ones(5), None)
    monkeypatch.setattr(scorer, "restorer", toxicity.Restorer(scorer.model), raising=False)
    seen = []

    def texts():
        for text in ("a", None, "b"):
            assert len(seen) == calls[0]
            seen.append(text)
            yield text

    calls, words = [0], scorer.restorer.words
    monkeypatch.setattr(scorer.restorer, "words", lambda text: calls.__setitem__(0, calls[0] + 1) or words(text))
    assert len(scorer.scores(texts())) == 3 and calls == [3]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables are not there")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scored(docs, labels).drop("text").filter("held_out").join(labels, "doc_id")
    right = got.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int")), F.expr("avg(predicted) FILTER (WHERE toxic = 1)")).first()
    assert right[0] > 0.97 and right[1] > 0.8
