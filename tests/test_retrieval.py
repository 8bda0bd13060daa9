import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from custodia.operators import retrieval
from custodia.operators.access import Principal, apply_entitlements
from custodia.plans import jobs

rng = np.random.default_rng(5)


def test_chunks_of_500_words(spark):
    sizes = [0, 1, 500, 501, 950, 951, 1400]
    docs = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in sizes], "document_id int, content string")
    chunks = retrieval.chunk_text(docs)
    assert rows(chunks.groupBy("document_id").count()) == [(0, 1), (1, 1), (1400, 4), (500, 1), (501, 2), (950, 3), (951, 3)]
    last = chunks.filter("document_id = 1400 AND chunk_index = 3").first()["chunk"].split()
    assert last[0] == "w1350" and last[-1] == "w1399"
    assert "content" not in chunks.columns
    with pytest.raises(ValueError):
        retrieval.chunk_text(docs, max_tokens=5, overlap=5)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\té", max_size=60), min_size=1, max_size=5), st.integers(2, 7), st.integers(0, 1))
def test_chunks_without_overlap_rebuild_the_text(spark, texts, max_tokens, overlap):
    from custodia.functions.text import tokens

    docs = spark.createDataFrame(list(enumerate(texts)), "document_id int, content string")
    chunks = retrieval.chunk_text(docs, max_tokens=max_tokens, overlap=overlap)
    cut = chunks.withColumn("words", tokens(F.col("chunk"))).orderBy("document_id", "chunk_index").collect()
    for ident, text in enumerate(texts):
        mine = [r for r in cut if r["document_id"] == ident]
        if len(mine) == 1:
            assert mine[0]["chunk"] == text
            continue
        assert "".join("".join(r["words"][overlap if r["chunk_index"] else 0 :]) for r in mine) == text
        assert all(len(r["words"]) <= max_tokens for r in mine)


def brute(vectors, queries, k, threshold, allowed=None):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = []
    for q, query in enumerate(queries):
        scores = np.round(unit @ (query / np.linalg.norm(query)), 9)
        order = sorted((-s, i) for i, s in enumerate(scores) if s > threshold and (allowed is None or i in allowed[q]))
        out += [(q, i, rank + 1) for rank, (_, i) in enumerate(order[:k])]
    return sorted(out, key=repr)


def frames(spark, vectors, queries):
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "chunk_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id bigint, embedding array<float>")
    return chunks.repartition(4), asked


@pytest.fixture(scope="module")
def vectors():
    """Random directions, a third of them the same one."""
    data = rng.normal(size=(300, 8)).astype("float32")
    data[::3] = data[0]
    return data


def test_search_in_one_list_and_in_small_blocks(spark, vectors, monkeypatch):
    queries = vectors[[0, 1, 2, 4]] + 0.01
    chunks, asked = frames(spark, vectors, queries)
    want = brute(vectors.astype("float64"), queries.astype("float64"), 7, 0.2)
    assert rows(retrieval.vector_search(chunks, asked, 7, 0.2), "query_id", "chunk_id", "rank") == want
    for lists, block, some, cells in ((9, 40, 2, 4_000_000), (3, 10_000, 1, 3)):
        monkeypatch.setattr(retrieval, "BLOCK_ROWS", block)
        monkeypatch.setattr(retrieval, "QUERY_ROWS", some)
        monkeypatch.setattr(retrieval, "SLICE_CELLS", cells)
        found = retrieval.vector_search(chunks, asked, 7, 0.2, lists=lists, nprobe=1)
        assert rows(found, "query_id", "chunk_id", "rank") == want
    assert retrieval.vector_search(chunks, asked.limit(0), 7).count() == 0
    assert retrieval.vector_search(chunks.limit(0), asked, 7).count() == 0


def test_answer_is_the_same_alone_and_among_many(spark, vectors, tmp_path):
    queries = rng.normal(size=(2000, 8)).astype("float32")
    chunks, asked = frames(spark, vectors, queries)
    retrieval.build_ivf(chunks, str(tmp_path / "ivf"), lists=12)
    for exact in (False, True):
        among = retrieval.ivf_search(str(tmp_path / "ivf"), asked, 5, 0.0, nprobe=1, exact=exact).filter("query_id = 7")
        alone = retrieval.ivf_search(str(tmp_path / "ivf"), asked.filter("query_id = 7"), 5, 0.0, nprobe=1, exact=exact)
        assert rows(among) == rows(alone)


def test_zero_and_missing_vectors_match_nothing(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "chunk_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id bigint, embedding array<float>")
    assert rows(retrieval.vector_search(chunks, asked, 5, -2.0), "query_id", "chunk_id") == [(1, 1)]


@pytest.mark.parametrize("indexed", [False, True])
def test_secured_search_sees_only_what_the_policy_shows(spark, vectors, indexed, tmp_path):
    categories = ["Records", "Performance Review", "Code of Conduct", None]
    access = [(i, categories[i % 4], [f"u{i % 5}@x"] if i % 2 else None, f"E{i % 7}") for i in range(300)]
    info = spark.createDataFrame(access, "chunk_id bigint, category string, entitled_emails array<string>, extracted_employee_id string")
    people = [("u1@x", "E1", ["pm"]), ("u2@x", "E2", ["can_see_all_reviews"]), ("u9@x", None, None)]
    chunks, asked = frames(spark, vectors, vectors[[0, 1, 2]])
    who = spark.createDataFrame([(i, *p) for i, p in enumerate(people)], "query_id bigint, email string, employee_id string, groups array<string>")
    secured, people_asking = chunks.join(info, "chunk_id"), asked.join(who, "query_id")
    if indexed:
        retrieval.build_ivf(secured, str(tmp_path / "ivf"), lists=6)
        found = retrieval.ivf_search(str(tmp_path / "ivf"), people_asking, 6, 0.0, nprobe=1, secured=True)
    else:
        found = retrieval.vector_search(secured, people_asking, 6, 0.0, secured=True)
    allowed = []
    for email, employee, groups in people:
        visible = apply_entitlements(info, Principal(email, employee or "", tuple(groups or ())))
        allowed.append({r["chunk_id"] for r in visible.collect()})
    want = brute(vectors.astype("float64"), vectors[[0, 1, 2]].astype("float64"), 6, 0.0, allowed)
    assert rows(found, "query_id", "chunk_id", "rank") == want


def test_inverted_lists(spark, vectors, tmp_path):
    queries = rng.normal(size=(6, 8)).astype("float32")
    chunks, asked = frames(spark, vectors, queries)
    retrieval.build_ivf(chunks, str(tmp_path / "ivf"), lists=10)
    want = brute(vectors.astype("float64"), queries.astype("float64"), 5, 0.1)
    exact = retrieval.ivf_search(str(tmp_path / "ivf"), asked, 5, 0.1, nprobe=2)
    assert rows(exact, "query_id", "chunk_id", "rank") == want
    some = retrieval.ivf_search(str(tmp_path / "ivf"), asked, 5, 0.1, nprobe=4, exact=False)
    hit = {(q, c) for q, c, _ in want} & {(r["query_id"], r["chunk_id"]) for r in some.collect()}
    assert len(hit) >= 0.5 * len(want)
    everything = retrieval.ivf_search(str(tmp_path / "ivf"), asked, 5, 0.1, nprobe=10, exact=False)
    assert rows(everything, "query_id", "chunk_id", "rank") == want


def test_fusion_and_context(spark):
    shape = "request_id int, query_pos int, query string, rank int, title string, chunk_index int, chunk_id int, category string"
    results = spark.createDataFrame(
        [
            (1, 0, "q0", 1, "A", 0, 10, "c"), (1, 0, "q0", 2, "A", 1, 11, "c"), (1, 0, "q0", 3, "A", 2, 12, "c"), (1, 0, "q0", 4, "A", 3, 13, "c"),
            (1, 1, "q1", 1, "B", 0, 20, "d"), (1, 1, "q1", 2, "A", 1, 11, "c"),
            (2, 0, "q0", 1, "A", 0, 10, "c"),
        ],
        shape,
    )
    fused = retrieval.rank_fusion(results)
    got = [tuple(r) for r in fused.filter("request_id = 1").orderBy("position").select("chunk_id", "score", "matching_queries").collect()]
    assert got[0] == (10, 1.0, ["q0"]) and got[1] == (11, 1.0, ["q0", "q1"]) and got[2] == (20, 1.0, ["q1"])
    assert [g[0] for g in got] == [10, 11, 20, 12, 13]
    assert rows(retrieval.rank_fusion(results, max_results=2).groupBy("request_id").count()) == [(1, 2), (2, 1)]
    assert retrieval.rank_fusion(results, k=60).filter("chunk_id = 11").first()["score"] == pytest.approx(2 / 62, abs=1e-8)
    context = retrieval.context_rows(fused)
    assert [r["chunk_id"] for r in context.filter("request_id = 1").orderBy("number").collect()] == [10, 11, 20, 12]
    assert [r["chunk_id"] for r in retrieval.context_rows(fused, total=2).filter("request_id = 1").orderBy("number").collect()] == [10, 11]
    asked = spark.createDataFrame([(2,), (3,)], "request_id int")
    texts = dict(rows(retrieval.format_context(context.filter("request_id = 2").withColumn("content", F.lit("body")), asked)))
    assert texts[2] == "Document 1 (from A, category: c) (relevance: 1.000):\n   Matched queries: q0\nbody\n"
    assert texts[3] == "No relevant documents found for this query."


def test_recent_turns(spark):
    turns = spark.createDataFrame([(u, t) for u in ("a", "b") for t in range(30 if u == "a" else 3)], "user_id string, turn int")
    got = retrieval.recent_turns(turns)
    assert rows(got.groupBy("user_id").agg(F.min("turn"), F.count("*"))) == [("a", 10, 20), ("b", 0, 3)]
    assert got.filter("user_id = 'a' AND turn_number = 1").first()["turn"] == 10


def test_ingest(spark):
    import json

    def hit(ident, name, **source):
        return ident, name, "HR", json.dumps(source)

    hits = spark.createDataFrame(
        [
            hit(1, "a.txt", **{"dxr#raw_text": "hello world", "computed.metadata#WHO_CAN_ACCESS": ['{"email":"a@x"}', "bad", {"email": "b@x"}], "extracted_metadata#7": '{"employee_id":"E1"}'}),
            hit(2, None, **{"dxr#raw_text": "w " * 600, "title": "Two"}),
            hit(3, "", **{"dxr#raw_text": "three", "extracted_metadata#7": "broken"}),
            hit(4, "blank.txt", **{"dxr#raw_text": " \n "}),
            hit(5, "none.txt"),
            hit(6, "t" * 300, **{"dxr#raw_text": "six"}),
        ],
        "hit_id bigint, file_name string, category string, j string",
    ).select("hit_id", "file_name", "category", F.parse_json("j").alias("source"))
    result = jobs.ingest_documents(jobs.documents_of_hits(hits, "7"), lambda texts: [[1.0] * 16 for _ in texts])
    got = rows(result.documents, "document_id", "title", "entitled_emails", "extracted_employee_id")
    assert got == [(1, "a.txt", ["a@x", "b@x"], "E1"), (2, "Two", [], None), (3, "Untitled Document", [], None)]
    assert rows(result.chunks.groupBy("document_id").count()) == [(1, 1), (2, 2), (3, 1)]
    assert result.chunks.filter("size(embedding) <> 16").count() == 0
    metrics = jobs.run_metrics(result).first()
    assert (metrics["documents_processed"], metrics["chunks_created"], metrics["n_errors"]) == (3, 4, 1)
    assert metrics["first_errors"] == [f"Failed to process document {'t' * 300}: title longer than 255"]


@pytest.mark.parametrize("few", [0, 20, 10_000])
def test_askers_share_what_their_questions_and_grants_have_in_common(spark, vectors, few, monkeypatch):
    """Very many askers of few questions: each direction is searched once for each grant that chunks hold, whoever asks."""
    monkeypatch.setattr(retrieval, "FEW_ROWS", few)
    probed, pairs = [], retrieval._search_pairs
    monkeypatch.setattr(retrieval, "_search_pairs", lambda lists, probes, *rest: probed.append(probes.select("query_id").distinct().count()) or pairs(lists, probes, *rest))
    categories = ["Records", "Performance Review", "Code of Conduct", None]
    access = [(i, vectors[i].tolist(), categories[i % 4], ["u1@x", f"u{i % 5}@x"] if i % 2 else None, f"E{i % 7}") for i in range(300)]
    schema = "chunk_id bigint, embedding array<float>, category string, entitled_emails array<string>, extracted_employee_id string"
    chunks = spark.createDataFrame(access + access[:9], schema)  # some chunks come twice
    people = [(f"u{i}@x", f"E{i}", ["can_see_all_reviews"] if i % 10 == 0 else []) for i in range(200)]
    data = [(i % 190, vectors[i % 2].tolist(), *p) for i, p in enumerate(people)]  # and some query ids
    asked = spark.createDataFrame(data, "query_id bigint, embedding array<float>, email string, employee_id string, groups array<string>")
    found = retrieval.vector_search(chunks, asked, 6, 0.0, secured=True, lists=5, nprobe=1)
    info = chunks.drop("embedding")
    unit = vectors.astype("float64") / np.linalg.norm(vectors.astype("float64"), axis=1, keepdims=True)
    scores = {}
    for query, vector, email, employee, groups in data:
        at = np.round(unit @ unit[data.index((query, vector, email, employee, groups)) % 2], 9)
        may = [c for c, _, category, mails, own in access + access[:9] if category == "Code of Conduct" or email in (mails or []) or category == "Performance Review" and (groups or own == employee)]
        scores.setdefault(query, []).extend((-at[c], c) for c in may if at[c] > 0)
    want = [(q, c, rank) for q, some in scores.items() for rank, (_, c) in enumerate(sorted(some)[:6], start=1)]
    assert info.count() == 309 and rows(found, "query_id", "chunk_id", "rank") == sorted(want, key=repr)
    assert max(probed, default=0) <= 30  # 200 askers before


def test_equal_contexts_are_written_once(spark, vectors, monkeypatch):
    data = [(i, v.tolist(), "Code of Conduct", None, None, f"t{i % 4}", i, f"text {i}") for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(data, "chunk_id bigint, embedding array<float>, category string, entitled_emails array<string>, extracted_employee_id string, title string, chunk_index int, content string")
    asked = [(i, i // 2, i % 2, f"q{(i + i // 2) % 2}", vectors[(i + i // 2) % 2].tolist(), f"u{i}@x", f"E{i}", []) for i in range(60)]
    queries = spark.createDataFrame(asked, "query_id bigint, request_id bigint, query_pos int, query string, embedding array<float>, email string, employee_id string, groups array<string>")
    want = rows(retrieval.format_context(jobs.retrieve(chunks, queries).drop("content").join(chunks.select("chunk_id", "content"), "chunk_id")))
    written, write = [], retrieval.format_context
    monkeypatch.setattr(retrieval, "format_context", lambda some, *rest: written.append(write(some, *rest)) or written[-1])
    assert rows(jobs.retrieve_context(chunks, queries)) == want and len(want) == 30
    assert written[0].count() == 2  # 30 before
    nothing = jobs.retrieve_context(chunks, queries.withColumn("embedding", F.expr("transform(embedding, x -> 0f)"))).select("context").distinct()
    assert rows(nothing) == [("No relevant documents found for this query.",)]


def test_probes_leave_in_small_slices(spark):
    """However many lists the queries of a batch probe, few rows with vectors are made at a time."""
    queries = rng.normal(size=(600, 8)).astype("float32")
    _, asked = frames(spark, queries, queries)
    taken = []

    class Asked:
        columns, schema = [*asked.columns, "limit"], asked.schema
        mapInPandas = staticmethod(lambda work, schema: taken.append(work))  # noqa: N815

    centers = retrieval._unit(asked.limit(40).toPandas()["embedding"])
    lists = retrieval.Lists(None, np.arange(40), centers, np.ones(40), np.ones(40, dtype="int64"))
    retrieval._probes(Asked, lists, 40, 0.2)
    sizes = [len(some) for some in taken[0](iter([asked.toPandas().assign(limit=np.nan)]))]
    assert sum(sizes) == 600 * 40 and max(sizes) <= 8192  # 24,000 at once before
