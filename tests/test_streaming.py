import json

from conftest import rows
from pyspark.sql import functions as F
from test_mail import message

from custodia.operators import annotate, labels, mail
from custodia.sources import tables
from custodia.streaming import streams

SCHEMA = "file_id string, category string, labels array<string>"


def drop_file(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in records))


def test_stream_routes_like_the_batch(spark, tmp_path):
    inbox = tmp_path / "in"
    first = [{"file_id": str(i), "category": "c", "labels": [["A"], ["B"], [], None][i % 4]} for i in range(20)]
    second = [{"file_id": str(i), "category": "d", "labels": ["B", "A"]} for i in range(20, 25)]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        arriving = streams.arriving(spark, str(inbox), SCHEMA, per_batch=1)
        streams.route_stream(arriving, ["A"], ["B"], out, state).awaitTermination()

    drop_file(inbox, "one.json", first)
    run()
    drop_file(inbox, "two.json", second)
    run()
    run()
    columns = ["file_id", "target", "action", "written_category"]
    batch = labels.route(spark.read.schema(SCHEMA).json(str(inbox)), ["A"], ["B"])
    assert rows(spark.read.parquet(out), *columns) == rows(batch, *columns)


def test_polled_sync_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    inbox, target, failures = tmp_path / "in", str(tmp_path / "target"), str(tmp_path / "failed")
    schema = "k string, t int, v string"

    def run():
        arriving = streams.arriving(spark, str(inbox), schema)
        streams.sync_stream(arriving, target, ["k"], ["t"], str(tmp_path / "state"), failures, 4, every=None).awaitTermination()

    drop_file(inbox, "1.json", [{"k": "a", "t": 1, "v": "x"}, {"k": "a", "t": 2, "v": "y"}, {"k": "b", "t": 1, "v": "z"}])
    run()
    assert rows(tables.read_keyed(spark, target)) == [("a", 2, "y"), ("b", 1, "z")]
    real = tables.merge_upsert
    monkeypatch.setattr(tables, "merge_upsert", lambda *a: (_ for _ in ()).throw(RuntimeError("no catalog")))
    drop_file(inbox, "2.json", [{"k": "c", "t": 1, "v": "lost?"}])
    run()
    monkeypatch.setattr(tables, "merge_upsert", real)
    drop_file(inbox, "3.json", [{"k": "b", "t": 5, "v": "new"}])
    run()
    assert rows(tables.read_keyed(spark, target)) == [("a", 2, "y"), ("b", 5, "new")]
    assert rows(spark.read.parquet(failures), "k", "error") == [("c", "no catalog")]
    streams.replay(spark, failures, lambda batch: tables.merge_upsert(batch, target, ["k"]))
    assert rows(tables.read_keyed(spark, target)) == [("a", 2, "y"), ("b", 5, "new"), ("c", 1, "lost?")]


def test_late_and_repeated_rows_change_nothing(spark, tmp_path):
    inbox, target = tmp_path / "in", str(tmp_path / "target")
    schema = "k string, t int, v string"

    def run(name, records):
        drop_file(inbox, name, records)
        arriving = streams.arriving(spark, str(inbox), schema)
        streams.sync_stream(arriving, target, ["k"], ["t"], str(tmp_path / "state"), str(tmp_path / "failed"), 4, every=None).awaitTermination()
        return rows(tables.read_keyed(spark, target))

    assert run("1.json", [{"k": "a", "t": 5, "v": "new"}, {"k": "n", "t": None, "v": "undated"}]) == [("a", 5, "new"), ("n", None, "undated")]
    manifests = len(list((tmp_path / "target" / "manifest").iterdir()))
    assert run("2.json", [{"k": "a", "t": 3, "v": "late"}, {"k": "a", "t": 5, "v": "again"}]) == [("a", 5, "new"), ("n", None, "undated")]
    assert len(list((tmp_path / "target" / "manifest").iterdir())) == manifests
    assert run("3.json", [{"k": "a", "t": 4, "v": "late"}, {"k": "b", "t": 1, "v": "first"}, {"k": "n", "t": 0, "v": "dated"}]) == [("a", 5, "new"), ("b", 1, "first"), ("n", 0, "dated")]


def test_mail_gate_over_a_folder(spark, tmp_path):
    inbox = tmp_path / "mail"
    inbox.mkdir()
    words = spark.createDataFrame([("finance", "financial projections")], "annotator string, keyword string")
    rules = spark.createDataFrame([("finance", "Sensitive Financial Information")], "annotator string, label string")
    blocked = spark.createDataFrame([(0, "Sensitive Financial Information", "Financial data found")], "pos int, name string, message string")

    def classify(found):
        texts = found.select(F.struct("message_id", "att_pos").alias("doc"), F.col("content").cast("string").alias("text"))
        texts = texts.select(F.to_json("doc").alias("doc_id"), "text")
        named = annotate.apply_label_rules(annotate.annotate(texts, words), rules)
        doc = F.from_json("doc_id", "message_id string, att_pos int")
        return named.select(doc.alias("d"), F.posexplode("labels").alias("label_pos", "name")).select(
            "d.message_id", "d.att_pos", F.lit(0).alias("hit_pos"), "label_pos", "name"
        )

    def run(how):
        streams.mail_gate_stream(spark, str(inbox), how, blocked, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()

    (inbox / "safe.eml").write_bytes(message(("notes.txt", b"lunch")))
    (inbox / "bad.eml").write_bytes(message(("ok.txt", b"hello"), ("plan.txt", b"our Financial Projections")))
    (inbox / "plain.eml").write_bytes(message())
    (inbox / "other.txt").write_bytes(b"no mail")
    run(classify)
    (inbox / "late.eml").write_bytes(message(("plan.txt", b"financial projections")))

    def down(found):
        raise RuntimeError("classifier down")

    run(down)
    verdicts = spark.read.parquet(str(tmp_path / "out"))
    got = {r["message_id"].rsplit("/", 1)[1]: (r["code"], r["reply"], r["classification_error"]) for r in verdicts.collect()}
    assert got["bad.eml"] == (550, "550 Blocked - Financial data found in plan.txt", False)
    assert {k: v[0] for k, v in got.items()} == {"safe.eml": 250, "bad.eml": 550, "plain.eml": 250, "late.eml": 250}
    assert got["late.eml"][2] is True


def test_classifier_that_fails_while_it_runs(spark):
    """One attachment makes the classifier fail lazily: it passes, flagged, and the others are judged."""
    found = spark.createDataFrame([(f"m{i}", 0, f"f{i}", b"bad" if i == 3 else b"x") for i in range(9)], "message_id string, att_pos int, filename string, content binary")
    schema = "message_id string, att_pos int, hit_pos int, label_pos int, name string"

    def classify(df):
        def work(batches):
            for batch in batches:
                if any(bytes(c) == b"bad" for c in batch["content"]):
                    raise RuntimeError("unreadable")
                yield batch[["message_id", "att_pos"]].assign(hit_pos=0, label_pos=0, name="L")

        return df.mapInPandas(work, schema)

    named, flagged = streams.classified(found, classify)
    assert rows(named, "message_id") == [(f"m{i}",) for i in range(9) if i != 3]
    assert rows(flagged.filter("classification_error"), "message_id") == [("m3",)]
    named, flagged = streams.classified(found, classify, attempts=1)
    assert named.count() == 0 and flagged.filter("classification_error").count() == 9


def test_answers_before_after_and_never(spark, tmp_path):
    """Mails wait for late answers in state; what comes too late, twice or for nobody changes nothing."""
    parts = "attachments array<struct<att_pos: int, filename: string>>"
    sent = f"message_id string, arrived timestamp, sender string, has_content boolean, parse_ok boolean, {parts}"
    told = "message_id string, att_pos int, answered timestamp, labels array<struct<hit_pos: int, label_pos: int, name: string>>"
    blocked = spark.createDataFrame([(0, "Secret", "Secret found")], "pos int, name string, message string")
    mails, answers, out = tmp_path / "mails", tmp_path / "answers", str(tmp_path / "out")

    def mail_(name, minute, *files):
        return {"message_id": name, "arrived": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", "sender": "a@x", "has_content": True, "parse_ok": True, "attachments": [{"att_pos": i, "filename": f} for i, f in enumerate(files)]}

    def answer(name, pos, minute, *names):
        labels = [{"hit_pos": 0, "label_pos": i, "name": n} for i, n in enumerate(names)]
        return {"message_id": name, "att_pos": pos, "answered": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", "labels": labels}

    def run():
        arriving = [streams.arriving(spark, str(folder), schema) for folder, schema in ((mails, sent), (answers, told))]
        streams.late_label_gate(*arriving, blocked, out, str(tmp_path / "state"), "30 minutes").awaitTermination()

    drop_file(mails, "1.json", [mail_("late", 1, "a", "b"), mail_("never", 2, "c"), mail_("plain", 3), mail_("too late", 4, "d"), mail_("half", 5, "e", "f")])
    drop_file(answers, "1.json", [answer("first", 0, 5, "Secret"), answer("nobody", 0, 5, "Secret"), answer("half", 0, 6, "Fine")])
    run()
    drop_file(mails, "2.json", [mail_("first", 5, "g")])
    drop_file(answers, "2.json", [answer("late", 1, 20, "Fine", "Secret"), answer("late", 0, 21), answer("late", 1, 22, "Secret"), answer("too late", 0, 50, "Secret")])
    run()
    drop_file(mails, "3.json", [mail_("end", 600)])
    drop_file(answers, "3.json", [answer("end", 0, 1200)])
    run()
    run()
    got = {r["message_id"]: (r["code"], r["n_attachments"], r["classification_error"]) for r in spark.read.parquet(out).filter("message_id <> 'end'").collect()}
    want = {"late": (550, 2, False), "never": (250, 1, True), "plain": (250, 0, False), "too late": (250, 1, True), "half": (250, 2, True), "first": (550, 1, False)}
    assert got == want
    assert spark.read.parquet(out).filter("message_id = 'late'").first()["reply"] == "550 Blocked - Secret found in b"


def test_state_of_late_answers(spark, tmp_path, monkeypatch):
    """What waits is a row for each mail and answer, on disk; it is read once, and what leaves it is not taken for next to nothing."""
    mails, answers, out = str(tmp_path / "mails"), str(tmp_path / "answers"), str(tmp_path / "out")
    blocked = spark.createDataFrame([(0, "Secret", "Secret found")], "pos int, name string, message string")
    at = "timestamp_seconds(1700000000 + {})"
    parts = "transform(sequence(0, 9), p -> named_struct('att_pos', p, 'filename', 'f' || p))"
    who = "'s@x' sender, true has_content, true parse_ok"
    sent = spark.range(300).selectExpr("id message_id", f"{at.format('id % 60')} arrived", *who.split(", "), f"{parts} attachments")
    last = spark.range(1).selectExpr("-1L message_id", f"{at.format(86400)} arrived", *who.split(", "), "null attachments")
    sent.union(last).coalesce(1).write.parquet(mails)
    labels_ = "array(named_struct('hit_pos', 0, 'label_pos', 0, 'name', if(id % 2 = 0, 'Secret', 'Fine')))"
    told = spark.range(300).selectExpr("id message_id", "3 att_pos", f"{at.format('id % 60 + 90')} answered", f"{labels_} labels")
    end = spark.range(1).selectExpr("-1L message_id", "0 att_pos", f"{at.format(172800)} answered", f"{labels_} labels")
    told.union(end).coalesce(1).write.parquet(answers)
    plans, gate = [], mail.mail_gate

    def watched(*tables_):
        verdicts = gate(*tables_)
        plans.append(verdicts._jdf.queryExecution().sparkPlan().toString())
        return verdicts

    monkeypatch.setattr(mail, "mail_gate", watched)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before, limit = spark.conf.get(provider, None), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        arriving = [streams.arriving(spark, folder, spark.read.parquet(folder).schema, "parquet") for folder in (mails, answers)]
        query = streams.late_label_gate(*arriving, blocked, out, str(tmp_path / "state"), "1 hour")
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert spark.conf.get(provider, None) == before
    got = spark.read.parquet(out).filter("message_id >= 0").groupBy("code", "n_attachments", "classification_error").count()
    assert rows(got) == [(250, 10, True, 150), (550, 10, True, 150)]
    held = [operator for progress in query.recentProgress for operator in progress.stateOperators]
    assert sum(o.numRowsUpdated for o in held if o.operatorName == "symmetricHashJoin") <= 301 + 301
    assert sum(o.numRowsRemoved for o in held if o.operatorName == "stateStoreSave") == 300
    assert all(any("rocksdb" in name for name in o.customMetrics) for o in held)
    assert "BroadcastHashJoin [message_id" not in plans[-1]


def test_attachments_and_answers_wait_in_files(spark, tmp_path, monkeypatch):
    """State is one narrow row for each mail; mails that are due are decided in shares, with the verdicts they get together."""
    mails, answers, out = str(tmp_path / "mails"), str(tmp_path / "answers"), str(tmp_path / "out")
    blocked = spark.createDataFrame([(0, "Secret", "Secret found")], "pos int, name string, message string")
    parts = "transform(sequence(0, id % 4), p -> named_struct('att_pos', p, 'filename', 'f' || p))"
    sent = spark.range(200).selectExpr("id message_id", "timestamp_seconds(1700000000 + id) arrived", "'s@x' sender", "true has_content", "true parse_ok", f"{parts} attachments")
    last = spark.range(1).selectExpr("-1L message_id", "timestamp_seconds(1700090000) arrived", "'s@x' sender", "true has_content", "true parse_ok", "null attachments")
    sent.union(sent.filter("id = 7")).union(last).coalesce(2).write.parquet(mails)  # one mail comes twice
    labels_ = "array(named_struct('hit_pos', 0, 'label_pos', 0, 'name', if(id % 3 = 0, 'Secret', 'Fine')))"
    told = spark.range(200).selectExpr("id message_id", "explode(sequence(0L, id % 4)) att_pos", "timestamp_seconds(1700000060 + id) answered", f"{labels_} labels")
    end = spark.range(1).selectExpr("-1L message_id", "0L att_pos", "timestamp_seconds(1700200000) answered", f"{labels_} labels")
    told.union(told).union(end).coalesce(2).write.parquet(answers)
    calls, gate = [], mail.mail_gate
    monkeypatch.setattr(mail, "mail_gate", lambda *tables_: calls.append(1) or gate(*tables_))
    monkeypatch.setattr(streams, "DUE_AT_ONCE", 50, raising=False)
    arriving = [streams.arriving(spark, folder, spark.read.parquet(folder).schema, "parquet") for folder in (mails, answers)]
    query = streams.late_label_gate(*arriving, blocked, out, str(tmp_path / "state"), "1 hour")
    query.awaitTermination()
    got = spark.read.parquet(out)
    assert rows(got, "message_id") == sorted([(i,) for i in range(200)], key=repr)
    assert rows(got, "message_id", "code", "classification_error") == sorted([(i, 250 if i % 3 else 550, False) for i in range(200)], key=repr)
    assert got.filter("message_id = 7").first()["n_attachments"] == 8
    held = [operator for progress in query.recentProgress for operator in progress.stateOperators]
    assert sum(operator.numRowsUpdated for operator in held) == 201
    assert len(calls) == 1 + 5  # nothing is due in the first batch, 200 mails in the second


def test_log_of_what_waits(spark, tmp_path):
    """A batch that runs again replaces its rows; what is behind the watermark is dropped, hours that are over are deleted."""
    log, hour = str(tmp_path / "log"), 3_600_000
    schema = (
        "kind string, minute int, message_id string, sender string, has_content boolean, parse_ok boolean, "
        "attachments array<struct<att_pos: int, filename: string>>, att_pos int, labels array<struct<hit_pos: int, label_pos: int, name: string>>"
    )

    def log_batch(number, watermark, *events):
        batch = spark.createDataFrame([(kind, minute, name, "a@x", True, True, [(0, "f")] if kind == "mail" else None, 0, [(0, 0, label)] if label else None) for kind, minute, name, label in events], schema)
        at = F.timestamp_seconds(F.col("minute") * 60)
        batch = batch.select("kind", F.when(F.col("kind") != "answer", at).alias("arrived"), *schema_columns, F.when(F.col("kind") == "answer", at).alias("answered"))
        return streams.log_events(batch, number, log, watermark, "30 minutes")

    schema_columns = ["message_id", "sender", "has_content", "parse_ok", "attachments", "att_pos", "labels"]
    said = lambda kept, number: rows(streams.decided_mails(kept, number, "30 minutes").selectExpr("message_id", "attachments[0].classified found", "attachments[0].labels[0].name name"))
    first = [("mail", 5, "a", None), ("mail", 6, "b", None), ("answer", 4, "b", "before"), ("answer", 7, "a", "A")]
    log_batch(0, 0, *first)
    kept = log_batch(0, 0, *first)  # again, after a crash
    assert kept.count() == 4
    assert said(kept, 0) == []
    # the answer before the mail stands until the watermark is half an hour beyond it, so that later one is a repeated one; another is too late
    kept = log_batch(1, 0, ("answer", 10, "b", "again"), ("answer", 20, "a", "repeated"), ("mail", 50, "c", None), ("answer", 60, "c", "C"))
    kept = log_batch(2, 20 * 60_000, ("mail", 15, "late", None), ("answer", 18, "late", "L"), ("due", 5, "a", None), ("due", 6, "b", None))
    assert said(kept, 2) == [("a", True, "A"), ("b", False, None)]
    assert kept.filter("message_id = 'late'").count() == 0
    kept = log_batch(3, 3 * hour, ("due", 50, "c", None))
    assert said(kept, 3) == []  # a mail whose hour is over has been decided before
    assert rows(kept.filter("hour = 0")) == []


def test_answer_after_one_that_no_longer_stands(spark, tmp_path):
    """An answer for an attachment counts again when the watermark is past the time of the one before."""
    log = str(tmp_path / "log")
    sent = "kind string, arrived timestamp, message_id string, sender string, has_content boolean, parse_ok boolean, attachments array<struct<att_pos: int, filename: string>>"
    told = "kind string, message_id string, att_pos int, answered timestamp, labels array<struct<hit_pos: int, label_pos: int, name: string>>"
    at = lambda minute: f"timestamp_seconds({minute * 60})"
    empty = spark.createDataFrame([], sent).unionByName(spark.createDataFrame([], told), allowMissingColumns=True)
    answer = lambda minute, name: spark.range(1).selectExpr("'answer' kind", "'m' message_id", "0 att_pos", f"{at(minute)} answered", f"array(named_struct('hit_pos', 0, 'label_pos', 0, 'name', '{name}')) labels")
    mail_ = lambda kind: spark.range(1).selectExpr(f"'{kind}' kind", f"{at(45)} arrived", "'m' message_id", "'s' sender", "true has_content", "true parse_ok", "array(named_struct('att_pos', 0, 'filename', 'f')) attachments")
    for number, watermark, rows_ in ((0, 0, answer(10, "old")), (1, 30, answer(46, "no")), (2, 40, answer(50, "yes").unionByName(mail_("mail"), allowMissingColumns=True)), (3, 50, mail_("due"))):
        kept = streams.log_events(empty.unionByName(rows_, allowMissingColumns=True), number, log, watermark * 60_000, "30 minutes")
    got = streams.decided_mails(kept, 3, "30 minutes").selectExpr("attachments[0].labels[0].name name")
    assert rows(got) == [("yes",)]
