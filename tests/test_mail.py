from email.message import EmailMessage

import pytest
from conftest import rows

from custodia.operators import mail


def message(*attachments, text="see attached"):
    mail_out = EmailMessage()
    mail_out["From"], mail_out["To"], mail_out["Subject"] = "a@example.com", "b@example.com", "Reports"
    mail_out.set_content(text)
    for name, content in attachments:
        mail_out.add_attachment(content, maintype="application", subtype="octet-stream", filename=name)
    return mail_out.as_bytes()


def test_attachments(spark):
    data = [
        ("none", message()),
        ("one", message(("company_report.txt", b"fine"))),
        ("two", message(("patient_data.txt", b"x"), ("financial_projections.xlsx", b"\x00\x01"))),
        ("empty", message(("empty.txt", b""), ("full.txt", b"y"))),
        ("garbage", b"\xff\xfe not mail"),
        ("missing", None),
    ]
    raw = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in data], "path string, content binary")
    got = rows(mail.extract_attachments(raw), "message_id", "pos", "filename")
    assert got == [
        ("empty", 0, "full.txt"), ("one", 0, "company_report.txt"), ("two", 0, "patient_data.txt"), ("two", 1, "financial_projections.xlsx"),
    ]
    parsed = {r["message_id"]: r for r in mail.parse_messages(raw).collect()}
    assert parsed["one"]["subject"] == "Reports" and parsed["one"]["sender"] == "a@example.com"
    assert parsed["missing"]["parse_ok"] is False and parsed["garbage"]["parse_ok"] is True
    assert bytes(parsed["two"]["attachments"][1]["content"]) == b"\x00\x01"


@pytest.fixture
def blocked(spark):
    return spark.createDataFrame([(0, "sensitive", "old text"), (1, "sensitive", "Sensitive data"), (2, "itar", "ITAR")], "pos int, name string, message string")


LABELS = "message_id string, att_pos int, hit_pos int, label_pos int, name string"


def test_first_blocked_label(spark, blocked):
    labels = spark.createDataFrame(
        [("m", 1, 0, 0, "itar", "b"), ("m", 0, 1, 0, "sensitive", "a"), ("m", 0, 0, 1, "safe", "a"), ("m", 0, 1, 1, "itar", "a"), ("n", 0, 0, 0, "safe", "c")],
        LABELS + ", filename string",
    )
    assert rows(mail.first_blocked(labels, blocked)) == [("m", 0, "a", "sensitive", "Sensitive data")]


def test_verdicts(spark, blocked):
    messages = spark.createDataFrame(
        [(m, sender, content, ok) for m, sender, content, ok in [
            ("plain", "s@x", True, True), ("safe", "s@x", True, True), ("bad", "s@x", True, True), ("mixed", "s@x", True, True),
            ("failing", "s@x", True, True), ("nosender", "", True, True), ("nocontent", "s@x", False, True), ("broken", "s@x", True, False),
            ("second", "s@x", True, True), ("null", None, True, True),
        ]],
        "message_id string, sender string, has_content boolean, parse_ok boolean",
    )
    attachments = spark.createDataFrame(
        [("safe", 0, "s.txt", False), ("bad", 0, "b.txt", None), ("mixed", 0, "ok.txt", False), ("mixed", 1, "no.txt", False),
         ("failing", 0, "f.txt", True), ("nosender", 0, "b.txt", False), ("broken", 0, "b.txt", False),
         ("second", 0, "f.txt", True), ("second", 1, "g.txt", False)],
        "message_id string, att_pos int, filename string, classification_error boolean",
    )
    bad = [("bad", 0), ("mixed", 1), ("failing", 0), ("nosender", 0), ("broken", 0), ("second", 0), ("second", 1)]
    labels = spark.createDataFrame([(m, p, 0, 0, "sensitive") for m, p in bad] + [("safe", 0, 0, 0, "fine")], LABELS)
    got = {r["message_id"]: r for r in mail.mail_gate(messages, attachments, labels, blocked).collect()}
    assert {k: v["code"] for k, v in got.items()} == {
        "plain": 250, "safe": 250, "bad": 550, "mixed": 550, "failing": 250, "nosender": 501, "nocontent": 501, "broken": 451,
        "second": 550, "null": 501,
    }
    assert got["mixed"]["reply"] == "550 Blocked - Sensitive data in no.txt"
    assert got["second"]["reply"].endswith("in g.txt") and got["second"]["classification_error"]
    assert got["failing"]["classification_error"] and not got["safe"]["classification_error"]
    open_gate = mail.mail_gate(messages, attachments, labels, blocked.limit(0))
    assert open_gate.filter("code = 550").count() == 0


def test_labels_are_not_dealt_by_name(spark, blocked):
    """Few names are shared by all labels: a shuffle by name would put them into as many tasks."""
    labels = spark.range(4000).selectExpr("cast(id as string) message_id", "0 att_pos", "0 hit_pos", "0 label_pos", "'f' filename", "if(id % 2 = 0, 'sensitive', 'itar') name")
    messages = spark.range(4000).selectExpr("cast(id as string) message_id", "'s@x' sender", "true has_content", "true parse_ok")
    attachments = labels.select("message_id", "att_pos", "filename").selectExpr("*", "false classification_error")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables too large to be broadcast
    try:
        for found in (mail.first_blocked(labels, blocked), mail.mail_gate(messages, attachments, labels.drop("filename"), blocked)):
            plan = found._jdf.queryExecution().sparkPlan().toString()
            assert "SortMergeJoin [name#" not in plan
            assert found.count() == 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
