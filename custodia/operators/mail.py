"""Gating mail on the labels of its attachments."""

from __future__ import annotations

import email
from collections.abc import Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import wire

PARTS = "pos int, filename string, content binary"
MESSAGES = (
    "message_id string, sender string, recipients string, subject string, header_id string, date string, "
    f"has_content boolean, parse_ok boolean, attachments array<struct<{PARTS.replace(' ', ':').replace(',:', ',')}>>"
)


def blocked_messages(blocked: DataFrame) -> DataFrame:
    """One message per blocked label; of a label listed twice the last line (``pos``) counts."""
    return blocked.groupBy("name").agg(F.max_by("message", "pos").alias("message"))


def first_blocked(labels: DataFrame, blocked: DataFrame) -> DataFrame:
    """The first blocked label of each message, in attachment, hit and label order.

    ``labels``: message_id, att_pos, hit_pos, label_pos, filename, name. A message with very many
    labels is reduced to one row per task before the shuffle. ``blocked`` is configuration and is broadcast, as labels share very
    few names: dealt by name, one task would get most of them.
    """
    found = labels.join(F.broadcast(blocked_messages(blocked)), "name")
    first = F.min_by(
        F.struct("att_pos", "filename", "name", "message"), F.struct("att_pos", "hit_pos", "label_pos")
    )
    return found.groupBy("message_id").agg(first.alias("first")).select("message_id", "first.*")


def mail_gate(messages: DataFrame, attachments: DataFrame, labels: DataFrame, blocked: DataFrame) -> DataFrame:
    """Code and reply for every message.

    ``messages``: message_id, sender, has_content, parse_ok. ``attachments``: message_id, att_pos,
    filename, classification_error. ``labels``: message_id, att_pos, hit_pos, label_pos, name.
    An attachment whose classification failed does not block (``classification_error`` says so),
    and neither does any label when nothing is listed as blocked.
    """
    per_message = attachments.groupBy("message_id").agg(
        F.count("*").alias("n_attachments"),
        F.max(F.coalesce("classification_error", F.lit(False))).alias("classification_error"),
    )
    sound = attachments.filter("NOT coalesce(classification_error, false)").select("message_id", "att_pos", "filename")
    named = labels.select("message_id", "att_pos", "hit_pos", "label_pos", "name")
    suspect = named.join(F.broadcast(blocked.select("name").distinct()), "name", "left_semi")
    verdicts = first_blocked(suspect.join(sound, ["message_id", "att_pos"]), blocked)
    joined = messages.join(per_message, "message_id", "left").join(verdicts, "message_id", "left")

    broken = ~F.coalesce("parse_ok", F.lit(False))
    no_origin = (F.coalesce("sender", F.lit("")) == "") | ~F.coalesce("has_content", F.lit(False))
    blocked_here = F.col("n_attachments").isNotNull() & F.col("message").isNotNull()
    refusal = F.format_string(wire.MAIL_BLOCKED, "message", "filename")
    reply = (
        F.when(broken, wire.MAIL_ERROR)
        .when(no_origin, wire.MAIL_SYNTAX)
        .when(blocked_here, refusal)
        .otherwise(wire.MAIL_ACCEPTED)
    )
    return joined.select(
        "message_id",
        F.left(reply, F.lit(3)).cast("int").alias("code"),
        reply.alias("reply"),
        F.coalesce("n_attachments", F.lit(0)).cast("bigint").alias("n_attachments"),
        F.coalesce("classification_error", F.lit(False)).alias("classification_error"),
    )


def parse_messages(raw: DataFrame, ident: str = "path", content: str = "content") -> DataFrame:
    """Raw mail bytes to header fields and attachments, one row per message.

    An attachment is a part of a multipart message with an ``attachment`` disposition, a file name
    and a payload that is not empty.
    """
    return raw.select(F.col(ident).alias("message_id"), F.col(content).alias("content")).mapInPandas(_parse, MESSAGES)


def extract_attachments(raw: DataFrame, ident: str = "path", content: str = "content") -> DataFrame:
    """One row per attachment: ``message_id, pos, filename, content``."""
    parsed = parse_messages(raw, ident, content)
    return parsed.select("message_id", F.inline("attachments"))


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["message_id", "sender", "recipients", "subject", "header_id", "date", "has_content", "parse_ok", "attachments"]
    for batch in batches:
        for some in batched(zip(batch["message_id"], batch["content"]), 16):  # a few messages leave at a time
            yield pd.DataFrame([_parse_one(ident, data) for ident, data in some], columns=names)


def _parse_one(ident: str, data: bytes | None) -> tuple:
    if data is None:
        return ident, None, None, None, None, None, False, False, []
    try:
        message = email.message_from_bytes(bytes(data))
        headers = [str(message.get(name, "")) for name in ("From", "To", "Subject", "Message-ID", "Date")]
        return ident, *headers, len(data) > 0, True, list(_attachments(message))
    except Exception:
        return ident, None, None, None, None, None, len(data) > 0, False, []


def _attachments(message: email.message.Message) -> Iterator[dict]:
    pos = 0
    for part in message.walk() if message.is_multipart() else ():
        wanted = part.get_content_maintype() != "multipart" and "attachment" in str(part.get("Content-Disposition", ""))
        name = part.get_filename() if wanted else None
        content = _payload(part) if name else None
        if content:
            yield {"pos": pos, "filename": name, "content": content}
            pos += 1


def _payload(part: email.message.Message) -> bytes | None:
    try:
        return part.get_payload(decode=True)
    except Exception:
        return None
