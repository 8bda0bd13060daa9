"""Tokens, chunks and previews. A token is a word with the white space before it, so that
tokens put together give the text back unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wire
from .values import WHITESPACE

SPACE, WORD = r"[ \t\n\r\f\x0B]", r"[^ \t\n\r\f\x0B]"
TOKEN = rf"{SPACE}*+{WORD}++(?:{SPACE}++\z)?+"  # possessive: nothing is tried twice

Tokenizer = Callable[[Column], Column]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column, tokenizer: Tokenizer = tokens) -> Column:
    return F.size(tokenizer(text)).cast("bigint")


def truncate_tokens(text: Column, limit: int, tokenizer: Tokenizer = tokens) -> Column:
    """The text up to its ``limit``-th token; short texts stay unchanged."""
    words = tokenizer(text)
    return F.when(F.size(words) <= limit, text).otherwise(F.array_join(F.slice(words, 1, limit), ""))


def preview(text: Column, chars: int = wire.PREVIEW_CHARS) -> Column:
    return F.substring(text, 1, chars)


def is_blank(text: Column) -> Column:
    """No character but white space; looks only as far as the first other one."""
    return ~F.coalesce(text.rlike(f"[^{WHITESPACE}]"), F.lit(False))


def joined_groups(groups: Column) -> Column:
    return F.coalesce(F.array_join(groups, ","), F.lit(""))
