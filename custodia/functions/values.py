"""Typing of loose values: strings and VARIANTs to typed columns, bad input to NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wire import FALSE_WORDS, TRUE_WORDS

# Characters stripped around a string value.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def str_or_null(text: Column) -> Column:
    """Trimmed text; blank becomes NULL."""
    return F.nullif(strip(text), F.lit(""))


def bool_or_null(text: Column) -> Column:
    """Words for yes and no, in any case; anything else is NULL."""
    word = F.lower(strip(text))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def int_or_null(text: Column) -> Column:
    """Whole numbers only: no fractions, blanks or words."""
    digits = strip(text)
    return F.when(digits.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(digits, F.lit("_"), F.lit("")).try_cast("bigint"))


def first_truthy(*columns: Column) -> Column:
    """First value that is neither NULL nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def parse_list(text: Column) -> Column:
    """Comma list to an array: items trimmed, blanks dropped, NULL gives an empty array."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip)
    return F.filter(items, lambda item: item != "")


def parse_int_list(text: Column) -> Column:
    """Comma list of whole numbers; one bad item makes the whole list empty."""
    numbers = F.transform(parse_list(text), int_or_null)
    return F.when(F.exists(numbers, lambda n: n.isNull()), F.array().cast("array<bigint>")).otherwise(numbers)


# --- VARIANT values -------------------------------------------------------------------------


def field(record: Column, key: str, kind: str = "variant") -> Column:
    """One key of an open record; NULL when missing or of another kind."""
    return F.try_variant_get(record, "$['" + key.replace("'", "\\'") + "']", kind)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _whole(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def variant_text(value: Column) -> Column:
    """Text of any value, untrimmed: booleans capitalised, nested values as JSON."""
    text = _whole(value, "string")
    return F.when(_kind(value) == "BOOLEAN", F.initcap(text)).otherwise(text)


def variant_str(value: Column) -> Column:
    text = variant_text(value)
    return F.when(_kind(value) == "STRING", str_or_null(text)).otherwise(text)


def variant_int(value: Column) -> Column:
    """Numbers truncate, booleans count as 0 or 1, strings must be whole numbers."""
    return F.when(_kind(value) == "STRING", int_or_null(_whole(value, "string"))).otherwise(_whole(value, "bigint"))


def variant_bool(value: Column) -> Column:
    """Booleans and words; numbers are not booleans."""
    return F.when(_kind(value) == "BOOLEAN", _whole(value, "boolean")).when(
        _kind(value) == "STRING", bool_or_null(_whole(value, "string"))
    )


def variant_str_array(value: Column) -> Column:
    """A list becomes its items as text, a string a one-item list, anything else an empty list."""
    items = F.transform(_whole(value, "array<variant>"), lambda v: F.coalesce(variant_text(v), F.lit("None")))
    return (
        F.when(_kind(value).startswith("ARRAY"), items)
        .when(_kind(value) == "STRING", F.array(_whole(value, "string")))
        .otherwise(F.array().cast("array<string>"))
    )


def prefixed_json(record: Column, prefixes: list[str]) -> Column:
    """The entries whose key starts with one of ``prefixes``, as JSON; NULL when there are none."""
    entries = F.map_filter(
        _whole(record, "map<string,variant>"),
        lambda key, _: _any_prefix(key, prefixes),
    )
    return F.when(F.size(entries) > 0, F.to_json(entries))


def _any_prefix(key: Column, prefixes: list[str]) -> Column:
    test = key.startswith(prefixes[0])
    for prefix in prefixes[1:]:
        test = test | key.startswith(prefix)
    return test


def entitled_emails(items: Column) -> Column:
    """E-mails of an array of JSON strings; entries that do not parse or name no e-mail are skipped."""
    emails = F.transform(items, lambda item: F.try_variant_get(F.try_parse_json(item), "$.email", "string"))
    return F.coalesce(F.filter(emails, lambda e: e.isNotNull() & (e != "")), F.array().cast("array<string>"))


def entitled_emails_struct(items: Column) -> Column:
    """The same for an array of structs with an ``email`` field."""
    emails = F.transform(items, lambda item: item["email"])
    return F.coalesce(F.filter(emails, lambda e: e.isNotNull() & (e != "")), F.array().cast("array<string>"))


def variant_entitled_emails(value: Column) -> Column:
    """The same for a VARIANT list whose items are JSON strings or objects."""

    def email(item: Column) -> Column:
        entry = F.when(_kind(item) == "STRING", F.try_parse_json(_whole(item, "string"))).otherwise(item)
        return F.try_variant_get(entry, "$.email", "string")

    emails = F.transform(_whole(value, "array<variant>"), email)
    return F.coalesce(F.filter(emails, lambda e: e.isNotNull() & (e != "")), F.array().cast("array<string>"))


def extracted_attr(document: Column, attribute: str) -> Column:
    """One attribute of a JSON string; NULL when the string does not parse."""
    return F.try_variant_get(F.try_parse_json(document), "$['" + attribute + "']", "string")
