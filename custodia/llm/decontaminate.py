"""Benchmark decontamination: a prefix-filtered set join of item windows with whole documents.

A window is ``window`` consecutive words of an item, or the whole item if it is shorter; it is a set of
positional shingles of ``shingle`` words (fewer if the window is shorter). A document holds a window
exactly if it holds all its shingles in place, so for containment 1 the necessary prefix is a single
shingle: the window's rarest one over the whole corpus. Documents are joined on those shingles alone,
length and position bounds come next, and the words of each remaining pair are compared.

Defined results. Null or empty texts have no words and are never hit. Items without words or without an id are
left out. Repeated item rows and equal windows count once; rows of documents are judged one by one, so repeated or
null ids keep their rows. Extra columns are ignored. Ties in rarity fall to the smaller hash. Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import plain_words, union_length
from custodia.session import checkpointed

WINDOW = 10
SHINGLE = 5
#: Bits of the map that spares documents' shingles the join; its size never grows with the benchmark.
MAP_BITS = 1 << 20


def bit_map(hashes: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """One row with an array of ``bits / 64`` numbers that has a bit set for each hash (column ``hash``)."""
    slot = F.pmod("hash", F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int"))
    held = hashes.select((slot / 64).cast("bigint").alias("place"), one.alias("bit"))
    held = held.groupBy("place").agg(F.bit_or("bit").alias("word"))
    places = hashes.sparkSession.range(bits // 64).withColumnRenamed("id", "place")
    filled = places.join(held, "place", "left").select(F.struct("place", F.coalesce("word", F.lit(0)).alias("word")).alias("s"))
    return filled.agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["word"]).alias("words"))


def in_map(words: Column, value: Column, bits: int = MAP_BITS) -> Column:
    """Whether the bit of ``value`` is set; a few others may be set too, so an exact join has to follow."""
    slot = F.pmod(value, F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int"))
    return F.get(words, (slot / 64).cast("int")).bitwiseAND(one) != 0


def hash_at(hashes: str, start: Column, size: int) -> Column:
    """Hash of the shingle of ``size`` words that begins at 0-based ``start``."""
    return F.xxhash64(*[F.get(hashes, start + k) for k in range(size)])


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``(window_id, words)`` and their items ``(window_id, item)``."""
    n = F.size("w")
    read = items.select(F.col(item_id).cast("string").alias("item"), plain_words(F.col(text)).alias("w"))
    cut = (
        read.filter((n > 0) & F.col("item").isNotNull())
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))))
        .select("item", F.slice("w", F.col("at"), window).alias("words"))
    )
    # two hashes with different beginnings name a window; items and windows are few next to documents
    cut = checkpointed(cut.withColumn("window_id", F.sha2(F.array_join("words", " "), 256)).distinct())
    return cut.select("window_id", "words").distinct(), cut.select("window_id", "item").distinct()


def shingles_of(docs: DataFrame, sizes: list[int], keep, *others: str, and_rows: bool = False) -> DataFrame:
    """Rows ``(others..., w, at, size, hash)`` for the shingles (1-based ``at``) that ``keep`` lets pass.

    ``explode`` over positions instead of a lambda: it stays in generated code, and only what passes is copied.
    ``and_rows`` adds one row ``at = 0`` for each document.
    """
    with_hashes = docs.select(*others, "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    parts = []
    for size in sizes:
        first = -1 if and_rows and size == sizes[0] else 0
        none = F.sequence(F.lit(first), F.lit(-1)) if first else F.array().cast("array<int>")
        at = F.explode(F.when(F.size("h") >= size, F.sequence(F.lit(first), F.size("h") - size)).otherwise(none))
        rows = with_hashes.withColumn("at", at).select(
            *others, "w", (F.col("at") + 1).alias("at"), F.lit(size).alias("size"), hash_at("h", F.col("at"), size).alias("hash")
        )
        kept = keep(F.col("hash"))
        parts.append(rows.filter((F.col("at") == 0) | kept if first else kept))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, occurrences, window_items)``: documents with a ``row`` number and ``n_words`` in place of their text;
    each exact occurrence of a window as ``(row, start, end, window_id)``; and the items of each window."""
    windows, window_items = item_windows(items, item_id, item_text, window)
    size = F.least(F.size("words"), F.lit(shingle))
    windows = checkpointed(windows.withColumn("size", size))
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect()) or [shingle]  # at most ``shingle`` numbers
    own = shingles_of(
        windows.withColumnRenamed("words", "w").withColumnRenamed("size", "own_size"), sizes, lambda h: F.lit(True), "window_id", "own_size"
    ).filter(F.col("size") == F.col("own_size"))
    own = checkpointed(own.select("window_id", "size", "at", "hash"))

    # Rarity: how often each of these shingles occurs in all documents.
    others = [f"_{c}" for c in docs.columns if c != text]  # an own name space, so that no column clashes with ours
    words = docs.select(*[F.col(f"`{c[1:]}`").alias(c) for c in others], plain_words(F.col(text)).alias("w"))
    known = bit_map(own.select("hash").distinct())
    seen = shingles_of(words.select("w"), sizes, lambda h: in_map(known.scalar(), h)).groupBy("hash").agg(F.count("*").alias("df"))
    ranked = own.join(seen, "hash")  # a window with a shingle that no document has can't occur; the count below drops it
    needed = ranked.groupBy("window_id").agg(
        F.min(F.struct("df", "hash", "at", "size")).alias("rarest"), F.count("*").alias("found")
    )
    total = own.groupBy("window_id").agg(F.count("*").alias("shingles"))
    prefix = needed.join(total, "window_id").filter(F.col("found") == F.col("shingles"))
    prefix = prefix.join(windows.select("window_id", "words"), "window_id")
    prefix = checkpointed(prefix.select("window_id", "words", "rarest.hash", F.col("rarest.at").alias("offset")))

    # Documents' side, one scan: the words around a shingle travel with it, so no text is shuffled. Written
    # once, rows and shingles have the same row numbers whatever is run again later.
    wanted = bit_map(prefix.select("hash").distinct())
    near_at = F.greatest(F.col("at") - (window - 1), F.lit(1))
    near = F.when(F.col("at") > 0, F.slice("w", near_at, 2 * window))
    numbered = words.withColumn("row", F.monotonically_increasing_id())
    scanned = shingles_of(numbered, sizes, lambda h: in_map(wanted.scalar(), h), "row", *others, and_rows=True)
    scanned = scanned.select("row", *others, "at", "hash", near_at.alias("near_at"), near.alias("near"), F.size("w").alias("n_words"))
    scanned = checkpointed(scanned)
    rows = scanned.filter(F.col("at") == 0).select("row", *others, "n_words")
    found = scanned.filter(F.col("at") > 0).select("row", "at", "hash", "near_at", "near", "n_words")
    start = F.col("at") - F.col("offset") + 1
    pairs = found.join(prefix, "hash").withColumn("start", start).withColumn("end", start + F.size("words") - 1)
    placed = pairs.filter((F.col("start") >= 1) & (F.col("end") <= F.col("n_words")))
    same = F.slice("near", F.col("start") - F.col("near_at") + 1, F.size("words")) == F.col("words")
    return rows, placed.filter(same).select("row", "start", "end", "window_id"), window_items


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without the text, with ``n_words, n_hit, n_items, items (array), contaminated``.

    Columns of ``docs`` with one of these names are left out."""
    rows, occurrences, window_items = leaks(docs, items, text, **options)
    others = [c for c in docs.columns if c not in (text, "n_words", "n_hit", "n_items", "items", "contaminated")]
    occurrences = checkpointed(occurrences)
    span = F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))
    hit = occurrences.groupBy("row").agg(union_length(F.collect_set(span)).alias("n_hit"))
    named = occurrences.select("row", "window_id").distinct().join(window_items, "window_id")
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.join(hit, "row", "left").join(named, "row", "left").drop("row")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    named_items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        *[F.col(f"`_{c}`").alias(c) for c in others],
        F.col("n_words").cast("bigint").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(named_items).cast("bigint").alias("n_items"),
        named_items.alias("items"),
        (n_hit > 0).alias("contaminated"),
    )
