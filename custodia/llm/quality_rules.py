"""Quality rules: plain counts of a text, and a hashed n-gram log-likelihood ratio that decides on it.

Words and word pairs of all documents are hashed into ``buckets``; one multinomial is counted over the trusted
documents, one over the whole raw corpus. A document's score is the sum of ``ln(p_trusted / p_raw)`` over its
n-grams, divided by their number. Every document is compared with the same threshold; nothing is drawn at random.
Ratios are whole millionths, so sums don't depend on the order of rows.

Defined results. Null and empty texts have no words and fail the base rules. Without a trusted document all ratios are 0.
Trusted ids that are null or repeated count once at most; repeated documents are judged one by one. Extra columns pass
through unless one of the results has their name. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import union_length
from custodia.llm.decontaminate import bit_map, in_map
from custodia.session import checkpointed

BUCKETS = 1 << 14
#: Smallest and largest map of trusted ids, in bits.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 24
#: Mean log ratio (in nats) a document needs.
THRESHOLD = -0.05
SMOOTHING = 1.0
MILLION = 1_000_000
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_ratio", "base_failed", "kept"]


def spaced_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _pairs(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))


def _from(values: Column, start: int) -> Column:
    return F.slice(values, start, F.greatest(F.size(values), F.lit(1)))


def windows_of(hashes: Column) -> Column:
    """64-bit hashes of the five-word windows, from the words' 64-bit hashes."""
    two = _pairs(hashes, _from(hashes, 2))
    four = _pairs(two, _from(two, 3))
    return F.slice(_pairs(four, _from(hashes, REPEAT_WINDOW)), 1, F.greatest(F.size(hashes) - REPEAT_WINDOW + 1, F.lit(0)))


def repeated_words(windows: Column) -> Column:
    """Number of words inside windows that the text holds twice or more.

    Most texts have no equal windows, which ``array_distinct`` finds out; only the others are sorted.
    """
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # neighbours in the order of hashes, side by side
    beside = F.arrays_zip(
        F.concat(none, ordered).alias("before"), F.concat(ordered, none).alias("own"), F.concat(_from(ordered, 2), none, none).alias("after")
    )
    equal = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    again = F.filter(beside, lambda z: equal(z["before"], z["own"]) | equal(z["own"], z["after"]))
    start = lambda z: (z["own"]["i"] + 1).cast("bigint")
    spans = F.transform(again, lambda z: F.struct(start(z).alias("start"), (start(z) + REPEAT_WINDOW - 1).alias("end")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(union_length(spans)).cast("bigint")


def base_counts(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` without the text, with the base counts and ``h``, the hashes of the words."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    others = [F.col(f"`{c}`").alias(f"_{c}") for c in docs.columns if c != text and c not in RESULTS]
    lines = F.filter(F.split(body, "\n"), lambda line: F.translate(line, SPACES, "") != "")
    read = docs.select(
        *others,
        F.transform(spaced_words(body), lambda w: F.xxhash64(w)).alias("h"),
        F.length(F.translate(body, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
    )
    counted = read.withColumn("n_words", F.size("h").cast("bigint"))
    counted = counted.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"))
    counted = counted.withColumn("windows", windows_of(F.col("h")))
    return counted.withColumn("n_repeat_words", repeated_words(F.col("windows"))).drop("lines", "windows")


def _buckets(rows: DataFrame, buckets: int, *others: str) -> DataFrame:
    """A row ``(others..., bucket)`` for each word and each pair of neighbours."""
    n = F.size("h")
    at = rows.select(*others, "h", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("at"))
    one = F.pmod(F.get("h", F.col("at")), F.lit(buckets))
    two = F.when(F.col("at") + 1 < n, F.pmod(F.xxhash64(F.get("h", F.col("at")), F.get("h", F.col("at") + 1)), F.lit(buckets)))
    pair = at.select(*others, one.alias("one"), two.alias("two"))
    return pair.select(*others, F.explode(F.array("one", "two")).alias("bucket")).filter(F.col("bucket").isNotNull())


def ratios(docs: DataFrame, trusted: DataFrame, doc_id: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, raw, target, ratio)``: counts in the corpus and in trusted documents, log ratio in millionths.

    ``trusted`` has the trusted ids in its first column; all of them are counted. A bit map keeps other documents out of the join
    that finds them; its size follows the number of ids, and it decides nothing.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    ids = trusted.select(F.col(trusted.columns[0]).cast(docs.schema[doc_id].dataType).alias("id")).filter(F.col("id").isNotNull()).distinct()
    ids = checkpointed(ids)
    bits = min(max(LEAST_BITS, 1 << (16 * ids.count()).bit_length()), MOST_BITS)
    known = bit_map(ids.select(F.xxhash64("id").alias("hash")), bits)
    words = lambda: F.transform(spaced_words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")
    raw = _buckets(rows.select(words()), buckets).groupBy("bucket").agg(F.count("*").alias("raw"))
    # only texts whose id may be trusted are shuffled, as they are: the hashes of their words would be larger
    met = rows.filter(in_map(known.scalar(), F.xxhash64("id"), bits)).join(ids.hint("merge"), "id")
    target = _buckets(met.select(words()), buckets).groupBy("bucket").agg(F.count("*").alias("target"))
    all_buckets = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    full = checkpointed(all_buckets.join(raw, "bucket", "left").join(target, "bucket", "left").fillna(0, ["raw", "target"]))
    sums = full.agg(F.sum("raw").alias("raw_all"), F.sum("target").alias("target_all"))
    share = lambda n, total: F.ln((F.col(n) + SMOOTHING) / (F.col(total) + SMOOTHING * buckets))
    ratio = F.when(F.col("target_all") > 0, F.round((share("target", "target_all") - share("raw", "raw_all")) * MILLION)).otherwise(0)
    totals = full.withColumns({"raw_all": sums.select("raw_all").scalar(), "target_all": sums.select("target_all").scalar()})
    return totals.select("bucket", "raw", "target", ratio.cast("bigint").alias("ratio"))


def judged(docs: DataFrame, ratio_table: DataFrame, text: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without the text, with the columns of ``RESULTS``."""
    counted = base_counts(docs, text).withColumn("row", F.monotonically_increasing_id())
    others = [c for c in counted.columns if c != "h"]
    model = ratio_table.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "ratio"))), lambda s: s["ratio"]).alias("m"))
    n = F.size("h")
    # position -1 keeps documents without words; both ratios of a position are added up before the aggregate
    at = counted.select(*others, "h", F.explode(F.sequence(F.lit(-1), n - 1)).alias("at"))
    here = lambda bucket: F.get("m", F.pmod(bucket, F.lit(buckets)).cast("int"))
    first, second = F.get("h", F.col("at")), F.get("h", F.col("at") + 1)
    one = F.when(F.col("at") >= 0, here(first)).otherwise(F.lit(0).cast("bigint"))
    two = F.when((F.col("at") >= 0) & (F.col("at") + 1 < n), here(F.xxhash64(first, second))).otherwise(F.lit(0).cast("bigint"))
    points = at.withColumn("m", model.scalar()).select(*others, (one + two).alias("points"))
    # a document's rows lie next to each other, so the partial sums leave one row a document for the shuffle
    summed = points.groupBy(*others).agg(F.sum("points").alias("points"))
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    mean = F.col("points") / grams / MILLION
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = summed.withColumns({"mean_ratio": mean, "base_failed": failed, "kept": ~failed & (mean >= threshold)})
    own = [F.col(f"`{c}`").alias(c[1:]) for c in others if c.startswith("_")]
    return out.select(*own, *RESULTS)
