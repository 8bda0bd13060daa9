"""Line dedup: equal lines, and lines within a few edits of an earlier one, by a segment-partition edit join.

A line is cut into ``max_edits + 1`` segments. A line within ``max_edits`` edits of it holds one of these segments
unchanged, at a place that the lengths and the edits before and after it allow. Each line is an index entry for its own
segments and length, and probes the segments of lines up to ``max_edits`` shorter. Lines that share a key are compared:
letter counts first (an edit changes few), then the edit distance, by a band of ``2 * max_edits + 1`` diagonals whose
reachable cells are the bits of one number for each count of edits.

Lines are ordered by document id and line number. A line goes if an equal one stands earlier, or one within
``max_edits`` edits whose text is another. Keys and equal lines are counted by hash, with partial aggregates before the
shuffle. In each bucket of lines all are first compared with the earliest ones; only those still unlinked meet the rest of the
bucket, so a bucket of lines that resemble each other isn't listed pair by pair. Only the texts of lines that share a
key are shuffled. Equality is that of 128 hash bits, that of lines compared by edits is their text's.

Defined results. Null texts have no lines; blank lines always stay and never count. Lines below ``min_chars`` characters are only
compared for equality. Null ids come last. Rows with equal ids and texts are one document, and their lines go or stay alike;
of rows with equal ids and other texts, equal line numbers are one place, where the smaller line is the earlier one. Ids are integers. Extra columns
pass through ``deduplicated`` and are ignored elsewhere. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.llm.decontaminate import bit_map, in_map
from custodia.llm.quality_rules import SPACES
from custodia.session import checkpointed

MAX_EDITS = 2
MIN_CHARS = 24
MAP_BITS = 1 << 22
#: Letters counted together by the filter before the edit distance; others only count in the length.
CLASSES = ("eéèêE", "aáàâäA", "oóòôöO", "iíìîI", "tT", "nñN", "sS", "rR", "dD", "uúùûüU", " ", "hH", "lL", "cçC")
#: Neighbouring letters counted by the same filter, of two different letters each, so that none overlaps itself.
NEIGHBOURS = (
    "th", "he", "er", "re", "an", "nd", "on", "in", "en", "ti", "es", "st", "ed", "ou", "nt", "ea", "ha", "at", "or", "ng",
    "le", "ly", "sh", "ei", "ie", "ch", "un", "ge", "be", "qu", "el", "au", "eu", "ci", "os", "as", "ue", "do", "ai", "it",
)
PLACE = "decimal(38,0)"


def filled(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES)) != ""


def line_rows(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    """``(id, line_no, line, more...)`` for the lines that aren't blank."""
    body = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), *more, F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    return rows.filter(filled(F.col("line")))


def place_of(doc_id: Column, line_no: Column) -> Column:
    """Order of all lines in one number."""
    document = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    return (document * F.lit(1 << 31).cast("decimal(10,0)") + line_no.cast("decimal(10,0)")).cast(PLACE)


def first_hash(line: Column) -> Column:
    return F.xxhash64(line)


def second_hash(line: Column) -> Column:
    return F.xxhash64(F.lit(29), line)


def segment(length: Column, number: Column, edits: int) -> tuple[Column, Column]:
    """1-based start and length of a segment (``number`` from 0) of lines of this length; later ones take the remainder."""
    parts = edits + 1
    longer = length % parts
    base = ((length - longer) / parts).cast("int")
    ahead = F.greatest(number - (F.lit(parts) - longer), F.lit(0))  # longer segments before this one
    return base * number + ahead + 1, base + F.when(number >= F.lit(parts) - longer, 1).otherwise(0)


def wide(line: Column) -> Column:
    """A line in four bytes a character, so that a segment is found without walking through the text."""
    return F.encode(line, "UTF-32")


def key_rows(lines: DataFrame, edits: int) -> DataFrame:
    """``lines`` with a row for each ``key`` of their ``wide`` text; ``entry`` is 1 for index entries and 0 for probes.

    The kinds of keys are exploded before the keys are made: one short expression is compiled well, a dozen aren't.
    """
    kinds = []
    for shorter in range(edits + 1):
        for number in range(edits + 1):
            left = edits - number  # edits that the text after the segment may still take
            for shift in range(max(-number, shorter - left), min(number, shorter + left) + 1):
                fields = {"shorter": shorter, "number": number, "shift": shift, "entry": int(shorter == 0 and shift == 0)}
                kinds.append(F.struct(*[F.lit(value).alias(name) for name, value in fields.items()]))
    others = [c for c in lines.columns if c != "wide"]
    rows = lines.select("*", F.explode(F.array(*kinds)).alias("kind"))
    length = (F.octet_length("wide") / 4).cast("int") - F.col("kind.shorter")
    start, size = segment(length, F.col("kind.number"), edits)
    key = F.xxhash64(length, F.col("kind.number"), F.substring(F.col("wide"), (start + F.col("kind.shift")) * 4 - 3, size * 4))
    return rows.select(*others, key.alias("key"), F.col("kind.entry").cast("bigint").alias("entry"))


def with_near(pairs: DataFrame, left: str, right: str, edits: int) -> DataFrame:
    """``pairs`` with ``near``: whether two strings lie within ``edits`` edits, by a banded, bit-parallel run.

    Bit ``k`` of ``r{e}`` says that with ``e`` edits the run can stand ``k - edits`` characters further in ``left`` than in
    ``right``. A character of ``right`` moves all diagonals at once; which of them match is worked out for all characters first.
    Strings that differ in too many neighbouring pairs of characters (an edit takes away two at most, and adds two) have
    nothing to run over. The steps are columns of their own, as an expression inside a lambda is computed each time it is met.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    names = [f"r{e}" for e in range(edits + 1)]
    pairs = pairs.withColumns({"_a": F.split(left, ""), "_b": F.split(right, "")})

    def neighbours(chars: str) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(chars) - 2, F.lit(0)))
        return F.transform(places, lambda i: F.xxhash64(F.get(chars, i), F.get(chars, i + 1)))

    pairs = pairs.withColumns({"_a2": neighbours("_a"), "_b2": neighbours("_b")})
    likely = F.abs(F.size("_a") - F.size("_b")) <= edits
    for one, other in (("_a2", "_b2"), ("_b2", "_a2")):
        likely = likely & (F.size(F.array_except(one, other)) <= 2 * edits)
    pairs = pairs.withColumn("_likely", likely)

    def matches(j: Column) -> Column:
        char, bits = F.get("_b", j), F.lit(0)
        for k in range(width):
            bits = bits.bitwiseOR(F.when(F.get("_a", j + (k - edits)) == char, 1 << k).otherwise(0))
        return bits

    every = F.transform(F.sequence(F.lit(0), F.size("_b") - 1), matches)
    pairs = pairs.withColumn("_same", F.when(F.col("_likely"), every).otherwise(F.array().cast("array<int>")))

    def step(state: Column, same: Column) -> Column:
        new: list[Column] = []
        for e, name in enumerate(names):
            cell = state[name].bitwiseAND(same)
            if e:
                before = state[names[e - 1]]
                cell = cell.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(new[-1], 1).bitwiseAND(full))
            new.append(cell)
        return F.struct(*[c.alias(name) for c, name in zip(new, names)])

    start = F.struct(*[F.lit(sum(1 << (edits + d) for d in range(e + 1))).alias(name) for e, name in enumerate(names)])
    cells = F.aggregate("_same", start, step, lambda state: _any([state[name] for name in names]))
    end = F.call_function("shiftleft", F.lit(1), F.size("_a") - F.size("_b") + edits)
    near = F.when(F.col("_likely"), cells.bitwiseAND(end) != 0).otherwise(F.lit(False))
    return pairs.withColumn("near", near).drop("_a", "_b", "_a2", "_b2", "_likely", "_same")


def _any(bits: list[Column]) -> Column:
    out = bits[0]
    for more in bits[1:]:
        out = out.bitwiseOR(more)
    return out


def _close(edits: int) -> Column:
    """Counts allow the distance: an edit takes away a letter at most and adds one, takes away two neighbouring pairs of
    letters at most and adds two.

    The sums are tested after a few counts already, which rules out most pairs of lines that aren't close.
    """
    apart = [F.abs(F.get("bag", F.lit(i)) - F.get("other_bag", F.lit(i))) for i in range(len(CLASSES) + len(NEIGHBOURS))]
    tests, done = [], F.lit(0)
    for start, stop in ((0, 3), (3, 7), (7, len(CLASSES))):
        done = sum(apart[start:stop], done)
        tests.append(done <= 2 * edits)
    pairs = F.lit(0)
    for start in range(len(CLASSES), len(apart), 10):
        pairs = sum(apart[start : start + 10], pairs)
        tests.append(pairs <= 4 * edits)
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def _linked(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """``id`` of the lines whose pair ``(id, other)`` lies within the distance."""
    one, two = texts.select("id", "line"), texts.select(F.col("id").alias("other"), F.col("line").alias("other_line"))
    met = with_near(pairs.join(one, "id").join(two, "other"), "line", "other_line", edits)
    # an aggregate between the test and its use keeps the planner from folding the steps into one expression
    return met.groupBy("id").agg(F.max("near").alias("near")).filter("near").select("id")


def near_lines(docs: DataFrame, doc_id: str, text: str, edits: int, min_chars: int) -> DataFrame:
    """``(h1, h2)`` of the lines with an earlier line within ``edits`` edits."""
    lines = line_rows(docs, doc_id, text).filter(F.length("line") >= min_chars)
    keyed = key_rows(lines.select(first_hash(F.col("line")).alias("h1"), wide(F.col("line")).alias("wide")), edits)
    # an id is a line's hash but for the last bit, which says whether the key is an index entry
    rows = keyed.select("key", (F.col("h1").bitwiseAND(F.lit(-2)) + F.col("entry")).alias("tagged"))
    bare = F.col("tagged").bitwiseAND(F.lit(-2))
    # equal lines are one id; partial sums fold them before the shuffle
    shared = rows.groupBy("key").agg(F.min(bare).alias("least"), F.max(bare).alias("most"), F.max(F.col("tagged").bitwiseAND(F.lit(1))).alias("entries"))
    shared = checkpointed(shared.filter("least <> most AND entries = 1").select("key"))
    wanted = bit_map(shared.select(F.col("key").alias("hash")), MAP_BITS)
    again = rows.filter(in_map(wanted.scalar(), F.col("key"), MAP_BITS)).distinct().join(shared, "key", "left_semi")
    met = checkpointed(again.select("key", bare.alias("id"), (F.col("tagged") != bare).alias("entry")))

    known = bit_map(met.select(F.col("id").alias("hash")).distinct(), MAP_BITS)
    rare = lines.filter(in_map(known.scalar(), first_hash(F.col("line")).bitwiseAND(F.lit(-2)), MAP_BITS))
    rare = rare.groupBy("line").agg(F.min(place_of(F.col("id"), F.col("line_no"))).alias("place"))
    n = F.length("line")
    letters = [n - F.length(F.translate("line", chars, "")) for chars in CLASSES]
    bag = F.array(*letters, *[(n - F.length(F.replace(F.col("line"), F.lit(pair)))) / 2 for pair in NEIGHBOURS]).cast("array<int>")
    own = first_hash(F.col("line"))
    texts = rare.select(own.bitwiseAND(F.lit(-2)).alias("id"), own.alias("h1"), second_hash(F.col("line")).alias("h2"), "line", "place", bag.alias("bag"))
    texts = texts.join(met.select("id").distinct(), "id", "left_semi").repartitionByRange("place").sortWithinPartitions("place", "line")
    texts = checkpointed(texts.withColumn("pos", F.monotonically_increasing_id()).drop("place"))  # rises with the place

    members = checkpointed(met.join(texts.select("id", "pos", "bag"), "id"))
    first = F.min(F.struct("pos", "id", "bag"))
    ahead = members.groupBy("key").agg(first.alias("any"), F.min(F.when(F.col("entry"), F.struct("pos", "id", "bag"))).alias("entered"))
    ahead = checkpointed(ahead)
    met_first = members.join(ahead, "key")
    leaders = F.array(F.when(F.col("entry"), F.col("any")), F.col("entered"))
    tested = met_first.select("id", "pos", "bag", F.explode(leaders).alias("o")).filter(F.col("o.pos") < F.col("pos"))
    tested = tested.select("id", F.col("o.id").alias("other"), "bag", F.col("o.bag").alias("other_bag")).filter(_close(edits))
    found = checkpointed(_linked(tested.select("id", "other").distinct(), texts, edits))

    rest = members.join(found, "id", "left_anti")
    others = members.select("key", F.col("id").alias("other"), F.col("pos").alias("other_pos"), F.col("entry").alias("other_entry"), F.col("bag").alias("other_bag"))
    pairs = rest.join(others, (rest["key"] == others["key"]) & (F.col("other_pos") < F.col("pos")) & (F.col("entry") | F.col("other_entry")) & _close(edits))
    more = _linked(pairs.select("id", "other").distinct(), texts, edits)
    return texts.join(found.unionByName(more), "id", "left_semi").select("h1", "h2")


def removals(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """``(id, digest, lines, n_repeated, n_near)`` of documents that lose lines: 0-based line numbers, and how many of them
    equal an earlier line or only come near one. ``digest`` is the hash of the text."""
    line = F.col("line")
    lines = line_rows(docs, doc_id, text)
    seen = lines.select(first_hash(line).alias("h1"), second_hash(line).alias("h2"), place_of(F.col("id"), F.col("line_no")).alias("place"))
    again = seen.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    near = near_lines(docs, doc_id, text, max_edits, min_chars).withColumn("near", F.lit(True))
    judged = checkpointed(again.join(near, ["h1", "h2"], "full").select("h1", "h2", "place", F.coalesce("near", F.lit(False)).alias("near")))
    known = bit_map(judged.select(F.col("h1").alias("hash")), MAP_BITS)
    rows = line_rows(docs, doc_id, text, F.xxhash64(f"`{text}`").alias("digest"))
    rows = rows.select("id", "digest", "line_no", first_hash(line).alias("h1"), second_hash(line).alias("h2"))
    rows = rows.filter(in_map(known.scalar(), F.col("h1"), MAP_BITS)).withColumn("own", place_of(F.col("id"), F.col("line_no")))
    repeated = F.coalesce(F.col("own") > F.col("place"), F.lit(False))
    gone = rows.join(judged, ["h1", "h2"]).withColumn("repeated", repeated).filter("repeated OR near")
    gone = gone.select("id", "digest", "line_no", "repeated").distinct()
    return gone.groupBy("id", "digest").agg(
        F.array_sort(F.collect_list("line_no")).alias("lines"),
        F.count_if("repeated").alias("n_repeated"),
        F.count_if(~F.col("repeated")).alias("n_near"),
    )


def line_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each document: ``doc_id, n_lines, n_repeated, n_near, removed`` (line numbers, 0-based)."""
    gone = removals(docs, doc_id, text, **options)
    body = F.col(f"`{text}`")
    n_lines = F.coalesce(F.size(F.filter(F.split(body, "\n"), filled)), F.lit(0)).cast("bigint")
    own = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.xxhash64(body).alias("digest"), F.when(body.isNull(), 0).otherwise(n_lines).cast("bigint").alias("n_lines"))
    met = own.alias("o").join(gone.alias("g"), F.col("o.id").eqNullSafe(F.col("g.id")) & (F.col("o.digest") == F.col("g.digest")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return met.select(
        F.col("o.id").alias(doc_id), "n_lines", zero("n_repeated"), zero("n_near"), F.coalesce("lines", F.array().cast("array<int>")).alias("removed")
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the removed lines; documents that lose all their lines go, blank ones stay as they are.

    Other columns pass through, whatever their names. Only documents that may lose lines are shuffled. A very long text costs time
    and memory in proportion to its length.
    """
    gone = checkpointed(removals(docs, doc_id, text, **options))
    known = bit_map(gone.select(F.xxhash64("id", "digest").alias("hash")), MAP_BITS)
    own = F.xxhash64(F.col(f"`{doc_id}`").cast("bigint"), F.xxhash64(f"`{text}`"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    untouched = docs.filter(~in_map(known.scalar(), own, MAP_BITS)).select(*columns)
    # the whole row lies in one column, whatever its columns are called
    marked = docs.filter(in_map(known.scalar(), own, MAP_BITS))
    marked = marked.select(F.struct(*columns).alias("row"), F.col(f"`{doc_id}`").cast("bigint").alias("own"), F.xxhash64(f"`{text}`").alias("hash"), F.split(F.col(f"`{text}`"), "\n").alias("parts"))
    met = marked.join(gone, F.col("own").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("digest")), "left").withColumn("whole", F.col(f"row.`{text}`"))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "lines")  # by a hash set, linear in the lines
    kept = F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n")
    changed = met.withColumn("body", F.when(F.col("lines").isNull(), F.col("whole")).otherwise(kept)).filter(F.col("lines").isNull() | filled(F.col("body")))
    return untouched.unionByName(changed.select(*[(F.col("body") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]))
