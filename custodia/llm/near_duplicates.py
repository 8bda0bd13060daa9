"""MinHash near-duplicates: BagMinHash signatures of word-shingle multisets, bands, and verified overlap.

Each shingle with weight ``c`` (its count in the text) owns Poisson processes over the discretised weights
``0, 1, 2, ...``: one for each dyadic strip ``[0,1), [1,2), [2,4), [4,8), ...``, with a rate in proportion to the
strip's width. A point has a time, a slot of the signature and a weight inside its strip; it counts for a text if that
weight lies below ``c``. A slot keeps its earliest point, so two texts agree in a slot with a chance equal to their
weighted Jaccard similarity. Only points before a time bound are made, as later ones can't be the earliest of any slot
(if a slot stays empty, the bound is doubled); the work for a text hardly depends on the signature's length.

Texts with the same words are one text from the start. Texts that share a band are compared by exact multiset Jaccard
similarity: first with the smallest text of the bucket, and then, where a bucket still holds several classes, with the
rest of it, so no pair that shares a band is left untested unless it is in one class already or its signatures rule it
out (a pair just similar enough is lost by the bands with a chance of 5e-5, by that test with one of 3e-7).

Defined results. Null and empty texts, and texts without words, have no shingles and stay alone. Texts of fewer words than a
shingle are one shingle. Repeated rows and ids are members like others. Null ids can't name a class unless no
member has an id. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import plain_words
from custodia.llm.decontaminate import bit_map, in_map
from custodia.llm.graph import components
from custodia.operators.skew import join_by_weight
from custodia.session import checkpointed

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 5
#: Leaders that a bucket tests in one of the later rounds, and comparisons per member below which the rest meets at once.
LEADERS = 16
PAIRS_PER_MEMBER = 2000
#: Pairs of one leader that go into one share of the join with its sketch.
LEADER_PAIRS = 1000
#: Shingles in a block of texts whose multisets are compared, and pairs of texts in a cell of two blocks; both on average.
BLOCK = 1 << 21
CELL_PAIRS = 1 << 17
#: Slots of the signature are compared before texts are, by four bits each; a pair goes if more slots differ than the
#: similarity allows by this many standard deviations.
DEVIATIONS = 5.0
#: Places of a text's parity bits.
PARITY = 1024
#: Words, or shingles, that are worked on at once.
PIECE = 1 << 17


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places ``starts[i] ... starts[i] + sizes[i] - 1`` of all texts, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def shingles(words: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, key, count)`` of the distinct shingles of many texts, in the order of texts.

    ``words`` has the hashes of all words, text after text; ``ends`` where each text begins and ends. A text of fewer words
    than ``size`` is one shingle. Keys have 52 bits, so that text and key sort as one number; two shingles of one text are
    taken for the same with a chance of 2^-52.
    """
    n = np.diff(ends)
    made = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    begin = _spread(ends[:-1], made)
    span = np.repeat(np.minimum(n, size), made).astype(np.uint64)
    h = _mixed(span)
    odd = _mixed(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    padded = np.concatenate([words.astype(np.uint64), np.zeros(size, dtype=np.uint64)])
    for k in range(size):
        step = _mixed(padded[begin + k] + odd[k])  # each place has a mixture of its own
        h = h + (step if (span > k).all() else np.where(span > k, step, np.uint64(0)))
    both = np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(52), made) | (_mixed(h) >> np.uint64(12))
    both.sort()
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(first, len(both)))
    return (both[first] >> np.uint64(52)).astype(np.int64), both[first] & np.uint64((1 << 52) - 1), count


def signatures(owner: np.ndarray, keys: np.ndarray, counts: np.ndarray, texts: int, slots: int) -> np.ndarray:
    """Times of the earliest points, a row of ``slots`` for each text; infinite for texts without shingles."""
    best = np.full(texts * slots, np.inf)
    weight = np.bincount(owner, weights=counts, minlength=texts)
    bound = (np.log(slots) + 3.0) / np.maximum(weight, 1)
    top = int(counts.max()).bit_length() if len(counts) and counts.max() > 1 else 0
    parts = [(keys, np.zeros(len(keys)), np.ones(len(keys)), counts, owner)]
    for strip in range(1, top + 1):  # strip [2^(strip-1), 2^strip) of the weights
        base = float(1 << (strip - 1))
        over = np.flatnonzero(counts > base)
        parts.append((_mixed(keys[over] + (np.uint64(strip) << np.uint64(52))), np.full(len(over), base), np.full(len(over), base), counts[over], owner[over]))
    seed, low, width, most, own = (np.concatenate(column) for column in zip(*parts))
    seed = _mixed(seed)
    unit = 1.0 / (1 << 53)
    while len(seed):
        z, at, w, c, o, t = seed, low, width, most, own, np.zeros(len(seed))
        while len(z):
            z = z + np.uint64(0x9E3779B97F4A7C15)
            u = _mixed(z)
            t = t - np.log(((u >> np.uint64(11)) + np.uint64(1)) * unit) / (slots * w)
            live = np.flatnonzero(t <= bound[o])
            z, at, w, c, o, t = z[live], at[live], w[live], c[live], o[live], t[live]
            place = _mixed(z ^ np.uint64(0xD6E8FEB86659FD93))
            slot = o * slots + ((place & np.uint64(0xFFFFFFFF)) % np.uint64(slots)).astype(np.int64)
            if (c == 1).all():
                np.minimum.at(best, slot, t)
            else:
                counted = at + np.floor((place >> np.uint64(32)) * w / (1 << 32)) < c
                np.minimum.at(best, slot[counted], t[counted])
        # a text with an empty slot is made again up to a later bound; its points so far come out the same
        open_text = ~np.isfinite(best.reshape(texts, slots)).all(axis=1) & (weight > 0)
        bound = bound * 2
        again = np.flatnonzero(open_text[own])
        seed, low, width, most, own = seed[again], low[again], width[again], most[again], own[again]
    return best.reshape(texts, slots)


def band_values(best: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = best.view(np.uint64).reshape(len(best), bands, rows)
    value = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(best), bands))
    for k in range(rows):
        value = _mixed(value * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return value.view(np.int64)


def sketch_words(best: np.ndarray) -> np.ndarray:
    """Four bits of each slot, sixteen slots in a number."""
    codes = (_mixed(best.view(np.uint64)) & np.uint64(15)).astype(np.uint64)
    codes = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 16))).reshape(len(best), -1, 16)
    return (codes << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)


def members_of(owner: np.ndarray, keys: np.ndarray, counts: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The multisets as sets, one number for each copy of a shingle, and how many each text has."""
    copy = _spread(np.zeros(len(counts), dtype=np.int64), counts).astype(np.uint64)
    made = _mixed(np.repeat(keys, counts) + copy * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
    return made, np.bincount(owner, weights=counts, minlength=texts).astype(np.int64)


def parity_words(members: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of ``PARITY`` places an odd number of a text's members fall on, 64 places in a number.

    Two texts differ in at most as many places as they have members that the other one lacks.
    """
    place = np.repeat(np.arange(len(sizes)), sizes) * PARITY + (members & (PARITY - 1))
    odd = (np.bincount(place, minlength=len(sizes) * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sizes), PARITY), axis=1).view(np.int64)


def _with_list(batches: Iterator[pa.RecordBatch], name: str, made) -> Iterator[pa.RecordBatch]:
    """Replace the column of word hashes by the lists that ``made(words, ends)`` gives (values and their numbers)."""
    for whole in batches:
        words = np.diff(whole.column(whole.schema.get_field_index("h")).offsets.to_numpy()).cumsum()
        start = 0
        while start < whole.num_rows:  # about PIECE words at once, one text at least
            before = words[start - 1] if start else 0
            stop = min(max(int(np.searchsorted(words, before + PIECE)), start + 1), start + 512, whole.num_rows)
            batch = whole.slice(start, stop - start)
            start = stop
            at = batch.schema.get_field_index("h")
            lists = batch.column(at)
            ends = lists.offsets.to_numpy().astype(np.int64)
            values, sizes = made(lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends - ends[0])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            column = pa.ListArray.from_arrays(offsets, pa.array(values, type=pa.int64()))
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], column], names=[*[batch.schema.names[i] for i in kept], name]
            )


def _hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    hashes = F.transform(plain_words(F.col(f"`{text}`")), lambda w: F.xxhash64(w))
    read = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(f"`{text}`").alias("digest"), hashes.alias("h"))
    return read.withColumns({"d1": F.xxhash64("h"), "d2": F.xxhash64(F.lit(17), "h")})


def banded(docs: DataFrame, doc_id: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """``(row, id, digest, d1, d2, n, bands)``: digest of the text, of its words, number of shingles, and
    band values with the words of the sketch behind them (none without words)."""
    read = _hashed(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id())
    n = F.when(F.size("h") > 0, F.greatest(F.size("h") - size + 1, F.lit(1))).otherwise(0).cast("bigint")
    read = read.select("row", "id", "digest", "d1", "d2", n.alias("n"), "h")

    def work(batches):
        def made(words, ends):
            texts = len(ends) - 1
            owner, keys, counts = shingles(words, ends, size)
            best = signatures(owner, keys, counts, texts, bands * rows)
            values = np.concatenate([band_values(best, bands, rows), sketch_words(best)], axis=1)
            filled = np.bincount(owner, minlength=texts) > 0
            return values[filled].ravel(), filled * values.shape[1]

        return _with_list(batches, "bands", made)

    kind = docs.schema[doc_id].dataType.simpleString()
    return read.mapInArrow(work, f"row bigint, id {kind}, digest bigint, d1 bigint, d2 bigint, n bigint, bands array<bigint>")


def _map_bits(held: int) -> int:
    """Bits of a map of ``held`` hashes: 16 each, within 2^20 and 2^28 (32 MB); a fuller map only spares fewer rows the join."""
    return 1 << min(max(20, (16 * held).bit_length()), 28)


def _multisets(docs: DataFrame, doc_id: str, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """``(rep, n, sketch, buckets, parity, members)`` of the texts ``wanted (rep, d1, d2, n, sketch, buckets)``, read from the documents again."""
    bits = _map_bits(wanted.count())
    known = bit_map(wanted.select(F.col("d1").alias("hash")), bits)
    read = _hashed(docs, doc_id, text).filter(in_map(known.scalar(), F.col("d1"), bits)).select("d1", "d2", "h")
    read = read.groupBy("d1", "d2").agg(F.first("h").alias("h")).join(wanted, ["d1", "d2"]).select("rep", "n", "sketch", "buckets", "h")

    def work(batches):
        def made(words, ends):
            members, sizes = members_of(*shingles(words, ends, size), len(ends) - 1)
            parity = parity_words(members, sizes)
            return np.insert(members, np.repeat(np.cumsum(sizes) - sizes, parity.shape[1]), parity.ravel()), sizes + parity.shape[1]

        return _with_list(batches, "both", made)

    read = read.mapInArrow(work, "rep bigint, n bigint, sketch array<bigint>, buckets array<bigint>, both array<bigint>")
    ahead = PARITY // 64
    split = F.slice("both", 1, ahead).alias("parity"), F.slice("both", F.lit(ahead + 1), F.size("both") - ahead).alias("members")
    return read.select("rep", "n", "sketch", "buckets", *split)


def shared_members(starts: np.ndarray, members: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many members texts ``a[i]`` and ``b[i]`` share; text ``k`` has ``members[starts[k] : starts[k + 1]]``, each once."""
    distinct, code = np.unique(members, return_inverse=True)
    held = np.zeros(len(distinct), dtype=np.int32)
    sizes, shared = np.diff(starts), np.zeros(len(a), dtype=np.int64)
    order = np.argsort(a, kind="stable")
    work = np.cumsum(sizes[b[order]])
    stops = np.flatnonzero(np.append(a[order][1:] != a[order][:-1], True)) + 1 if len(a) else []
    start = 0
    for end in stops:  # all pairs of one text
        own = code[starts[a[order[start]]] : starts[a[order[start]] + 1]]
        held[own] = 1
        while start < end:  # about PIECE members at once, one pair at least
            before = work[start - 1] if start else 0
            stop = min(max(int(np.searchsorted(work, before + PIECE)), start + 1), end)
            pairs = order[start:stop]
            found = np.cumsum(held[code[_spread(starts[b[pairs]], sizes[b[pairs]])]])
            shared[pairs] = np.diff(np.append(0, np.append(0, found)[work[start:stop] - before]))
            start = stop
        held[own] = 0
    return shared


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs (a, rep)`` with a Jaccard similarity of their multisets of at least ``similarity``, as ``(a, b)``.

    Texts are dealt over blocks, pairs over cells of two blocks. A multiset goes once to each cell in which it has a pair, however
    many pairs or buckets it is in; blocks are as many as bound the multisets and the pairs of a cell.
    """
    per_text = pairs.select(F.explode(F.array("a", "rep")).alias("rep")).groupBy("rep").agg(F.count("*").alias("ends"))
    ends, weight = per_text.join(sets.select("rep", "n").hint("merge"), "rep").agg(F.sum("ends"), F.sum("n")).first()
    blocks = max(1, -(-(weight or 0) // BLOCK), math.ceil(math.sqrt((ends or 0) / 2 / CELL_PAIRS)))
    x, y = (F.pmod(F.xxhash64(c), F.lit(blocks)) for c in ("a", "rep"))
    dealt = pairs.select("a", "rep", (F.least(x, y) * blocks + F.greatest(x, y)).alias("cell"))
    placed = dealt.select(F.col("cell").alias("place"), F.explode(F.array("a", "rep")).alias("rep")).distinct()
    placed = placed.join(sets.select("rep", "members").hint("merge"), "rep")

    def work(met: pa.Table, texts: pa.Table) -> pa.Table:
        rep, lists = texts.column("rep").to_numpy(), texts.column("members").combine_chunks()
        starts = lists.offsets.to_numpy().astype(np.int64)
        order = np.argsort(rep)
        a, b = (order[np.searchsorted(rep, met.column(c).to_numpy(), sorter=order)] for c in ("a", "rep"))
        values = lists.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
        both = np.diff(starts)[a] + np.diff(starts)[b]
        similar = shared_members(starts - starts[0], values, a, b) * (1 + similarity) >= similarity * both
        return pa.table({"a": rep[a[similar]], "b": rep[b[similar]]})

    return dealt.groupBy("cell").cogroup(placed.groupBy("place")).applyInArrow(work, "a bigint, b bigint")


def _possible(similarity: float, slots: int) -> Column:
    """Sizes and sketches of two texts (``n, sketch, other_n, other_sketch``) allow the similarity."""
    differ = F.lit(0)
    for i in range(-(-slots // 16)):
        bits = F.get("sketch", F.lit(i)).bitwiseXOR(F.get("other_sketch", F.lit(i)))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1)).bitwiseAND(F.lit(0x1111111111111111))
        differ = differ + F.bit_count(bits)
    chance = (1 - similarity) * 15 / 16
    most = math.ceil(slots * chance + DEVIATIONS * math.sqrt(slots * chance * (1 - chance)))
    return (F.least("n", "other_n") >= similarity * F.greatest("n", "other_n")) & (differ <= most)


def _near(similarity: float) -> Column:
    """Sizes and parities of two texts (``n, parity, other_n, other_parity``) allow the similarity; no similar pair fails."""
    differ = F.lit(0)
    for i in range(PARITY // 64):
        differ = differ + F.bit_count(F.get("parity", F.lit(i)).bitwiseXOR(F.get("other_parity", F.lit(i))))
    return differ * (1 + similarity) <= (F.col("n") + F.col("other_n")) * (1 - similarity) + 0.001


def _met(pairs: DataFrame, texts: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs (a, rep)`` with ``columns`` of both texts, those of ``a`` called ``other_...``.

    A leader may stand in very many pairs; its pairs are dealt over as many shares as their number asks for.
    """
    here = pairs.join(texts.select("rep", *columns).hint("merge"), "rep")
    theirs = texts.select(F.col("rep").alias("a"), *[F.col(c).alias(f"other_{c}") for c in columns])
    weighed = pairs.groupBy("a").agg(F.count("*").alias("weight")).join(theirs.hint("merge"), "a")
    return join_by_weight(here, weighed, ["a"], "weight", "rep", LEADER_PAIRS)


def linked(members: DataFrame, sets: DataFrame, similarity: float, slots: int) -> DataFrame:
    """``(node, root)`` of the classes of ``members (bucket, rep, lead)``; texts without a link have no row.

    ``lead`` is the smallest text of the bucket. ``sets`` has size, sketch, all ``buckets`` and the multiset (``members``) of each ``rep``.
    All pairs are made distinct over all buckets and pass the test of sizes and sketches as ids before multisets meet, the pairs of a
    bucket's rest also that of parities; multisets are never dealt by bucket.
    """
    possible, sizes = _possible(similarity, slots), sets.select("rep", "n", "sketch", "parity", "buckets")
    near = _near(similarity)
    first = checkpointed(members.filter("lead < rep").select(F.col("lead").alias("a"), "rep").distinct())
    first = checkpointed(_met(first, sets, ["n", "sketch"]).filter(possible).select("a", "rep"))
    links = checkpointed(_similar(first, sets, similarity))
    rest, done = members, False
    while True:
        root = components(links)
        if done:
            return root
        rest = rest.select("bucket", "rep").join(root.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
        rest = checkpointed(rest.withColumn("class", F.coalesce("root", "rep")).drop("root"))
        per_class = rest.groupBy("bucket", "class").agg(F.count("*").alias("own"))
        largest = F.max(F.struct("own", "class")).alias("largest")
        mixed = per_class.groupBy("bucket").agg(F.count("*").alias("classes"), F.sum("own").alias("all"), largest).filter("classes > 1")
        mixed = checkpointed(mixed.select("bucket", "all", F.col("largest.class").alias("main"), (F.col("all") - F.col("largest.own")).alias("odd")))
        compared, held = mixed.agg(F.sum(F.col("all") * F.col("odd")), F.sum("all")).first()
        if not compared:
            return root
        rest = rest.join(mixed.select("bucket", "main").hint("merge"), "bucket")
        full = rest.join(sizes.hint("merge"), "rep")
        other = full.select("bucket", *[F.col(c).alias(f"other_{c}") for c in ("rep", "n", "sketch", "parity", "class", "buckets")])
        # each pair in one bucket only; a bucket stands at its band's place
        here = F.col("bucket") == F.array_min(F.zip_with("buckets", "other_buckets", lambda x, y: F.when(x == y, x)))
        if compared <= PAIRS_PER_MEMBER * held:
            # texts outside their bucket's largest class meet all others of the bucket, each pair once
            once = (F.col("other_class") == F.col("main")) | (F.col("rep") < F.col("other_rep"))
            met = full.filter("class <> main").join(other.hint("merge"), "bucket")
            pairs = met.filter((F.col("class") != F.col("other_class")) & once & possible & near & here)
            done = True
        else:
            # too many to compare at once: some leaders of each bucket meet all others of it and leave
            ahead = rest.groupBy("bucket", F.pmod("rep", F.lit(64)).alias("part")).agg(F.min("rep").alias("rep")).groupBy("bucket")
            chosen = ahead.agg(F.slice(F.array_sort(F.collect_set("rep")), 1, LEADERS).alias("reps"))
            chosen = checkpointed(chosen.select("bucket", F.explode("reps").alias("other_rep")))
            met = full.join(chosen.join(other.hint("merge"), ["bucket", "other_rep"]).hint("merge"), "bucket")
            pairs = met.filter((F.col("class") != F.col("other_class")) & possible & near & here)
            rest = checkpointed(rest.join(chosen.withColumnRenamed("other_rep", "rep").hint("merge"), ["bucket", "rep"], "left_anti"))
        pairs = checkpointed(pairs.select(F.least("rep", "other_rep").alias("a"), F.greatest("rep", "other_rep").alias("rep")).distinct())
        links = checkpointed(links.unionByName(_similar(pairs, sets, similarity)))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row for each document: ``doc_id, n_shingles, class_id, class_size, kept, digest``.

    ``class_id`` is the smallest id of the class, ``kept`` holds for one document of each class, ``digest`` is a hash of the text.
    """
    scanned = checkpointed(banded(docs, doc_id, text, size, bands, rows))
    # equal words have equal sizes and bands, so any row of a group serves
    own_text = [F.first(c).alias(c) for c in ("n", "bands")]
    groups = checkpointed(scanned.filter("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("rep"), *own_text))
    keys = F.transform(F.slice("bands", 1, bands), lambda value, band: F.xxhash64(band, value))
    buckets = groups.select("rep", F.explode(keys).alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("held"), F.min("rep").alias("lead")).filter("held > 1")
    members = checkpointed(buckets.join(checkpointed(shared.select("bucket", "lead")).hint("merge"), "bucket"))
    sketch = F.slice("bands", bands + 1, -(-bands * rows // 16)).alias("sketch")
    wanted = groups.join(members.select("rep").distinct().hint("merge"), "rep", "left_semi")
    wanted = checkpointed(wanted.select("rep", "d1", "d2", "n", sketch, keys.alias("buckets")))
    sets = checkpointed(_multisets(docs, doc_id, text, size, wanted))
    roots = linked(members, sets, similarity, bands * rows)
    roots = roots.withColumnRenamed("node", "rep")
    classes = checkpointed(groups.join(roots, "rep", "left").select("d1", "d2", F.coalesce("root", "rep").alias("root")))
    own = scanned.select("row", "id", "digest", "d1", "d2", "n")
    placed = own.filter("n > 0").join(classes, ["d1", "d2"]).unionByName(own.filter("n = 0").withColumn("root", F.col("row")))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    heads = checkpointed(placed.groupBy("root").agg(first, F.count("*").alias("class_size")))
    return placed.join(heads, "root").select(
        F.col("id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        F.col("first.id").alias("class_id"),
        "class_size",
        (F.col("first.row") == F.col("row")).alias("kept"),
        "digest",
    )
