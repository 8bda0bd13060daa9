"""The batch jobs over arriving files. Streams keep no state but the files they have seen, and what waits for an answer."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from ..operators import labels, mail
from ..session import checkpointed
from ..sources import tables

log = logging.getLogger(__name__)

LABEL_COLUMNS = ["message_id", "att_pos", "hit_pos", "label_pos", "name"]
MAIL = ["arrived", "message_id", "sender", "has_content", "parse_ok"]
LABELS = "message_id string, att_pos int, hit_pos int, label_pos int, name string"
STORE = "spark.sql.streaming.stateStore"
#: State on the executors' disks, with a few small buffers for each store; the default store keeps all of it in the heap, in two versions.
STATE_ON_DISK = {
    f"{STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{STORE}.rocksdb.writeBufferSizeMB": "16",
    f"{STORE}.rocksdb.allowFAllocate": "false",
    f"{STORE}.rocksdb.trackTotalNumberOfRows": "false",
    f"{STORE}.rocksdb.compression": "zstd",
    f"{STORE}.compression.codec": "zstd",
}
#: Shuffle files go when the query that made them ends, not when the driver happens to collect its garbage.
CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Mails decided at once, and the most shares that more of them are decided in.
DUE_AT_ONCE, MOST_SHARES = 500_000, 8
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "json", per_batch: int = 1000) -> DataFrame:
    """Files that arrive in a folder, at most ``per_batch`` at a time."""
    reader = spark.readStream.format(fmt).schema(schema)
    return reader.option("maxFilesPerTrigger", per_batch).load(path)


def _start(writer: DataStreamWriter, every: str | None) -> StreamingQuery:
    """Run at an interval, or (``None``) through what is there and stop."""
    timed = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return timed.start()


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for what runs within. A stream that is started within keeps them; the session gets its own back."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def route_stream(
    files: DataFrame, allowed: list[str], blocked: list[str], out: str, checkpoint: str, remove: bool = False, every: str | None = None
) -> StreamingQuery:
    """Route classified files as they arrive; the rows are those of the batch operator."""
    routed = labels.route(files, allowed, blocked, remove)
    writer = routed.writeStream.format("parquet").outputMode("append")
    return _start(writer.option("path", out).option("checkpointLocation", checkpoint), every)


def sync_stream(
    rows: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str, failures: str, buckets: int | None = None, every: str | None = "60 seconds"
) -> StreamingQuery:
    """Upsert each batch into a keyed table, the last row per key by ``order``, whatever batch it comes in: rows that arrive
    late or again never replace newer ones.

    A cycle that fails repeatedly is logged, its rows go to ``failures`` with the error, and the next cycle
    runs (``replay`` takes them up again). An upsert done twice after a restart gives the same table.
    """

    def cycle(batch: DataFrame) -> None:
        tables.merge_upsert(tables.latest_per_key(batch, keys, order), target, keys, buckets, order)

    return each_cycle(rows, cycle, checkpoint, failures, every)


def each_cycle(
    rows: DataFrame, cycle: Callable[[DataFrame], None], checkpoint: str, failures: str, every: str | None = "60 seconds", attempts: int = 3
) -> StreamingQuery:
    """Run ``cycle`` on every batch, up to ``attempts`` times; one that still fails is logged and kept in ``failures``."""

    def guarded(batch: DataFrame, number: int) -> None:
        for left in reversed(range(attempts)):
            try:
                return cycle(batch)
            except Exception as error:
                log.exception("cycle %d failed, %d attempts left", number, left)
                last = str(error)[:500]
        failed = batch.withColumn("error", F.lit(last)).withColumn("cycle", F.lit(number))
        writer = failed.write.mode("overwrite").partitionBy("cycle")
        writer.option("partitionOverwriteMode", "dynamic").parquet(failures)

    return _start(rows.writeStream.foreachBatch(guarded).option("checkpointLocation", checkpoint), every)


def replay(spark: SparkSession, failures: str, cycle: Callable[[DataFrame], None]) -> None:
    """Run ``cycle`` once more on the rows of failed cycles. They stay listed; a keyed upsert may see them again."""
    cycle(spark.read.parquet(failures).drop("error", "cycle"))


def mail_gate_stream(
    spark: SparkSession,
    folder: str,
    classify: Callable[[DataFrame], DataFrame],
    blocked: DataFrame,
    out: str,
    checkpoint: str,
    every: str | None = None,
    per_batch: int = 500,
    attempts: int = 100,
) -> StreamingQuery:
    """Verdicts for mail files that arrive in a folder, at most ``per_batch`` at a time.

    ``classify`` turns attachments (message_id, att_pos, filename, content) into labels
    (message_id, att_pos, hit_pos, label_pos, name). Attachments it can't classify pass, and the verdicts say so;
    see ``classified``. The verdicts of one batch replace those of an earlier run of it.
    """
    source = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", per_batch)
    files = source.option("pathGlobFilter", "*.eml").load(folder)

    def gate(batch: DataFrame, number: int) -> None:
        parsed = mail.parse_messages(batch).persist()
        try:
            found = parsed.select("message_id", F.inline("attachments")).withColumnRenamed("pos", "att_pos")
            named, failed = classified(found, classify, attempts)
            verdicts = mail.mail_gate(parsed.drop("attachments"), failed, named, blocked).withColumn("batch", F.lit(number))
            writer = verdicts.write.mode("overwrite").partitionBy("batch")
            writer.option("partitionOverwriteMode", "dynamic").parquet(out)
        finally:
            parsed.unpersist()

    return _start(files.writeStream.foreachBatch(gate).option("checkpointLocation", checkpoint), every)


def classified(found: DataFrame, classify: Callable[[DataFrame], DataFrame], attempts: int = 100) -> tuple[DataFrame, DataFrame]:
    """Labels of the attachments, and the attachments with ``classification_error``.

    The classifier's result is computed here, so that a failure while it runs is seen. A part that fails is halved by
    hash until single attachments fail; when ``attempts`` are used up, what is left in failing parts counts as failed.
    """
    spark, half = found.sparkSession, F.xxhash64("message_id", "att_pos")
    good, bad, open_parts = [], [], [(0, 0)]  # (bits, value): attachments whose hash ends with these bits
    while open_parts:
        bits, value = open_parts.pop(0)
        mine = half.bitwiseAND(F.lit((1 << bits) - 1)) == value
        try:
            if attempts <= 0:
                raise RuntimeError("no attempts left")
            attempts -= 1
            good.append(checkpointed(classify(found.filter(mine)).select(*LABEL_COLUMNS)))
        except Exception:
            log.exception("classification failed")
            if attempts > 0 and bits < 62 and len(found.filter(mine).select("message_id").take(2)) > 1:
                open_parts += [(bits + 1, value), (bits + 1, value | 1 << bits)]
            else:
                bad.append(mine)
    named = reduce(DataFrame.unionByName, good) if good else spark.createDataFrame([], LABELS)
    failed = reduce(lambda a, b: a | b, bad, F.lit(False))
    return named, found.select("message_id", "att_pos", "filename", failed.alias("classification_error"))


def mail_events(mails: DataFrame, answers: DataFrame, wait: str) -> DataFrame:
    """What is known of mails, and what the classifier says of their attachments: a stream of three kinds of rows.

    ``mails``, a stream: message_id, arrived (timestamp), sender, has_content, parse_ok, and attachments (an array of structs with
    att_pos and filename). ``answers``, a stream: message_id, att_pos, answered (timestamp), labels (an array of structs with hit_pos,
    label_pos, name). Both come through as they are (``mail``, ``answer``). A mail comes once more, narrow, when nothing can come for
    it in time any more (``due``). State is one such narrow row for each mail that waits; the watermarks bound it.
    """
    due = mails.select(*MAIL, (F.col("arrived") + F.expr(f"INTERVAL {wait}")).alias("due")).withWatermark("due", wait)
    due = due.groupBy("due", *MAIL).agg(F.count("*").alias("n")).select(F.lit("due").alias("kind"), *MAIL)
    sent = mails.select(F.lit("mail").alias("kind"), *MAIL, "attachments")
    told = answers.withWatermark("answered", wait).select(F.lit("answer").alias("kind"), "message_id", "att_pos", "answered", "labels")
    return due.unionByName(sent, allowMissingColumns=True).unionByName(told, allowMissingColumns=True)


def log_events(batch: DataFrame, number: int, folder: str, watermark: int, wait: str) -> DataFrame:
    """Add a batch of ``mail_events`` to the log of what waits, and return the log.

    ``watermark`` (milliseconds) is that of the batch before: mails and answers behind it are too late and dropped. A batch that is
    run again replaces its rows. Hours of which no mail waits, nor any answer that could be repeated, are deleted.
    """
    spark, late = batch.sparkSession, F.timestamp_millis(F.lit(watermark))
    at = F.when(F.col("kind") == "answer", F.col("answered")).otherwise(F.col("arrived"))
    kept = batch.filter((F.col("kind") == "due") | (at > late)).withColumns({"hour": _hour(at), "batch": F.lit(number), "late": late})
    writer = kept.write.mode("overwrite").partitionBy("kind", "hour", "batch").option("compression", "zstd")
    writer.option("partitionOverwriteMode", "dynamic").parquet(folder)
    past = spark.range(1).select(_hour(late - F.expr(f"INTERVAL {wait}") - F.expr(f"INTERVAL {wait}"))).first()[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for kind in files.listStatus(path):
        for part in files.listStatus(kind.getPath()) if kind.isDirectory() else ():
            name = part.getPath().getName()
            if name.startswith("hour=") and name[5:].lstrip("-").isdigit() and int(name[5:]) < past:
                files.delete(part.getPath(), True)
    return spark.read.schema(kept.schema).parquet(folder)


def _hour(time: Column) -> Column:
    return F.floor(F.unix_seconds(time) / 3600).cast("bigint")


def _due(number: int) -> Column:
    return (F.col("kind") == "due") & (F.col("batch") == number)


def shares_due(events: DataFrame, number: int) -> int:
    """In how many shares the mails that are due in a batch are decided. Every share reads the log, so they are few."""
    return min(MOST_SHARES, 1 + events.filter(_due(number)).count() // DUE_AT_ONCE)


def decided_mails(events: DataFrame, number: int, wait: str, share: int = 0, shares: int = 1) -> DataFrame:
    """Mails that are due in a batch, with what the classifier said of each attachment in time; of one share of the messages.

    An attachment without an answer within ``wait`` of its mail's arrival is let go unclassified. Repeated answers count once: an answer
    stands until the watermark is ``wait`` beyond it, and those for the same attachment that come meanwhile are dropped.
    Only hours in which a mail that is due arrived, or could be answered, are read. Mails and answers are dealt by message, once.
    """
    limit = F.expr(f"INTERVAL {wait}")
    first, last, final = events.filter(_due(number)).agg(_hour(F.min("arrived")), _hour(F.max("arrived")), _hour(F.max("arrived") + limit)).first()
    if first is None:
        first, last, final = 0, -1, -1
    events = events.filter(F.pmod(F.xxhash64("message_id"), F.lit(shares)) == share) if shares > 1 else events
    sent = events.filter(_due(number)).unionByName(events.filter((F.col("kind") == "mail") & F.col("hour").between(first, last)))
    # equal mails are one group, and each brings the same answers
    sent = sent.repartition("message_id").groupBy(*MAIL).agg(F.flatten(F.collect_list("attachments")).alias("attachments"), F.count_if(F.col("kind") == "due").alias("n_due"), F.count("*").alias("n"))
    sent = sent.filter("n_due > 0 AND n > n_due").drop("n_due", "n")

    since = first - (final - last + 1)  # an earlier answer may make one in time a repeated one
    told = events.filter((F.col("kind") == "answer") & F.col("hour").between(since, final) & F.col("message_id").isNotNull())
    told = told.repartition("message_id").groupBy("message_id", "att_pos", "batch").agg(F.min_by(F.struct("late", "answered", "labels"), "answered").alias("one"))
    told = told.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("batch", F.col("att_pos").alias("of_att"), "one.*"))).alias("answers"))
    met = sent.withColumn("until", F.col("arrived") + limit).join(told, "message_id", "left")

    def standing(mine: Column) -> Column:
        again = lambda kept, one: (F.size(kept) > 0) & (F.element_at(kept, -1)["answered"] + limit > one["late"])
        one_by_one = F.aggregate(mine, F.slice(mine, 1, 0), lambda kept, one: F.when(again(kept, one), kept).otherwise(F.concat(kept, F.array(one))))
        return F.when(F.size(mine) <= 1, mine).otherwise(one_by_one)

    in_time = lambda one: one["answered"].between(F.col("arrived"), F.col("until"))
    file = lambda part: (part["att_pos"].alias("att_pos"), part["filename"].alias("filename"))
    parts = F.transform("attachments", lambda part: F.struct(*file(part), F.filter("answers", lambda one: one["of_att"] == part["att_pos"]).alias("mine")))
    parts = F.transform(parts, lambda part: F.struct(*file(part), F.get(F.filter(standing(part["mine"]), in_time), F.lit(0)).alias("answer")))
    parts = F.transform(parts, lambda part: F.struct(*file(part), part["answer"].isNotNull().alias("classified"), part["answer"]["labels"].alias("labels")))
    return met.select(*MAIL, parts.alias("attachments"))


def _watermark(spark: SparkSession, checkpoint: str, number: int) -> int:
    """The watermark (milliseconds) a batch ran with, from the stream's checkpoint."""
    if number < 0:
        return 0
    lines = spark.read.text(f"{checkpoint}/offsets/{number}").select(F.regexp_extract("value", r'"batchWatermarkMs":(\d+)', 1).alias("ms"))
    return int(lines.filter("ms <> ''").first()["ms"])


def late_label_gate(mails: DataFrame, answers: DataFrame, blocked: DataFrame, out: str, checkpoint: str, wait: str = "1 hour", every: str | None = None) -> StreamingQuery:
    """Verdicts for mails whose classification answers later than the mail arrives.

    Both streams are taken as they come, whichever side is first; a mail is decided once nothing more can come for it in time, and
    answers to mails that are decided, or that never come, are dropped (see ``mail_events``, ``decided_mails``). Attachments without an
    answer in time pass, and the verdict says so (``classification_error``).

    Which mails wait is state, on disk (``STATE_ON_DISK``); attachments and answers wait as columns in files below ``checkpoint``, by hour, which
    take a small part of what they would take as state. Many mails that are due at once are decided share by share of the messages, so
    that no more than a share is shuffled at a time; the shuffle files of a share are deleted after it. A share's mails are stored before
    they are judged, so that joins are planned by how much there is.
    """

    def gate(batch: DataFrame, number: int) -> None:
        spark, held, judged = batch.sparkSession, f"{checkpoint}/decided", f"{checkpoint}/judged"
        events = log_events(batch, number, f"{checkpoint}/waiting", _watermark(spark, checkpoint, number - 1), wait)
        shares = shares_due(events, number)
        for share in range(shares):
            rows = decided_mails(events, number, wait, share, shares)
            rows.write.mode("overwrite").option("compression", "zstd").parquet(held)
            decided = spark.read.schema(rows.schema).parquet(held)
            parts = decided.select("message_id", F.inline("attachments"))
            attachments = parts.select("message_id", "att_pos", "filename", (~F.col("classified")).alias("classification_error"))
            named = parts.filter("classified").select("message_id", "att_pos", F.inline("labels"))
            verdicts = mail.mail_gate(decided.drop("attachments", "arrived"), attachments, named, blocked)
            verdicts.write.mode("append" if share else "overwrite").option("compression", "zstd").parquet(judged)
        verdicts = spark.read.schema(verdicts.schema).parquet(judged).withColumn("batch", F.lit(number))
        writer = verdicts.write.mode("overwrite").partitionBy("batch")
        writer.option("partitionOverwriteMode", "dynamic").parquet(out)

    writer = mail_events(mails, answers, wait).writeStream.outputMode("append").foreachBatch(gate)
    with settings(mails.sparkSession, STATE_ON_DISK | CLEANED):
        return _start(writer.option("checkpointLocation", checkpoint), every)
