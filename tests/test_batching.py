import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from custodia.operators.batching import plan_batches


def packed(spark, sizes, max_bytes, max_files, ranges=3):
    files = spark.createDataFrame([(f"f{i:05d}", s) for i, s in enumerate(sizes)], "relative_path string, size_bytes bigint")
    planned = plan_batches(files, max_bytes, max_files, ranges=ranges)
    return [r["batch"] for r in planned.orderBy("relative_path").collect()]


def one_by_one(sizes, max_bytes, max_files):
    """What packing a list in order gives, file by file."""
    numbers, batch, held = [], 0, []
    for size in sizes:
        if held and (sum(held) + size > max_bytes or len(held) == max_files):
            batch, held = batch + 1, []
        held.append(size)
        numbers.append(batch)
    return numbers


def test_known_plans(spark):
    assert packed(spark, [5, 4, 6], 10, 10) == [0, 0, 1]
    assert packed(spark, [1, 1, 1], 10, 2) == [0, 0, 1]
    assert packed(spark, [10, 10], 10, 5) == [0, 1]
    assert packed(spark, [0, 0, 0, 10, 0], 10, 5) == [0, 0, 0, 0, 0]


def test_limits(spark):
    for sizes in ([50], [8, None, 8], [-1]):
        with pytest.raises(ValueError, match="between 0 and max_bytes"):
            packed(spark, sizes, 10, 2)
    for limits in ((0, 1), (1, 0), (-1, 1)):
        with pytest.raises(ValueError, match="positive"):
            packed(spark, [1], *limits)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    sizes=st.lists(st.integers(0, 30), min_size=1, max_size=120),
    max_bytes=st.integers(30, 90),
    max_files=st.integers(1, 9),
    ranges=st.integers(1, 12),
)
def test_any_list_is_packed_in_order(spark, sizes, max_bytes, max_files, ranges):
    assert packed(spark, sizes, max_bytes, max_files, ranges) == one_by_one(sizes, max_bytes, max_files)


def test_a_batch_may_span_many_ranges(spark):
    assert packed(spark, [1] * 40, 1000, 1000, ranges=20) == [0] * 40
    assert packed(spark, [1] * 40, 17, 1000, ranges=20) == one_by_one([1] * 40, 17, 1000)


@pytest.mark.parametrize("max_bytes, max_files, block", [(30, 7, 16), (70, 1_000_000, 5), (400, 40, 20), (10_000, 1_000_000, 40)])
def test_blocks_shorter_and_longer_than_batches(spark, max_bytes, max_files, block):
    sizes = [(i * i * 7) % 31 for i in range(150)]
    files = spark.createDataFrame([(f"f{i:05d}", s, "x") for i, s in enumerate(sizes)], "relative_path string, size_bytes bigint, at string")
    planned = plan_batches(files, max_bytes, max_files, block=block)
    assert planned.columns == [*files.columns, "batch"]
    assert [r["batch"] for r in planned.orderBy("relative_path").collect()] == one_by_one(sizes, max_bytes, max_files)


def test_equal_paths_and_no_files(spark):
    files = spark.createDataFrame([("same", 3)] * 50 + [("same", 0)] * 50, "relative_path string, size_bytes bigint")
    planned = plan_batches(files, 10, 60, block=8)
    want = one_by_one([0] * 50 + [3] * 50, 10, 60)
    assert sorted(r["batch"] for r in planned.collect()) == want
    assert plan_batches(files.limit(0), 10, 60).count() == 0


def test_entries_of_a_long_list(spark):
    """Many files in blocks of a thousand: batches of changing length, followed without the driver."""
    import numpy as np
    from pyspark.sql import functions as F

    from custodia.operators.batching import entries

    n = 200_000
    steps = spark.range(n).select(F.col("id").alias("at"), F.least(F.col("id") + 700 + F.pmod(F.xxhash64(F.floor(F.col("id") / 50)), F.lit(40)), F.lit(n)).alias("next"))
    # a later start never leads to an earlier one, as with real sizes
    from pyspark.sql import Window as W

    steps = steps.withColumn("next", F.max("next").over(W.orderBy("at"))).cache()
    following = np.array([r["next"] for r in steps.orderBy("at").select("next").collect()])
    want, at, batch, seen = [], 0, 0, set()
    while at < n:
        if at // 1000 not in seen:
            seen.add(at // 1000)
            want.append((at, batch))
        at, batch = int(following[at]), batch + 1
    assert sorted((r["at"], r["batch"]) for r in entries(steps, n, 1000).collect()) == want
