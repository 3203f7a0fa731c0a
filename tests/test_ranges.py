"""Done-sets as number ranges equal plain sets, whatever the order of the runs."""

import random

import pytest
from pyspark.sql import functions as F

from textlake.operators.ranges import merge_ranges, number_ranges, outside_ranges
from textlake.plans.resume import pending_items, record_done
from textlake.session import scratch_path
from textlake.sinks.tables import read_marks


def runs(numbers):
    """Maximal runs of a set of numbers."""
    out = []
    for n in sorted(numbers):
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return [tuple(x) for x in out]


def collected(df):
    return sorted((r.g or "", r.lo, r.hi) for r in df.collect())


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_random_sets_in_blocks(spark, block):
    rng = random.Random(block)
    done = {g: {n for n in range(-150, 300) if rng.random() < p} for g, p in (("a", 0.9), ("", 0.5), ("c", 0.05))}
    done["a"] |= set(range(300, 500))  # one run over many blocks
    rows = [(g or None, n) for g, s in done.items() for n in s] * 2 + [("a", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, n int")
    got = number_ranges(df, ["g"], "n", block)
    assert collected(got) == sorted((g, *r) for g, s in done.items() for r in runs(s))
    items = [(g or None, n, n % 3) for g in (*done, "new") for n in range(-160, 510)] + [("a", None, 0), ("a", 5000, 1), ("a", 5000, 1)]
    todo = outside_ranges(spark.createDataFrame(items, "g string, n long, lo int"), got, ["g"], "n", block)
    want = [x for x in items if x[1] is None or x[1] not in done.get(x[0] or "", ())]
    assert todo.columns == ["g", "n", "lo"]
    assert sorted(map(str, (tuple(r) for r in todo.collect()))) == sorted(map(str, want))


def test_overlapping_empty_and_broken_ranges(spark):
    rows = [("a", 1, 100), ("a", 50, 60), ("a", 101, 130), ("a", 140, 139), ("a", None, 7), ("a", 8, None), ("b", 3, 3), ("b", 3, 3), (None, 1, 2), (None, 2, 9)]
    df = spark.createDataFrame(rows, "g string, lo long, hi long")
    for block in (10, 1000):
        assert collected(merge_ranges(df, ["g"], block)) == [("", 1, 9), ("a", 1, 130), ("b", 3, 3)]
    assert merge_ranges(df.limit(0), ["g"]).count() == 0
    items = spark.createDataFrame([("a", 1)], "g string, n long")
    assert outside_ranges(items, df.limit(0), ["g"], "n").count() == 1
    assert outside_ranges(items.limit(0), df, ["g"], "n").count() == 0


def test_gap_is_fetched_again_and_order_does_not_matter(spark):
    items = spark.range(1, 41).select(F.lit("A").alias("g"), F.col("id").alias("n"))
    batches = [items.where("n <= 20 AND n NOT IN (7, 8)"), items.where("n BETWEEN 15 AND 30"), items.where("n = 7")]
    tables = []
    for order in ((0, 1, 2), (2, 1, 0, 0), (1, 0, 1, 2)):
        state = scratch_path(spark, "ranges-test")
        assert pending_items(items, state, ["g"], "n").count() == 40
        for i in order:
            record_done(batches[i], state, ["g"], "n", block=8)
        tables.append(collected(read_marks(spark, state)))
        assert sorted(r.n for r in pending_items(items, state, ["g"], "n").collect()) == [8, *range(31, 41)]
    assert tables == [[("A", 1, 7), ("A", 9, 30)]] * 3
