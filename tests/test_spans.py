import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from redactlake.functions import kernels
from redactlake.operators.spans import select_spans


def test_select_spans_with_null_keys(spark):
    rows = [(None, 1, 5), (None, 3, 9), (None, 6, 7), (2, 1, 2)]
    got = select_spans(spark.createDataFrame(rows, "k int, s long, e long"), ["k"], "s", "e").collect()
    assert {tuple(r) for r in got} == {(None, 1, 5), (None, 6, 7), (2, 1, 2)}


def test_select_spans(spark):
    rnd = random.Random(11)
    rows = []
    for d in range(40):
        for _ in range(rnd.randrange(60)):
            s = rnd.choice([rnd.randrange(50), 65530 + rnd.randrange(20), rnd.randrange(300000)])
            rows.append((d, s, s + rnd.choice([1, 2, 5, 30, 90000])))
    rows = sorted(set(rows))
    df = spark.createDataFrame([(d, s, e, f"{s}-{e}") for d, s, e in rows], "d int, s long, e long, note string")
    got = {(r["d"], r["s"], r["e"]) for r in select_spans(df, ["d"], "s", "e").collect()}
    want = set()
    for d in range(40):
        want |= {(d, s, e) for s, e in brute.greedy([(s, e) for k, s, e in rows if k == d])}
    assert got == want


def test_long_island(spark):
    """Greedy choice stays linear when every span overlaps the next."""
    df = spark.range(200000).select(F.lit(1).alias("d"), F.col("id").alias("s"), (F.col("id") + 2).alias("e"))
    assert select_spans(df, ["d"], "s", "e").count() == 100000


def chosen(rows):
    """By key, from the definition."""
    out = []
    for key in {r[0] for r in rows}:
        out += [(key, *s) for s in brute.greedy([r[1:] for r in rows if r[0] == key])]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_one_key_over_many_partitions(spark, seed):
    """A key with most rows, spans that reach over several partitions, and chains that differ by what is carried in."""
    rnd = random.Random(seed)
    rows = set()
    for _ in range(3000):
        s = rnd.randrange(2000)
        rows.add((7, s, s + rnd.choice([1, 2, 3, 3, 5, 8, 8, 40, 400 if rnd.random() < 0.02 else 4])))
    for key in (None, 3, 8, 9):
        for _ in range(40):
            s = rnd.randrange(90)
            rows.add((key, s, s + rnd.randrange(1, 12)))
    rows = list(rows)
    df = spark.createDataFrame([(k, s, e, f"{s}") for k, s, e in rows], "k int, s long, e long, note string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = select_spans(df, ["k"], "s", "e").drop("note").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, got), key=str) == chosen(rows)


def test_the_input_is_evaluated_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("s"), (F.col("id") + 3).alias("e"))
    assert select_spans(df.mapInArrow(count, df.schema), ["k"], "s", "e").count() == 1667
    assert seen.value == 5000


def test_no_spans_and_no_keys(spark):
    df = spark.createDataFrame([(0, 4), (2, 9), (4, 5), (4, 4)], "s int, e int")
    assert sorted(map(tuple, select_spans(df, [], "s", "e").collect())) == [(0, 4), (4, 5)]
    assert select_spans(df.filter("s > 90"), [], "s", "e").collect() == []


def test_only_clashing_rows_are_walked_through():
    """The kernel against row by row, over batches that cut runs; rows after a kept one that do not clash are never asked."""
    rnd = random.Random(9)
    for _ in range(300):
        rows = sorted(((rnd.randrange(3), s, -s - rnd.randrange(9)) for s in (rnd.randrange(20) for _ in range(12))))
        last, key, kept, got, at = None, None, [], [], None
        for k, s, e in rows:
            take = k != key or s >= last
            key, last = k, -e if take else last
            kept.append(take)
        for part in (rows[:5], rows[5:]):
            new = np.array([i == 0 and not got or (rows[len(got) + i - 1][0] != k) for i, (k, _, _) in enumerate(part)])
            keep, at = kernels._greedy(new, np.array([r[1] for r in part]), np.array([-r[2] for r in part]), at)
            got += keep.tolist()
        assert (got, at) == (kept, last)

    class Counted(np.ndarray):
        def tolist(self):
            assert len(self) < 2, "walked through"
            return super().tolist()

    starts = np.arange(0, 3000, 3)
    keep, at = kernels._greedy(np.zeros(1000, bool), starts.view(Counted), (starts + 3).view(Counted), None)
    assert keep.all() and at == 3000
