import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from helpers import texts
from redactlake.functions import kernels, tags
from redactlake.operators.segments import segment_documents


def test_segments(spark):
    fence = brute.FENCE
    cases = [
        "tide table",
        f"high\n{fence}csv\n06:10,3.2\n{fence}\nlow",
        f"high\n{fence}\nto the end",
        f"high\n{fence}\n06:10\n{fence}\t\nstill open",
        f"{fence}`\n06:10\n{fence}\n{fence}\n{fence}\nlow",
        f"{fence}\n{fence}",
        f" {fence}\nindented\n{fence}",
        "",
    ]
    df = texts(spark, cases).select("doc_id", tags.segments("text").alias("s"))
    for r in df.collect():
        got = [(s["seg_start"], s["chunk"], s["redactable"]) for s in r["s"]]
        assert got == list(brute.chunks(cases[r["doc_id"]]))
        assert [s["seg_no"] for s in r["s"]] == list(range(len(got)))


@pytest.mark.parametrize("seed", range(3))
def test_random_fences(spark, seed):
    rnd = random.Random(seed)
    parts = [brute.FENCE, "`", "\n", "\n", "\n" + brute.FENCE + "\n", "a", "é中", " ", "\r\n", brute.FENCE + "py\n"]
    cases = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(400)]
    df = texts(spark, cases).repartition(3).select("doc_id", tags.segments("text").alias("s"))
    for r in df.collect():
        got = [(s["seg_start"], s["chunk"], s["redactable"]) for s in r["s"]]
        assert got == [c for c in brute.chunks(cases[r["doc_id"]]) if c[1]]
        assert [s["seg_no"] for s in r["s"]] == list(range(len(got)))


def test_null_and_empty_texts_have_no_segments(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (None, "y")], "`a b` int, text string")
    assert sorted(map(tuple, segment_documents(df, ["a b"]).collect()), key=str) == [(3, 0, 0, "x", True), (None, 0, 0, "y", True)]


def test_positions_are_placed_in_their_segments(spark):
    text = f"é\n{brute.FENCE}\nx\n{brute.FENCE}\nzz"
    df = spark.createDataFrame([("q", []), (text, [0, 2, 5, 11, 13]), ("", [])], "text string, at array<int>")
    got = [[tuple(p) for p in r[0]] for r in df.select(kernels.make_locator()(F.col("text"), F.col("at"))).collect()]
    starts = [c[0] for c in brute.chunks(text)]
    assert starts == [0, 2, 11] and got == [[], [(0, 0), (1, 2), (1, 2), (2, 11), (2, 11)], []]


def test_time_grows_with_the_number_of_segments():
    """Twice the fences take about twice the time, up to 64,000 segments in one document."""

    def seconds(n):
        arr = pa.array([f"prose {brute.FENCE}\n{brute.FENCE}\ncode\n{brute.FENCE}\n" * (n // 2)])
        data, bounds = kernels._utf8(arr)
        best = 9.0
        for _ in range(5):
            begin = time.perf_counter()
            found = kernels._cuts(data, bounds)[0]
            best = min(best, time.perf_counter() - begin)
        assert len(found) == n + (n > 0) or len(found) == n
        return best

    times = np.array([seconds(n) for n in (8_000, 16_000, 32_000, 64_000)])
    assert (times[1:] / times[:-1]).max() < 3.5 and times[-1] < 1.0
