"""Leftmost-longest selection over a table of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..runtime import materialize


def select_spans(matches: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The rows kept when each key takes its leftmost span, of those the longest, and drops what it overlaps.

    The input is evaluated once and stored sorted by (keys, start, longest first) in ranges, so a key with most of the rows
    lies in many partitions, however its spans overlap. The choice over a partition depends on the earlier ones only by where
    their last kept span ends. Each partition states in one row what it hands on if nothing is carried in. Where spans reach over
    its border, it also tabulates what it hands on by what is carried in, for the part of the run that they reach. One walk
    through these tables, in order, finds what is carried into each partition, and a last scan keeps the rows.
    Of the sorted spans, only keys and bounds are read more than once. The driver holds one row per partition.
    """
    spark = matches.sparkSession
    stored = materialize(matches)
    ordered = materialize(
        stored.repartitionByRange(*keys, start, F.col(end).desc()).sortWithinPartitions(*keys, start, F.col(end).desc())
    )
    bounds = ordered.select(*keys, start, end)
    kinds = {c: bounds.schema[c].dataType.simpleString() for c in bounds.columns}
    own = [f"{side}{i} {kinds[k]}" for side in "fl" for i, k in enumerate(keys)]
    schema = ", ".join(["part int", *own, f"first_start {kinds[start]}", "one_run boolean", f"reach {kinds[end]}", f"fresh {kinds[end]}"])
    summaries = sorted(bounds.mapInArrow(kernels.make_span_summary(keys, start, end), schema).collect())
    runs, reaches, reach, previous = [], {}, None, None
    for row in summaries:
        first, last = tuple(row[1 : 1 + len(keys)]), tuple(row[1 + len(keys) : 1 + 2 * len(keys)])
        continues = previous is not None and previous == first
        if continues and row["one_run"] and reach > row["first_start"]:
            reaches[row["part"]] = reach
        runs.append((row["part"], continues, row["first_start"], row["one_run"], row["reach"], row["fresh"]))
        reach = max(reach, row["reach"]) if continues and row["one_run"] else row["reach"]
        previous = last
    share = spark.sparkContext.broadcast
    carried = {}
    if any(r[1] for r in runs):
        # With nothing to look up, the walk has no rows to read but still tells what is carried.
        tables = bounds.mapInArrow(kernels.make_carry_table(keys, start, end, share(reaches)), "part int, upto bigint, fresh bigint")
        walk = kernels.make_carry_walk(share(runs))
        if reaches:
            walked = tables.repartition(1).sortWithinPartitions("part", "upto").mapInArrow(walk, "part int, carried bigint")
            carried = {r["part"]: r["carried"] for r in walked.collect()}
        else:
            carried = {p: c for batch in walk([]) for p, c in zip(*(column.to_pylist() for column in batch.columns))}
    return ordered.mapInArrow(kernels.make_greedy_scan(keys, start, end, share(carried)), ordered.schema)
