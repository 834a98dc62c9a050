"""Bounded training samples: a stated number of labelled rows, chosen by hash, whatever the table's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts longer than this are scored like all others, but not used as training examples.
MAX_SAMPLE_CHARS = 20_000


def sample_rows(rows: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each value of ``label`` (all, where there are fewer).

    A row is in if the hash of its key is below a threshold set by its label's count, so the
    choice needs one count, no sort, and is the same in every run.
    """
    counts = rows.groupBy(label).count().collect()
    below = F.lit(0.0)
    for row in counts:
        below = F.when(F.col(label) == F.lit(row[0]), F.lit(per_label / row["count"])).otherwise(below)
    return rows.filter(unit_hash(F.col(key)) < below)


def unit_hash(key: Column) -> Column:
    """A number from 0 to 1 that depends on nothing but the key."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))
