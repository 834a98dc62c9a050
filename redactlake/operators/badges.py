"""Badge lines: parsing, validation and counts.

A badge names one sensitive string, as ``[REDACTED: code, desc] => surface`` or
``code | desc | surface``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def badge_lines(df: DataFrame, content: str, keys: list[str], drop_blank_first: bool = False) -> DataFrame:
    """One row per line of ``content`` with its 1-based ``line_no``.

    ``drop_blank_first`` numbers the non-blank lines only, as for proposer output.
    """
    lines = T.split_lines(F.col(content))
    if drop_blank_first:
        lines = F.filter(lines, lambda line: T.strip(line) != "")
    # An outer explode: a plain one makes Spark test the array for emptiness beforehand, which
    # evaluates the expression behind it a second time.
    return (
        df.select(*keys, F.posexplode_outer(lines).alias("_pos", "raw"))
        .filter(F.col("_pos").isNotNull())
        .select(*keys, (F.col("_pos") + 1).alias("line_no"), "raw")
    )


def parse_badges(lines: DataFrame) -> DataFrame:
    """Add ``kind`` (skip, arrow, pipe, invalid), ``code``, ``desc``, ``surface`` and ``error``."""
    fields = [("code", 1), ("desc", 2), ("surface", 3)]
    picked = [
        f"CASE kind WHEN 'arrow' THEN regexp_extract(_line, r'{T.BADGE_ARROW}', {n})"
        f" WHEN 'pipe' THEN regexp_extract(_line, r'{T.BADGE_PIPE}', {n}) END"
        for _, n in fields
    ]
    picked[1] = T.strip_sql(picked[1])
    return (
        lines.withColumn("_line", T.strip(F.col("raw")))
        .withColumn(
            "kind",
            F.expr(f"""
              CASE WHEN _line = '' OR startswith(_line, '#') THEN 'skip'
                WHEN _line RLIKE r'{T.BADGE_ARROW}' THEN 'arrow'
                WHEN _line RLIKE r'{T.BADGE_PIPE}' THEN 'pipe'
                ELSE 'invalid' END"""),
        )
        .select(
            *lines.columns,
            "kind",
            *[F.expr(sql).alias(name) for sql, (name, _) in zip(picked, fields)],
            F.expr(
                "if(kind = 'invalid', concat('Error parsing line ', line_no, ': Invalid badge line format: ', _line), NULL)"
            ).alias("error"),
        )
    )


def valid_badges(parsed: DataFrame, on_error: str = "raise", order: Sequence[str] | None = ("line_no",)) -> DataFrame:
    """Rows holding a badge. An invalid line fails the job, or is left out with ``on_error='skip'``.

    The job stops with the error of the first invalid line by ``order``. A scalar subquery finds it
    before any row is returned, so the message does not depend on which task fails first; the lines
    are read once more for it. Without an ``order`` they are read once, and any invalid line may be named.
    """
    if on_error == "raise":
        first = F.col("error") if order is None else invalid_badges(parsed).agg(F.min_by("error", F.struct(*order)).alias("first_error")).scalar()
        checked = F.when(first.isNotNull(), F.raise_error(first).cast("string")).otherwise(F.col("kind"))
        parsed = parsed.withColumn("kind", checked)
    return parsed.filter(F.col("kind").isin("arrow", "pipe")).drop("error")


def invalid_badges(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("kind") == "invalid")


def first_error(parsed: DataFrame, order: list[str]) -> str | None:
    """The message a strict run stops with, or None."""
    row = invalid_badges(parsed).agg(F.min_by("error", F.struct(*order)).alias("e")).first()
    return row["e"]


def validation_counts(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: valid badges, skipped lines and the first error.

    Blank lines and lines starting with ``#`` count as skipped; an indented ``#`` line is in
    neither count.
    """
    flush = T.rstrip(F.col("raw"))
    skipped = (flush == "") | flush.startswith("#")
    return parsed.groupBy(*keys).agg(
        F.count_if(F.col("kind").isin("arrow", "pipe")).alias("n_valid"),
        F.count_if(skipped).alias("n_skipped"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("line_no"))).alias("first_error"),
    )
