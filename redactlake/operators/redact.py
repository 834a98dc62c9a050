"""Redaction of a document table and its counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tags
from .inventory import Inventory, pattern_set
from .matching import MAX_BROADCAST_BYTES, Matcher, prepare_matcher, with_matches


def matcher_for(inv: Inventory, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> Matcher:
    return prepare_matcher(pattern_set(inv), max_broadcast_bytes)


def redact_documents(docs: DataFrame, matcher: Matcher, keys: list[str], text: str = "text") -> DataFrame:
    """Add ``redacted`` and ``n_matches``; documents without a match keep their text.

    Matches are selected leftmost-longest. Fenced code and existing tags stay as they are.
    """
    cols = docs.columns
    if matcher.is_empty:
        return docs.select(*cols, F.col(text).alias("redacted"), F.lit(0).alias("n_matches"))
    found = with_matches(docs, matcher, keys, text, "_matches", select=True)
    return tags.splice(found.withColumn("_spans", tags.render_tags("_matches")), text, "_spans", "redacted").select(
        *cols, "redacted", F.size("_spans").alias("n_matches")
    )


def match_counts(redacted: DataFrame, keys: list[str]) -> DataFrame:
    """Selected matches per document, zeroes included."""
    return redacted.select(*keys, "n_matches")


def match_totals(redacted: DataFrame) -> DataFrame:
    return redacted.agg(
        F.count("*").alias("n_documents"),
        F.coalesce(F.sum("n_matches"), F.lit(0)).alias("n_matches"),
        F.count_if(F.col("n_matches") > 0).alias("n_changed"),
    )
