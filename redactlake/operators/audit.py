"""Checks of what a redaction promises: it can be undone, and doing it twice changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inventory import Inventory
from .matching import Matcher
from .redact import redact_documents
from .restore import restore_documents


def roundtrip(docs: DataFrame, inv: Inventory, matcher: Matcher, keys: list[str], text: str = "text") -> DataFrame:
    """Per document: matches, tags read back, and whether the text came back unchanged."""
    redacted = redact_documents(docs.select(*keys, text), matcher, keys, text)
    restored = restore_documents(redacted, inv, keys, "redacted")
    return restored.select(
        *keys, "n_matches", "n_tags", F.col("restored").eqNullSafe(F.col(text)).alias("is_equal")
    )


def idempotency(docs: DataFrame, matcher: Matcher, keys: list[str], text: str = "text") -> DataFrame:
    """Per document: matches of the first and second pass, and whether the second changed the text."""
    first = redact_documents(docs.select(*keys, text), matcher, keys, text).select(
        *keys, F.col("redacted").alias("once"), F.col("n_matches").alias("n_first")
    )
    second = redact_documents(first, matcher, keys, "once")
    return second.select(
        *keys, "n_first", F.col("n_matches").alias("n_second"), F.col("redacted").eqNullSafe(F.col("once")).alias("is_equal")
    )
