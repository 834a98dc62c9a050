"""Documents as segments: prose, and fenced code that is left alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tags


def segment_documents(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, seg_no, seg_start, chunk, redactable); the chunks of a document joined give its text."""
    cut = docs.select(*[F.col(tags.quoted(k)) for k in keys], tags.segments(text).alias("_segments"))
    return cut.select(*[F.col(tags.quoted(k)) for k in keys], F.inline_outer("_segments")).filter(F.col("seg_no").isNotNull())


def mask_documents(docs: DataFrame, text: str = "text", name: str = "masked") -> DataFrame:
    """Add the text with existing tags blotted out, length unchanged."""
    return docs.withColumn(name, tags.mask_tags(text))
