"""All occurrences of all surfaces in all documents: the documents x surfaces substring join.

Two physical forms, chosen by the measured size of the pattern set:

* up to ``max_broadcast_bytes`` the patterns are broadcast and each document is matched where
  it lies: one map-only pass, no shuffle;
* beyond it only a split-block filter is broadcast, in slices. It grows with the inventory up to a stated
  bound and screens the texts down to windows that almost surely are surfaces. Documents with such a
  window are stored and numbered, their windows are joined to the patterns and the lists of matches
  back to the stored documents. All others stay where they lie: texts are read twice, and only those with
  a hit move.

Both give the same array column, ordered by (start, longest first).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, tags
from ..runtime import materialize

MAX_BROADCAST_BYTES = 64 << 20
MIN_BITS, MAX_BITS = 16, 27  # the bitmap of a small inventory takes 8 KiB to 16 MiB
MIN_WORD_BITS, MAX_WORD_BITS = 9, 23  # the filter of a large one takes 4 KiB to 64 MiB, in slices of 16 MiB
PAGES_PER_TASK = 128  # pages of 4 KiB that a task puts together; the bits in a page do not grow while the filter does
ROW_OVERHEAD = 64
NONCHARACTER = "[" + "".join(tags.NONCHARACTERS) + "]"
PATTERN_COLUMNS = ["surface", "item_id", "code", "desc", "variant", "alias_id"]


@dataclass(frozen=True)
class Matcher:
    """A measured pattern set, ready for any number of documents."""

    patterns: DataFrame
    state: object | None
    """In place, a broadcast of the bitmap and the patterns; else (lengths, broadcast slices of the filter)."""
    in_place: bool
    fill: str = tags.NONCHARACTERS[0]

    @property
    def is_empty(self) -> bool:
        return self.state is None


def prepare_matcher(
    patterns: DataFrame, max_broadcast_bytes: int = MAX_BROADCAST_BYTES, max_word_bits: int = MAX_WORD_BITS
) -> Matcher:
    """Measure ``patterns`` and build what the executors need."""
    patterns = patterns.select(*PATTERN_COLUMNS)
    kept = patterns.persist()  # measured, then read once more
    try:
        width = sum(F.octet_length(c) for c in ("surface", "code", "desc")) + ROW_OVERHEAD
        size = kept.agg(
            F.count("*").alias("n"),
            F.sum(width).alias("bytes"),
            F.collect_set(F.octet_length("surface")).alias("lengths"),
            F.bool_or(F.col("surface").rlike(NONCHARACTER)).alias("odd"),
        ).first()
        if size["n"] == 0:
            return Matcher(patterns, None, True)
        lengths = sorted(size["lengths"])
        fill = _unused_fill(kept) if size["odd"] else tags.NONCHARACTERS[0]
        if size["bytes"] > max_broadcast_bytes:
            return Matcher(patterns, (lengths, _filter_slices(kept, size["n"], max_word_bits)), False, fill)
        bits = min(MAX_BITS, max(MIN_BITS, int(32 * size["n"]).bit_length()))
        table = kept.toArrow().combine_chunks()
        surfaces = table.column("surface").combine_chunks()
        flags = np.zeros(1 << bits, np.uint8)
        for slots in kernels.surface_slots(surfaces, bits):
            flags[slots] = 1
        state = {"bits": bits, "lengths": lengths, "patterns": ipc_bytes(table)}
        state["bitmap"] = np.packbits(flags, bitorder="little").tobytes()
        return Matcher(patterns, patterns.sparkSession.sparkContext.broadcast(state), True, fill)
    finally:
        kept.unpersist()


def _unused_fill(patterns: DataFrame) -> str:
    """A character no surface holds, so that nothing can match where it stands."""
    hits = F.explode(F.regexp_extract_all("surface", F.lit(NONCHARACTER), F.lit(0)))
    used = {r[0] for r in patterns.select(hits).distinct().collect()}  # 66 rows at most
    for c in tags.NONCHARACTERS:
        if c not in used:
            return c
    raise ValueError("the inventory uses every Unicode noncharacter; none is left to fill fences with")


def ipc_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _filter_slices(patterns: DataFrame, n: int, max_word_bits: int) -> list:
    """The words of the filter, ORed together on the executors; the driver holds one slice at a time."""
    wanted = 2 * n * kernels.WORDS_PER_FINGERPRINT
    word_bits = min(max_word_bits, max(MIN_WORD_BITS, math.ceil(math.log2(wanted))))
    bit = patterns.select(F.explode(kernels.make_filter_bits(word_bits)(F.col("surface"))).alias("bit")).select((F.col("bit") + 1).alias("bit"))
    # Bits move before they are put together: a page of each task for each page of the filter would be far more to sort.
    page_bytes = 4096
    tasks = max(1, (8 << word_bits) // page_bytes // PAGES_PER_TASK)
    bit = bit.withColumn("page", F.bitmap_bucket_number("bit") - 1).repartition(tasks, "page")
    pages = materialize(bit.groupBy("page").agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")))
    per_slice = min(1 << word_bits, kernels.SLICE_WORDS) * 8 // page_bytes
    slices = []
    for first in range(0, (1 << word_bits) * 8 // page_bytes, per_slice):
        out = np.zeros(per_slice * page_bytes, np.uint8)
        for row in pages.filter(F.col("page").between(first, first + per_slice - 1)).collect():
            at = (row["page"] - first) * page_bytes
            out[at : at + page_bytes] = np.frombuffer(bytes(row["bits"]), np.uint8)
        slices.append(patterns.sparkSession.sparkContext.broadcast(out.tobytes()))
    return slices


def with_matches(
    docs: DataFrame,
    matcher: Matcher,
    keys: list[str],
    text: str = "text",
    name: str = "matches",
    select: bool = False,
) -> DataFrame:
    """Add the array of all matches of each document, or with ``select`` of the leftmost-longest ones.

    Filter documents before, not after: the match is marked so that filters stay above it, which keeps it from
    being evaluated twice per row. With a large inventory ``docs`` are read twice and must be the same both times.
    """
    none = F.array().cast(kernels.MATCH_TYPE)
    if matcher.is_empty:
        return docs.withColumn(name, none)
    seen = tags.searchable(text, matcher.fill)
    if matcher.in_place:
        match = kernels.make_matcher(matcher.state, select).asNondeterministic()
        return docs.withColumn(name, match(seen))
    found = _match_by_join(docs, matcher, seen, name)
    return found.withColumn(name, _selection()(F.col(name))) if select else found


def _selection():
    return kernels.make_leftmost_longest(kernels.MATCH_TYPE).asNondeterministic()


def _match_by_join(docs: DataFrame, matcher: Matcher, seen: Column, name: str) -> DataFrame:
    """Documents the screen passes are stored with a number, which their matches are joined back by.

    Whether it passes depends on the text alone, so the second reading takes exactly the others. Hot surfaces
    are left to adaptive skew handling.
    """
    cols = [F.col(tags.quoted(c)) for c in docs.columns]
    screen = kernels.make_screen(*matcher.state).asNondeterministic()
    screened = docs.withColumn("_candidates", screen(seen))
    none = F.array().cast(kernels.MATCH_TYPE)
    missed = screened.filter(F.size("_candidates") == 0).select(*cols, none.alias(name))
    passed = screened.filter(F.size("_candidates") > 0).withColumn("_row", F.monotonically_increasing_id())
    passed = materialize(passed)
    real = passed.select("_row", F.inline("_candidates")).join(matcher.patterns.hint("shuffle_hash"), "surface")
    fields = ["start", "end", *PATTERN_COLUMNS]
    order = F.struct("start", (-F.col("end")).alias("neg_end"), F.struct(*fields).alias("m"))
    lists = real.groupBy("_row").agg(F.transform(F.array_sort(F.collect_set(order)), lambda r: r["m"]).alias("_matches"))
    found = F.coalesce(F.col("_matches").cast(kernels.MATCH_TYPE), none)
    return passed.join(lists, "_row", "left").select(*cols, found.alias(name)).unionByName(missed)


def match_all(
    docs: DataFrame, matcher: Matcher, keys: list[str], text: str = "text", select: bool = False
) -> DataFrame:
    """One row per occurrence, overlaps included (or resolved, with ``select``).

    ``start`` and ``end`` count from the segment the match lies in, ``doc_start`` from the
    beginning of the document. A match column called like a key gets the prefix ``match_``.
    """
    found = with_matches(docs, matcher, keys, text, select=select)
    ids = {k: f"_k{i}" for i, k in enumerate(keys)}
    starts = F.transform("matches", lambda m: m["start"])
    locate = kernels.make_locator().asNondeterministic()
    return (
        found.filter(F.size("matches") > 0)
        .select(*[F.col(f"`{k}`").alias(i) for k, i in ids.items()], "matches", locate(F.col(f"`{text}`"), starts).alias("_places"))
        .select(*ids.values(), F.inline(F.zip_with("matches", "_places", lambda m, p: F.struct(m.alias("_match"), p.alias("_seg")))))
        .select(*ids.values(), "_seg", "_match.*")
        .select(
            *[F.col(i).alias(k) for k, i in ids.items()],
            *[
                c.alias(f"match_{n}" if n in ids else n)
                for n, c in {
                    "seg_no": F.col("_seg.seg_no"),
                    "seg_start": F.col("_seg.seg_start"),
                    "doc_start": F.col("start"),
                    "start": F.col("start") - F.col("_seg.seg_start"),
                    "end": F.col("end") - F.col("_seg.seg_start"),
                    **{n: F.col(n) for n in PATTERN_COLUMNS},
                }.items()
            ],
        )
    )
