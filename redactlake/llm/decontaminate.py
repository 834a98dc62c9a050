"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every word is a 64-bit hash. Of each run of ``w`` neighbouring k-grams the least (leftmost if tied) is
kept as a fingerprint, on both sides alike, so any span of ``k + w - 1`` words that a document shares
with an item has a fingerprint in common. Fingerprints are joined, and each hit is extended word by
word to both sides; what reaches the window length is a shared span.

The window is 10 words, or a whole item that has fewer. Each window length in use has its own k and w
with k + w - 1 equal to it, so short items are found as surely as long ones.

The item side is measured. Up to ``MAX_BROADCAST_BYTES`` it is broadcast, and texts, word arrays and
unmatched fingerprints never move: one shuffle of a row per document and hit. Beyond, fingerprints and
the few words around them are joined by shuffle; hot fingerprints are split by adaptive skew handling.

A null text has no words. Documents are told apart by row, so repeated or null ids are separate
results. Items without id or words are no items; several items of one id count as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
MAX_BROADCAST_BYTES = 32 << 20

#: What stands between words, before lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text, A-Z in lower case."""

    def lower(w: Column) -> Column:
        # Only of an ASCII word may the general lower-case function be used.
        return F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))

    parts = F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda w: w != "")
    return F.transform(parts, lambda w: F.xxhash64(lower(w)))


def gram_size(window: int) -> int:
    """k for a window length; the number of k-grams in a winnowing run is ``window - k + 1``."""
    return max(1, 2 * window // 5)


def grams(words: Column, k: int) -> Column:
    """The k-gram hash that begins at each word; null where fewer than k words are left."""

    def gram(first: Column, i: Column) -> Column:
        for m in range(1, k):
            x = F.get(words, i + m)
            turn = 64 * m // k
            first = first.bitwiseXOR(F.shiftleft(x, turn).bitwiseOR(F.shiftrightunsigned(x, 64 - turn)))
        return first

    return F.transform(words, gram)


def _chain(holds: Callable[[int], Column], most: int) -> Column:
    """How many of ``holds(0), holds(1), ...`` are true before the first that is not."""
    out = F.lit(most)
    for m in reversed(range(most)):
        out = F.when(F.coalesce(holds(m), F.lit(False)), out).otherwise(F.lit(m))
    return out


def _selected(prints: Column, at: Column, window: int) -> Column:
    """Whether the gram at ``at`` is the least, leftmost if tied, of some run of neighbouring grams."""
    most = window - gram_size(window)
    own = F.get(prints, at)
    left = _chain(lambda m: F.get(prints, at - (m + 1)) > own, most)
    right = _chain(lambda m: F.get(prints, at + (m + 1)) >= own, most)
    return own.isNotNull() & (left + right >= most)


def fingerprints(worded: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows (all columns but ``words``, length, at, gram, left, right) of the fingerprints, for each window length.

    ``at`` is the 0-based place of the gram; ``left`` (nearest first) and ``right`` are the words around it, as far as a
    window may reach, null where there is none. Fingerprints are chosen inside the row, in time and memory linear in its
    words. Each row of ``worded`` also comes once with ``at`` -1.
    """
    words, kind = F.col("words"), "array<bigint>"
    own = F.struct(
        F.lit(0).alias("length"),
        F.lit(-1).alias("at"),
        F.lit(None).cast("bigint").alias("gram"),
        F.lit(None).cast(kind).alias("left"),
        F.lit(None).cast(kind).alias("right"),
    )
    chosen = [F.array(own)]
    named = worded.withColumns({f"prints_{n}": grams(words, gram_size(n)) for n in lengths})
    for n in lengths:
        found = _fingerprints_in_row(words, F.col(f"prints_{n}"), n)
        chosen.append(F.when(F.size(words) >= n, found).otherwise(F.array()))
    columns = [F.col(f"`{c}`") for c in worded.columns if c != "words"]
    return named.select(*columns, F.explode(F.concat(*chosen)).alias("print")).select(*columns, "print.*")


def _fingerprints_in_row(words: Column, prints: Column, length: int) -> Column:
    """array<struct<length, at, gram, left, right>> of one window length."""

    def fingerprint(at: Column) -> Column:
        left, right = (F.array(*side).cast("array<bigint>") for side in around(words, at, length))
        return F.struct(F.lit(length).alias("length"), at.alias("at"), F.get(prints, at).alias("gram"), left.alias("left"), right.alias("right"))

    places = F.sequence(F.lit(0), F.size(words) - 1)
    return F.transform(F.filter(places, lambda at: _selected(prints, at, length)), fingerprint)


def around(words: Column, at: Column, length: int) -> tuple[list[Column], list[Column]]:
    """The words before (nearest first) and after a k-gram, as far as a window may reach; null where there is none."""
    k = gram_size(length)
    return [F.get(words, at - (1 + m)) for m in range(length - k)], [F.get(words, at + (k + m)) for m in range(length - k)]


def _reach(mine: str, theirs: str, most: int) -> Column:
    """How many words in a row agree."""
    return _chain(lambda m: F.get(F.col(mine), F.lit(m)) == F.get(F.col(theirs), F.lit(m)), most)


def item_fingerprints(items: DataFrame, item: str, text: str) -> DataFrame:
    """(length, gram, left, right, items): one row per distinct fingerprint and context."""
    words = items.filter(F.col(item).isNotNull()).select(F.col(item).alias("item"), word_hashes(F.col(text)).alias("words"))
    sized = words.withColumn("n", F.size("words")).filter("n > 0")
    # An item has one window length: its own number of words, or the common one.
    rows = fingerprints(sized, list(range(1, WINDOW + 1)))
    rows = rows.filter((F.col("at") >= 0) & (F.col("length") == F.least("n", F.lit(WINDOW))))
    return rows.groupBy("length", "gram", "left", "right").agg(F.collect_set("item").alias("items"))


def find_hits(
    docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """All of ``docs`` but ``text``, with ``n_words``, ``spans`` (begin, end of shared spans) and ``items``.

    Other columns ride along; those called ``n_words``, ``spans`` or ``items`` are replaced.
    """
    prints = item_fingerprints(items, item, item_text)
    weight = F.lit(300) + 16 * F.size("items") + F.aggregate("items", F.lit(0), lambda n, i: n + F.octet_length(i.cast("string")))
    size = prints.groupBy("length").agg(F.sum(weight).alias("bytes")).collect()
    lengths = sorted(r["length"] for r in size)
    small = sum(r["bytes"] for r in size) <= max_broadcast_bytes
    prints = prints.select(*[F.col(c).alias(f"i_{c}") for c in prints.columns])

    kept = [c for c in docs.columns if c != text and c.lower() not in ("n_words", "spans", "items")]
    rest = F.struct(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own"))
    worded = docs.select(rest.alias("doc"), word_hashes(F.col(text)).alias("words"))
    rows = fingerprints(worded.withColumn("n_words", F.size("words")), lengths)
    match = (F.col("length") == F.col("i_length")) & (F.col("gram") == F.col("i_gram"))
    joined = rows.join(F.broadcast(prints) if small else prints, match, "left")
    # A document's own row stays; other fingerprints only with a partner.
    joined = joined.filter(F.col("i_gram").isNotNull() | (F.col("at") < 0))
    begin, end = F.lit(None).cast("int"), F.lit(None).cast("int")
    for n in lengths:
        k = gram_size(n)
        here = F.col("length") == n
        begin = F.when(here, F.col("at") - _reach("left", "i_left", n - k)).otherwise(begin)
        end = F.when(here, F.col("at") + k + _reach("right", "i_right", n - k)).otherwise(end)
    spans = joined.select("doc", "n_words", "at", "length", "i_items", begin.alias("begin"), end.alias("end"))
    spans = spans.filter((F.col("at") < 0) | (F.col("end") - F.col("begin") >= F.col("length")))
    hit = F.col("at") >= 0
    by_doc = spans.groupBy("doc").agg(
        F.max("n_words").cast("bigint").alias("n_words"),
        F.collect_set(F.when(hit, F.struct("begin", "end"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("i_items"))))).alias("items"),
    )
    columns = [F.col(f"doc.own.`{c}`") for c in kept]
    return by_doc.select(*columns, "n_words", "spans", "items")


def covered(spans: Column) -> Column:
    """How many places lie in at least one of the spans."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("upto"))

    def add(seen: Column, s: Column) -> Column:
        new = F.greatest(F.lit(0), s["end"] - F.greatest(s["begin"], seen["upto"]))
        return F.struct((seen["total"] + new).alias("total"), F.greatest(seen["upto"], s["end"]).alias("upto"))

    return F.aggregate(F.array_sort(spans), start, add)["total"]
