"""Phrase collocation mining as SETM: sorted occurrence relations, extended by merge joins.

Texts are cut into pieces at ``.,;:!?`` and line ends, and pieces into words. The occurrence relation
R1 holds (place, word) of every word, sorted and stored in blocks of whole texts; places run through a
block and skip one number at the end of every piece, so two words are neighbours in a piece exactly
where their places differ by one. From the stored R(k) the merge join of places p and p + 1 gives the
occurrences of longer phrases; they are counted per group (combined in each task, then summed by Spark),
the groups that are frequent enough become the table G(k + 1), and a semi-join with it leaves R(k + 1),
which is stored before the next length starts. A phrase is only extended by frequent phrases, as
every part of a frequent phrase is frequent.

The semi-join sends the ids of the frequent groups to all tasks while they are at most ``MAX_SENT`` (16 MB);
beyond that, the distinct ids of each block are joined with them by shuffle and brought back to the block.
Both give the same rows. No group function sees more than one block.

Words (with their language) and phrases are known by 64-bit hashes while counting; two distinct ones of n
are mistaken for each other with a chance of about n*n / 2**65. Counts and scores are exact.

Null texts have no word; a null language is ``und``, and one called so is the same. Repeated rows count
each time; ids are not looked at. Ties rank by phrase. An empty table gives no row. A text is cut by the task
that reads it, so a piece may be as long as a text; it then makes a block of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K

PIECE_END = np.zeros(256, bool)
PIECE_END[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
WORD_END = PIECE_END.copy()
WORD_END[[9, 32]] = True
NO_LANGUAGE = "und"
#: Frequent groups sent to every task; more are joined by shuffle.
MAX_SENT = 1 << 21
#: Groups that a task holds before it passes their counts on.
HELD_GROUPS = 1 << 17
#: Bytes of text whose words make a block; a longer text makes one by itself.
BLOCK_BYTES = 1 << 20
#: Parts of each language ranked apart before their best are ranked together.
RANKED_PARTS = 64
_BLOCK = "block bigint, places binary, ids binary"
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def pair_ids(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The id of a phrase from the ids of its first and last parts, each one word shorter."""
    return K.mix(left * _FOLD + right)


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Combined:
    """Counts per group, held by a task until there are many."""

    def __init__(self, kinds: list[pa.DataType]):
        self.kinds = kinds
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, ids: np.ndarray, counts: np.ndarray, *attributes: pa.Array) -> None:
        self.parts.append((ids, counts, attributes))
        self.size += len(ids)

    def fold(self) -> None:
        if len(self.parts) > 1:
            ids = np.concatenate([p[0] for p in self.parts])
            distinct, first, which = np.unique(ids, return_index=True, return_inverse=True)
            counts = np.bincount(which, weights=np.concatenate([p[1] for p in self.parts])).astype(np.int64)
            where = pa.array(first)
            attributes = tuple(
                pa.concat_arrays([p[2][i] for p in self.parts]).take(where) for i in range(len(self.kinds))
            )
            self.parts, self.size = [(distinct, counts, attributes)], len(distinct)

    def rows(self, always: bool):
        """(id, attributes, n) columns, if there are many groups or none is to come."""
        if self.size < 2 * HELD_GROUPS and not always:
            return
        self.fold()
        if self.size and (always or self.size >= HELD_GROUPS):
            ids, counts, attributes = self.parts[0]
            self.parts, self.size = [], 0
            yield [pa.array(_signed(ids)), *attributes, pa.array(counts)]


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of ``schema`` whose other columns are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
    )


def _block_rows(schema: pa.Schema, block: int, places: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return _batch(
        schema,
        block=pa.array([block], pa.int64()),
        places=pa.array([places.astype("<i4").tobytes()], pa.binary()),
        ids=pa.array([ids.astype("<u8").tobytes()], pa.binary()),
    )


# --- R1: words ---------------------------------------------------------------------------

_WORDS = pa.schema(
    [("block", pa.int64()), ("places", pa.binary()), ("ids", pa.binary())]
    + [("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]
)


def occurrences(texts: K.Texts, language: np.ndarray) -> tuple[np.ndarray, np.ndarray, K.Texts, K.Words]:
    """(places, ids) of all words, in order; ``language`` is a hash per text."""
    low = texts.lower()
    words = K.words_of(low, WORD_END)
    of = words.text_of()
    ends = np.concatenate(([0], np.cumsum(PIECE_END[low.data])))[words.start]
    opens = np.ones(len(words), np.int64)
    opens[1:] = (ends[1:] != ends[:-1]) | (of[1:] != of[:-1])
    ids = K.mix(K.word_hashes(low, words) * _FOLD + language[of]) if len(words) else np.zeros(0, np.uint64)
    return np.arange(len(words)) + np.cumsum(opens), ids, low, words


def _word_texts(low: K.Texts, words: K.Words, which: np.ndarray) -> pa.Array:
    start, lengths = words.start[which], (words.end - words.start)[which]
    ends = np.cumsum(lengths)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - lengths), lengths)
    return K.binaries(np.concatenate(([0], ends)), low.data[at]).cast(pa.large_string()).cast(pa.string())


def scan(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """R1 as block rows (block, places, ids), and rows of word counts (id, lang, word, n)."""

    def run(batches):
        held = _Combined([pa.string(), pa.string()])
        block = TaskContext.get().partitionId() << 32

        def counted(always=False):
            for ids, langs, words, n in held.rows(always):
                yield _batch(_WORDS, id=ids, lang=langs, word=words, n=n)

        for batch in batches:
            for piece in K.slices(batch, "x", BLOCK_BYTES):
                coded = piece.column(0).dictionary_encode()
                names = coded.dictionary.cast(pa.string())
                spelled = K.texts_of(names)
                hashes = K.span_hashes(K.prefix_hashes(spelled.data), spelled.bounds[:-1], spelled.bounds[1:])
                code = coded.indices.to_numpy(zero_copy_only=False)
                places, ids, low, words = occurrences(K.texts_of(piece.column(1)), hashes[code])
                if len(ids):
                    distinct, first, n = np.unique(ids, return_index=True, return_counts=True)
                    langs = names.take(pa.array(code[words.text_of()[first]]))
                    held.add(distinct, n, langs, _word_texts(low, words, first))
                    yield _block_rows(_WORDS, block, places, ids)
                    block += 1
                    yield from counted()
        yield from counted(always=True)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("l"), F.col(text).alias("x"))
    return rows.mapInArrow(run, f"{_BLOCK}, id bigint, lang string, word string, n bigint")


# --- from R(k - 1) to R(k), and the counts of k + 1 -----------------------------------------

_RELATION = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("ids", pa.binary())])


def merge_join(places: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, left, right) of the occurrences that stand side by side; both sides are in order of place."""
    at = np.flatnonzero(places[1:] - places[:-1] == 1)
    return places[at], ids[at], ids[at + 1]


def _stored(block: pa.RecordBatch | pa.Table, row: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(block.column(c)[row].as_buffer(), t) for c, t in (("places", "<i4"), ("ids", "<u8")))


def _relation(block: pa.RecordBatch | pa.Table, row: int, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The occurrences a block row stands for: its words, or the phrases made of neighbours in it."""
    places, ids = _stored(block, row)
    if words:
        return places, ids
    places, left, right = merge_join(places, ids)
    return places, pair_ids(left, right)


def _members(ids: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which ``ids`` are in the ascending ``frequent``."""
    if not len(frequent):
        return np.zeros(len(ids), bool)
    return frequent[np.minimum(np.searchsorted(frequent, ids), len(frequent) - 1)] == ids


def extend(blocks: DataFrame, frequent: DataFrame, words: bool, max_sent: int = MAX_SENT) -> DataFrame:
    """R(k) as block rows, from R1 (``words``) or R(k - 1) and the ids of the ``frequent`` phrases of length k."""
    blocks = blocks.select("block", "places", "ids")
    if frequent.count() > max_sent:
        return _extend_by_shuffle(blocks, frequent, words)
    ids = frequent.select("id").toArrow().column("id").to_numpy().view(np.uint64)
    shared = blocks.sparkSession.sparkContext.broadcast(np.sort(ids))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                places, ids = _relation(batch, row, words)
                stay = _members(ids, shared.value)
                if stay.any():
                    yield _block_rows(_RELATION, batch.column("block")[row].as_py(), places[stay], ids[stay])

    return blocks.mapInArrow(run, _BLOCK)


def _extend_by_shuffle(blocks: DataFrame, frequent: DataFrame, words: bool) -> DataFrame:
    def distinct_ids(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids = np.unique(_relation(batch, row, words)[1])
                block = np.full(len(ids), batch.column("block")[row].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(_signed(ids))], ["block", "id"])

    def run(key, block, found):
        if not block.num_rows or not found.num_rows:
            return _RELATION.empty_table()
        places, ids = _relation(block, 0, words)
        stay = _members(ids, np.sort(found.column("id").to_numpy().view(np.uint64)))
        return pa.Table.from_batches([_block_rows(_RELATION, key[0].as_py(), places[stay], ids[stay])])

    have = blocks.mapInArrow(distinct_ids, "block bigint, id bigint")
    kept = have.join(frequent.select("id"), "id", "left_semi")
    return blocks.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(run, _BLOCK)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(left, right, n) of the neighbours in R(k), combined in each task."""

    def run(batches):
        held = _Combined([pa.int64(), pa.int64()])

        def counted(always=False):
            for _, left, right, n in held.rows(always):
                yield pa.RecordBatch.from_arrays([left, right, n], ["left", "right", "n"])

        for batch in batches:
            for row in range(batch.num_rows):
                _, left, right = merge_join(*_stored(batch, row))
                distinct, first, n = np.unique(pair_ids(left, right), return_index=True, return_counts=True)
                held.add(distinct, n, pa.array(_signed(left[first])), pa.array(_signed(right[first])))
                yield from counted()
        yield from counted(always=True)

    return blocks.mapInArrow(run, "left bigint, right bigint, n bigint")


# --- the tables of frequent phrases, and the result ---------------------------------------------


def frequent_words(rows: DataFrame, min_count: int) -> DataFrame:
    """G1: (id, lang, phrase, last, a, heads, tails)."""
    counts = rows.filter("id is not null").groupBy("id", "lang", "word").agg(F.sum("n").alias("a"))
    one = F.array("a")
    return counts.filter(F.col("a") >= min_count).select(
        "id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", one.alias("heads"), one.alias("tails")
    )


def frequent_phrases(pairs: DataFrame, shorter: DataFrame, min_count: int) -> DataFrame:
    """G(k) from the counts of pairs in R(k - 1) and G(k - 1).

    ``heads`` has the counts of the phrase's first 1, 2, ... words, ``tails`` those of its last ones.
    """

    def with_ids(batches):
        for batch in batches:
            left, right = (batch.column(c).to_numpy().view(np.uint64) for c in ("left", "right"))
            yield K.added(batch, id=pa.array(_signed(pair_ids(left, right))))

    counts = pairs.groupBy("left", "right").agg(F.sum("n").alias("a")).filter(F.col("a") >= min_count)
    counts = counts.mapInArrow(with_ids, "left bigint, right bigint, a bigint, id bigint")
    first = shorter.select(F.col("id").alias("left"), "lang", "phrase", "heads")
    rest = shorter.select(F.col("id").alias("right"), "last", "tails")
    return (
        counts.join(first, "left")
        .join(rest, "right")
        .select(
            "id",
            "left",
            "right",
            "lang",
            F.concat_ws(" ", "phrase", "last").alias("phrase"),
            "last",
            "a",
            F.concat("heads", F.array("a")).alias("heads"),
            F.concat("tails", F.array("a")).alias("tails"),
        )
    )


def _exact(c: Column) -> Column:
    """Counts as decimals, so that products may pass 64 bits."""
    return c.cast("decimal(20,0)")


def lowest_cut(k: int) -> Column:
    """struct<score, cut, l, r> of the cut that scores least, the first of equals."""
    cuts = []
    for j in range(1, k):
        l, r = F.col("heads")[j - 1], F.col("tails")[k - j - 1]
        score = F.call_function("div", F.lit(2_000_000).cast("decimal(8,0)") * _exact(F.col("a")), _exact(l) + _exact(r))
        cuts.append(F.struct(score.alias("score"), F.lit(j).alias("cut"), l.alias("l"), r.alias("r")))
    return F.array_min(F.array(*cuts))


def not_inside(phrases: DataFrame, longer: DataFrame, percent: int) -> DataFrame:
    """The phrases that lie in no longer one with at least ``percent`` of their count.

    Those one word longer suffice: what holds a phrase holds one of them, which is at least as frequent.
    """
    parts = longer.select(F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("above"))
    above = parts.groupBy("id").agg(F.max("above").alias("above"))
    inside = F.lit(100).cast("decimal(3,0)") * _exact(F.col("above")) >= F.lit(percent).cast("decimal(3,0)") * _exact(F.col("a"))
    return phrases.join(above, "id", "left").filter(~F.coalesce(inside, F.lit(False))).drop("above")


def mine(
    docs: DataFrame,
    folder: str,
    text: str = "text",
    lang: str = "lang",
    min_count: int = 30,
    longest: int = 4,
    per_lang: int = 2000,
    inside_percent: int = 80,
    max_sent: int = MAX_SENT,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    ``folder`` (shared, new) takes the relations. A phrase of count ``a`` whose parts at a cut occur
    ``l`` and ``r`` times scores ``2000000 * a // (l + r)`` there; the lowest cut counts. ``n`` is the number
    of words of the language.
    """
    scanned = _write(scan(docs, text, lang), f"{folder}/words")
    totals = scanned.filter("id is not null").groupBy("lang").agg(F.sum("n").alias("words"))
    tables = [_write(frequent_words(scanned, min_count), f"{folder}/frequent-1")]
    blocks = scanned.filter("block is not null")
    for k in range(1, longest):
        blocks = _write(extend(blocks, tables[-1], k == 1, max_sent), f"{folder}/relation-{k}")
        tables.append(_write(frequent_phrases(pair_counts(blocks), tables[-1], min_count), f"{folder}/frequent-{k + 1}"))
    scored = None
    for k in range(2, longest + 1):
        found = tables[k - 1] if k == longest else not_inside(tables[k - 1], tables[k], inside_percent)
        found = found.select("id", "lang", "phrase", "a", lowest_cut(k).alias("cut"))
        scored = found if scored is None else scored.unionByName(found)
    scored = scored.select("id", "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # The best of each part first, so that no task ranks a whole language.
    part = F.pmod(F.col("id"), F.lit(RANKED_PARTS))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best))).filter(F.col("rank") <= per_lang)
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= per_lang)
    return scored.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score"
    )
