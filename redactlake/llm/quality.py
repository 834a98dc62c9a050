"""Quality rules: document statistics, a few fixed rules, and gradient-boosted trees over the rest.

Words are runs of anything but the six ASCII white-space characters. All statistics come from whole
texts: the slice of a batch is one byte buffer, and lines and word windows are compared by 64-bit
hashes. The trees say how likely a document is labelled good; a share of symbols, of repeated lines,
of repeated words or of capitals can only lower that (monotonic constraints).

Null and empty texts have no words and fail the fixed rules. Without labels of both kinds only the
fixed rules decide. Row order, repeats and other columns stay; columns already called like the added
ones are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt
from . import textkit as K
from .sampling import sample_rows

WINDOW = 8
SAMPLE_PER_LABEL = 5_000
THRESHOLD = 0.5

#: The characters that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_digits", "n_signs", "n_distinct_words", "n_text_chars"]
FEATURES = [
    "log_words",
    "mean_word_chars",
    "symbols_per_word",
    "dup_line_share",
    "repeat_word_share",
    "upper_share",
    "digit_share",
    "sign_share",
    "distinct_share",
    "words_per_line",
]
#: Of these features, more can only mean worse.
MONOTONIC = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1, "upper_share": -1}


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds])


def _groups(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, how many of its text have its hash, and whether it is the first of them."""
    key = hashes ^ K.mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])) if len(key) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    sizes = np.diff(np.concatenate((heads, [len(key)])))
    count, first = np.empty(len(key), np.int64), np.empty(len(key), bool)
    count[order], first[order] = np.repeat(sizes, sizes), new
    return count, first


def statistics(texts: K.Texts) -> dict[str, np.ndarray]:
    data, bounds = texts.data, texts.bounds
    words = K.words_of(texts, K.SPACES)
    n_words = words.counts()
    prefix = K.prefix_hashes(data)
    word_text = words.text_of()
    hashes = K.span_hashes(prefix, words.start, words.end)
    _, first_word = _groups(hashes, word_text)

    inside = ~K.SPACES[data]
    leading = (data & 0xC0) != 0x80
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((bounds[:-1], breaks + 1)))
    owner = np.searchsorted(bounds, starts, "right") - 1
    # A break at the very end of a text starts a line there; it is empty and belongs to no later text.
    ends = np.empty(len(starts), np.int64)
    if len(starts):
        stops = np.sort(np.concatenate((bounds[1:], breaks)))
        ends[:] = np.maximum(stops, starts)
    has_word = np.diff(np.concatenate(([0], np.cumsum(inside)))[np.stack((starts, ends))], axis=0)[0] > 0
    starts, ends, owner = starts[has_word], ends[has_word], owner[has_word]
    _, first_line = _groups(K.span_hashes(prefix, starts, ends), owner)

    grams, gram_bounds = K.gram_hashes(hashes, words.first, WINDOW)
    gram_text = np.repeat(np.arange(len(texts)), np.diff(gram_bounds))
    count, _ = _groups(grams, gram_text)
    at = np.flatnonzero(count > 1) + (words.first[:-1] - gram_bounds[:-1])[gram_text[count > 1]]
    marks = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + WINDOW, minlength=len(words) + 1)[: len(words) + 1]
    repeated = np.cumsum(marks)[: len(words)] > 0

    ascii_sign = inside & (data < 128) & K.NON_WORD[data]
    return {
        "n_words": n_words,
        "word_chars": _per_text(inside & leading, bounds),
        "n_symbols": _per_text(SYMBOLS[data], bounds),
        "n_dup_lines": np.bincount(owner[~first_line], minlength=len(texts)),
        "n_repeat_words": _per_text(repeated, words.first),
        "n_lines": np.bincount(owner, minlength=len(texts)),
        "n_upper": _per_text((data >= 65) & (data <= 90), bounds),
        "n_digits": _per_text((data >= 48) & (data <= 57), bounds),
        "n_signs": _per_text(ascii_sign, bounds),
        "n_distinct_words": np.bincount(word_text[first_word], minlength=len(texts)),
        "n_text_chars": _per_text(leading, bounds),
    }


def add_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns of ``COUNTS`` and ``MORE``, as long; ``text`` goes."""
    docs = K.without(docs, *COUNTS, *MORE)
    rest = K.without(docs, text)

    def work(batch, texts):
        columns = {k: v.astype(np.int64) for k, v in statistics(texts).items()}
        yield K.added(batch.drop_columns([text]), **columns)

    return docs.mapInArrow(K.map_slices(text, work), K.schema_with(rest, ", ".join(f"{c} long" for c in [*COUNTS, *MORE])))


def feature_matrix(columns: dict[str, np.ndarray]) -> np.ndarray:
    c = {k: np.asarray(v, np.float64) for k, v in columns.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]),
            c["word_chars"] / words,
            c["n_symbols"] / words,
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words,
            c["n_upper"] / chars,
            c["n_digits"] / chars,
            c["n_signs"] / chars,
            c["n_distinct_words"] / words,
            words / lines,
        ],
        axis=1,
    )


def base_failed() -> Column:
    """The fixed rules: fewer than 20 words, or over 30 % of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_label: int = SAMPLE_PER_LABEL) -> gbt.Trees | None:
    """Learn from the statistics of at most about ``per_label`` labelled documents of each kind.

    ``labels`` holds (key, label 0/1); several labels of a key count as the lowest. Null if both
    kinds do not occur.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("_label"))
    chosen = F.broadcast(sample_rows(known, "_label", key, per_label))
    stats = add_statistics(docs.select(key, text).join(chosen, key), text).filter(~base_failed())
    rows = stats.orderBy(F.xxhash64(key), "n_words", "word_chars").select("_label", *COUNTS, *MORE).toArrow()
    columns = {c: rows.column(c).to_numpy() for c in rows.schema.names}
    y = columns.pop("_label").astype(np.float64) if rows.num_rows else np.zeros(0)
    if len(y) == 0 or y.min() == y.max():
        return None
    return gbt.fit(feature_matrix(columns), y, {FEATURES.index(k): d for k, d in MONOTONIC.items()})


def judge(stats: DataFrame, model: gbt.Trees | None, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``base_failed``, ``quality`` (the trees' probability) and ``kept`` to rows with statistics."""
    stats = K.without(stats, "base_failed", "quality", "kept")
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        trees = shared.value
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in [*COUNTS, *MORE]}
            x = feature_matrix(columns)
            yield K.added(batch, quality=trees.probabilities(x) if trees else np.ones(len(x)))

    scored = stats.mapInArrow(run, K.schema_with(stats, "quality double"))
    return scored.select("*", base_failed().alias("base_failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= threshold)
    )
