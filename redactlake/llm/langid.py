"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

Subwords are the runs of three and of four bytes of the lower-cased text, all its digits, signs and
white space being one blank. Each is hashed to a row of an embedding table; a text is the mean of
its rows, and a linear softmax on that mean gives the languages. Table and softmax are trained
together by stochastic gradient descent in numpy on snippets of a bounded sample; a temperature and
a rejection threshold are then fitted on sample documents kept out of training.

As both layers are linear, they are multiplied into one (subword, language) table for scoring.

Texts that are null or hold no letter get ``und``, score 0, and are rejected. Without training
rows every text is ``und``. Row order, repeats and other columns stay; columns already called like the
added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .sampling import MAX_SAMPLE_CHARS, sample_rows

BUCKET_BITS = 16
DIMENSIONS = 16
SAMPLE_PER_LANGUAGE = 600
#: Share of known-language documents the rejection threshold may turn away.
REJECT_SHARE = 0.001
MAX_THRESHOLD = 0.5
UNKNOWN = "und"

_BLANK = np.full(256, 32, np.uint8)
_BLANK[97:123] = np.arange(97, 123)
_BLANK[128:] = np.arange(128, 256)


def subwords(texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every three and four bytes of every text, and the bounds by text.

    Runs that are blank throughout don't count; one text's runs don't reach into the next.
    """
    data = _BLANK[texts.data].astype(np.uint32)
    n = len(data)
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(texts.bounds))
    buckets, owners = [], []
    for size, seed in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
        if n < size:
            continue
        key = data[: n - size + 1].copy()
        for j in range(1, size):
            key |= data[j : n - size + 1 + j] << np.uint32(8 * j)
        blank = np.uint32(0x20202020 & ((1 << (8 * size)) - 1))
        own = text_of[: n - size + 1]
        ok = (own == text_of[size - 1 :]) & (key != blank)
        key = key[ok] * np.uint32(seed)
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x2C1B3C6D)
        buckets.append((key >> np.uint32(32 - BUCKET_BITS)).astype(np.int32))
        owners.append(own[ok])
    if len(buckets) < 2:
        flat, owner = (buckets[0], owners[0]) if buckets else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    else:
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        flat, owner = np.concatenate(buckets)[order], owner[order]
    return flat, np.searchsorted(owner, np.arange(len(texts) + 1))


def lowered(column: pa.Array) -> K.Texts:
    return K.texts_of(pc.utf8_lower(column.fill_null("")))


def subwords_of(texts: list[str], at_once: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """``subwords`` of texts in memory, a few at a time."""
    parts, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for begin in range(0, len(texts), at_once):
        flat, bounds = subwords(lowered(pa.array(texts[begin : begin + at_once], pa.large_string())))
        parts.append(flat)
        counts.append(np.diff(bounds))
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def _sums(rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bounds) - 1, rows.shape[1]), np.float64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(rows, bounds[full], axis=0)
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: K.Texts) -> np.ndarray:
        flat, bounds = subwords(texts)
        means = _sums(self.table[flat], bounds) / np.maximum(np.diff(bounds), 1)[:, None]
        return means + self.bias

    def probabilities(self, texts: K.Texts) -> np.ndarray:
        return _softmax(self.logits(texts) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def has_letter(texts: K.Texts, column: pa.Array) -> np.ndarray:
    """Whether each text holds a letter of any alphabet."""
    ascii_letter = (texts.data >= 97) & (texts.data <= 122)
    found = np.diff(np.concatenate(([0], np.cumsum(ascii_letter)))[texts.bounds]) > 0
    for i in np.flatnonzero(~found & (np.diff(texts.bounds) > 0)):
        found[i] = any(map(str.isalpha, column[int(i)].as_py() or ""))
    return found


def train_on(
    texts: list[str], labels: list[str], epochs: int = 6, rate: float = 8.0, seed: int = 7
) -> Model:
    """Fit on whole documents held in memory; a fifth of them is kept for calibration."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 1), np.float32), np.zeros(1))
    rng = np.random.default_rng(seed)
    target = np.array([languages.index(x) for x in labels])
    kept_out = np.arange(len(texts)) % 5 == 4 if len(texts) >= 10 else np.zeros(len(texts), bool)
    flat, bounds = subwords_of(texts)
    embedding = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    softmax = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    softmax += rng.normal(0, 0.1, softmax.shape).astype(np.float32)
    training = np.flatnonzero(~kept_out & (np.diff(bounds) > 0))
    steps, done = epochs * max(1, len(training)), 0
    for _ in range(epochs):
        rng.shuffle(training)
        for begin in range(0, len(training), 16):
            docs = training[begin : begin + 16]
            # Snippets of 8 to 256 subwords, so short texts are met in training too.
            sizes = np.minimum(np.diff(bounds)[docs], rng.integers(8, 256, len(docs)))
            starts = bounds[docs] + (rng.random(len(docs)) * (np.diff(bounds)[docs] - sizes + 1)).astype(np.int64)
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            rows = flat[np.arange(cuts[-1]) + np.repeat(starts - cuts[:-1], sizes)]
            mean = _sums(embedding[rows], cuts) / sizes[:, None]
            error = _softmax(mean @ softmax + bias)
            error[np.arange(len(docs)), target[docs]] -= 1
            step = rate * (1 - done / steps) / len(docs)
            back = (error @ softmax.T) / sizes[:, None]
            softmax -= (step * (mean.T @ error)).astype(np.float32)
            bias -= (0.01 * step * error.sum(axis=0)).astype(np.float32)
            np.subtract.at(embedding, rows, np.repeat(step * len(docs) * back, sizes, axis=0).astype(np.float32))
            done += len(docs)
    model = Model(languages, embedding @ softmax, bias.astype(np.float64))
    _calibrate(model, [texts[i] for i in np.flatnonzero(kept_out)], target[kept_out])
    return model


def _calibrate(model: Model, texts: list[str], target: np.ndarray) -> None:
    """The temperature of least log loss, and the threshold that few known documents fall under."""
    if not texts:
        return
    logits = np.concatenate(
        [model.logits(lowered(pa.array(texts[i : i + 64], pa.large_string()))) for i in range(0, len(texts), 64)]
    )
    losses = {}
    for t in np.geomspace(0.05, 5, 40):
        p = _softmax(logits / t)
        losses[t] = -np.log(np.maximum(p[np.arange(len(p)), target], 1e-12)).mean()
    model.temperature = float(min(losses, key=losses.get))
    best = _softmax(logits / model.temperature).max(axis=1)
    model.threshold = float(min(MAX_THRESHOLD, np.quantile(best, REJECT_SHARE)))


def train(rows: DataFrame, key: str, text: str, label: str, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from a sample of at most about ``per_language`` rows of each language, of at most 20,000 characters each."""
    usable = rows.filter(F.col(label).isNotNull() & (F.length(text) > 0) & (F.length(text) <= MAX_SAMPLE_CHARS))
    sample = sample_rows(usable.select(key, text, label), label, key, per_language).orderBy(F.xxhash64(key), text).toArrow()
    return train_on(sample.column(text).to_pylist(), sample.column(label).to_pylist())


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``lang_score`` (the calibrated probability) and ``lang_rejected``."""
    docs = K.without(docs, "lang_pred", "lang_score", "lang_rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch, texts):
        m = shared.value
        column = batch.column(batch.schema.get_field_index(text))
        low = lowered(column)
        known = has_letter(low, column) & bool(m.languages)
        p = m.probabilities(low)
        best, score = p.argmax(axis=1), np.where(known, p.max(axis=1), 0.0)
        names = np.array([*m.languages, UNKNOWN], object)
        yield K.added(
            batch,
            lang_pred=pa.array(np.where(known, names[best], UNKNOWN), pa.string()),
            lang_score=score,
            lang_rejected=~known | (score < m.threshold),
        )

    return docs.mapInArrow(
        K.map_slices(text, work), K.schema_with(docs, "lang_pred string, lang_score double, lang_rejected boolean")
    )
