"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each present or not: its words, pairs of neighbouring words, pairs with one
word between (skip-grams), and word heads, the first four, five and six bytes of longer words.
Every one is hashed to a bucket. FTRL-proximal gives each bucket its own learning rate, and its L1
term keeps the weights of nearly all at zero; what is left is small enough to broadcast.

Null and empty texts have no feature and get the score of the bias alone. Without training rows
every score is 0. Row order, repeats and other columns stay; columns already called ``toxicity`` or
``toxic`` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .sampling import MAX_SAMPLE_CHARS, sample_rows

BUCKET_BITS = 22
SAMPLE_PER_LABEL = 3_000
THRESHOLD = 0.7
HEADS = (4, 5, 6)
#: Features of fewer training texts than this are left out.
LEAST_TEXTS = 3


def features(texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every feature occurrence, in no particular order."""
    low = texts.lower()
    words = K.words_of(low, K.NON_WORD)
    prefix = K.prefix_hashes(low.data)
    hashes = K.span_hashes(prefix, words.start, words.end)
    text_of = words.text_of()
    kinds, owners = [hashes], [text_of]
    for gap in (1, 2):
        if len(hashes) > gap:
            same = text_of[:-gap] == text_of[gap:]
            kinds.append((hashes[:-gap] * np.uint64(2 * gap + 1) + hashes[gap:])[same])
            owners.append(text_of[:-gap][same])
    for size in HEADS:
        longer = words.end - words.start > size
        kinds.append(K.span_hashes(prefix, words.start[longer], words.start[longer] + size))
        owners.append(text_of[longer])
    buckets = [
        ((h * np.uint64(0xD6E8FEB86659FD93 + 2 * i)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        for i, h in enumerate(kinds)
    ]
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """Buckets with a weight, in ascending order, their weights, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BUCKET_BITS, np.float32)
        out[self.buckets] = self.weights
        return out


def score_texts(texts: K.Texts, dense: np.ndarray, bias: float) -> np.ndarray:
    bucket, owner = features(texts)
    hit = dense[bucket] != 0
    pairs = np.unique((owner[hit].astype(np.int64) << BUCKET_BITS) | bucket[hit])
    sums = np.bincount(pairs >> BUCKET_BITS, dense[pairs & ((1 << BUCKET_BITS) - 1)], len(texts))
    return 1 / (1 + np.exp(-np.clip(sums + bias, -35, 35)))


def train_on(
    texts: list[str],
    labels: list[int],
    epochs: int = 4,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 3.0,
    l2: float = 0.1,
    seed: int = 7,
) -> Model:
    """FTRL-proximal, one text at a time."""
    none = Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -35.0)
    if not texts:
        return none
    z = np.zeros(1 << BUCKET_BITS, np.float32)
    n = np.zeros(1 << BUCKET_BITS, np.float32)
    bias_z = bias_n = 0.0
    rows = []
    seen = np.zeros(1 << BUCKET_BITS, np.int32)
    for begin in range(0, len(texts), 200):
        bucket, owner = features(K.texts_of(pa.array(texts[begin : begin + 200], pa.large_string())))
        pairs = np.unique((owner.astype(np.int64) << BUCKET_BITS) | bucket)
        cuts = np.searchsorted(pairs >> BUCKET_BITS, np.arange(min(200, len(texts) - begin) + 1))
        flat = (pairs & ((1 << BUCKET_BITS) - 1)).astype(np.int32)
        rows += [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        seen += np.bincount(flat, minlength=1 << BUCKET_BITS).astype(np.int32)
    # A feature of one or two texts can only be learned by heart.
    rows = [r[seen[r] >= LEAST_TEXTS] for r in rows]
    order = np.arange(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            at = rows[i]
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = -(zi - np.sign(zi) * l1) / ((beta + root) / alpha + l2) * (np.abs(zi) > l1)
            bias = -bias_z / ((beta + bias_n**0.5) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[i]
            grown = np.sqrt(ni + g * g)
            z[at] = zi + g - (grown - root) / alpha * w
            n[at] = ni + g * g
            step = ((bias_n + g * g) ** 0.5 - bias_n**0.5) / alpha
            bias_z += g - step * bias
            bias_n += g * g
    live = np.flatnonzero(np.abs(z) > l1)
    weights = -(z[live] - np.sign(z[live]) * l1) / ((beta + np.sqrt(n[live])) / alpha + l2)
    return Model(live, weights.astype(np.float32), float(-bias_z / ((beta + bias_n**0.5) / alpha)))


def train(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_label: int = SAMPLE_PER_LABEL
) -> Model:
    """Learn from at most about ``per_label`` labelled rows of each class, of at most 20,000 characters each.

    ``labels`` (key, label) names the rows to learn from; several labels of a key count as the
    highest. The sampled keys are few by construction, so they are broadcast to the documents.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias(label))
    chosen = F.broadcast(sample_rows(known, label, key, per_label))
    usable = docs.select(key, text).filter((F.length(text) > 0) & (F.length(text) <= MAX_SAMPLE_CHARS))
    sample = usable.join(chosen, key).orderBy(F.xxhash64(key), text).toArrow()
    return train_on(sample.column(text).to_pylist(), sample.column(label).to_pylist())


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``toxicity`` (0 to 1) and ``toxic`` (1 from the threshold on)."""
    docs = K.without(docs, "toxicity", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        dense = m.dense()

        def work(batch, texts):
            p = score_texts(texts, dense, m.bias)
            yield K.added(batch, toxicity=p, toxic=(p >= threshold).astype(np.int32))

        return K.map_slices(text, work)(batches)

    return docs.mapInArrow(run, K.schema_with(docs, "toxicity double, toxic int"))
