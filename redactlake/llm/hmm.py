"""A hidden Markov language model: Baum-Welch counts summed across partitions, exact forward scores.

Words are known by a 64-bit hash. Documents are packed into blocks: token numbers, and the block's
own vocabulary in hash order. Counting deals the vocabularies out by hash range, adds them up, and
sends each block its words' corpus counts back; the vocabulary is never in one place.

The states emit word classes (a fixed number: the word itself if it is short, else its beginning and
end), and a class emits its words in proportion to their counts plus a half:
P(w | state) = P(class | state) * (c + 0.5) / (sum over the class of c + 0.5). So what a state learns
is bounded, and what a word's probability rests on is its exact count. All unseen words are one event
with the Good-Turing mass of words seen once, the same in every state.

Training starts from a bounded sample of segments and then makes full Baum-Welch passes over all
training tokens, in segments of ``SEGMENT`` tokens: each task sums expected counts, Spark adds them by
class. Scores come from the scaled forward recursion over each whole text, uncut.

Null texts count as empty: one end token. Repeated rows are documents of their own. Without training
documents every token is unseen. An empty table gives no row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

STATES = 8
CLASS_BITS = 16
CLASSES = 1 << CLASS_BITS
UNSEEN, END = 0, 1
SHORT_BYTES = 4
BLOCK_TOKENS = 2_000_000
SEGMENT = 256
BATCH = 4096
SAMPLE_SEGMENTS = 600
PASSES = 2
#: Share of every state's emissions that follows the corpus at large.
BACKGROUND = 0.02
#: Vocabulary rows counted together.
COUNT_ROWS = 500_000

END_HASH = np.uint64(0x9E3779B97F4A7C15)


# --- blocks --------------------------------------------------------------------


def word_classes(prefix: np.ndarray, words: K.Words, hashes: np.ndarray) -> np.ndarray:
    """2 and above: half of the classes for short words, half for the ends of longer ones."""
    length = words.end - words.start
    long = length > SHORT_BYTES
    shape = K.span_hashes(prefix, words.start, words.start + np.minimum(length, 2)) * np.uint64(3)
    shape += K.span_hashes(prefix, words.end - np.minimum(length, 3), words.end)
    half = np.uint64(CLASSES // 2 - 1)
    own = np.where(long, K.mix(shape), hashes) % half
    return (own + np.uint64(2) + long.astype(np.uint64) * half).astype(np.uint16)


class Packer:
    """Collects documents and turns them into block rows."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.clear()

    def clear(self) -> None:
        self.keys, self.training, self.lengths = [], [], []
        self.hashes, self.classes = [], []
        self.size = 0

    def add(self, keys: pa.Array, training: np.ndarray, texts: K.Texts) -> None:
        low = texts.lower()
        words = K.words_of(low, K.SPACES)
        prefix = K.prefix_hashes(low.data)
        hashes = K.span_hashes(prefix, words.start, words.end)
        classes = word_classes(prefix, words, hashes)
        # One end token after the words of each text.
        at = words.first[1:]
        self.hashes.append(np.insert(hashes, at, END_HASH))
        self.classes.append(np.insert(classes, at, END))
        self.lengths.append(words.counts() + 1)
        self.training.append(training)
        self.keys.append(keys)
        self.size += len(self.hashes[-1])

    def block(self, number: int) -> pa.RecordBatch:
        hashes = np.concatenate(self.hashes)
        vocabulary, first, tokens = np.unique(hashes, return_index=True, return_inverse=True)
        lengths, training = np.concatenate(self.lengths), np.concatenate(self.training)
        counted = tokens[np.repeat(training, lengths)]
        keys = pa.concat_arrays(self.keys)
        row = [
            pa.array([number], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
            pa.array([np.packbits(training).tobytes()], pa.binary()),
            pa.array([lengths.astype("<i4").tobytes()], pa.binary()),
            pa.array([tokens.astype("<i4").tobytes()], pa.binary()),
            pa.array([len(vocabulary)], pa.int64()),
            pa.array([vocabulary.astype("<u8").tobytes()], pa.binary()),
            pa.array([np.concatenate(self.classes)[first].astype("<u2").tobytes()], pa.binary()),
            pa.array([np.bincount(counted, minlength=len(vocabulary)).astype("<i4").tobytes()], pa.binary()),
        ]
        self.clear()
        return pa.RecordBatch.from_arrays(row, BLOCK_COLUMNS)


BLOCK_COLUMNS = ["block", "keys", "training", "lengths", "tokens", "n_vocabulary", "vocabulary", "classes", "counts"]


def make_blocks(docs: DataFrame, key: str, text: str, training: str) -> DataFrame:
    """Pack (key, text, training flag) rows into blocks of about ``BLOCK_TOKENS`` tokens."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        task = TaskContext.get().partitionId() << 24
        made, packer = 0, None
        for batch in batches:
            packer = packer or Packer(batch.schema)
            for part in K.slices(batch, "x"):
                packer.add(part.column(0), part.column(2).to_numpy(zero_copy_only=False).astype(bool), K.texts_of(part.column(1)))
                if packer.size >= BLOCK_TOKENS:
                    yield packer.block(task + made)
                    made += 1
        if packer and packer.size:
            yield packer.block(task + made)

    rows = docs.select(
        F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("x"), F.coalesce(F.col(training), F.lit(False)).alias("t")
    )
    schema = (
        f"block bigint, keys array<{kind}>, training binary, lengths binary, tokens binary, n_vocabulary bigint,"
        " vocabulary binary, classes binary, counts binary"
    )
    return rows.mapInArrow(run, schema)


def _ints(value, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


# --- counts ---------------------------------------------------------------------


def count_words(blocks: DataFrame) -> DataFrame:
    """Corpus counts of each block's words, by hash range; rows of block -1 hold sums over the range.

    (block, range, counts, n_tokens, n_distinct, n_single, class_ids, masses)
    """
    rows = blocks.agg(F.coalesce(F.sum("n_vocabulary"), F.lit(0))).first()[0]
    bits = max(4, math.ceil(math.log2(max(1, rows / COUNT_ROWS))))

    def deal(batches):
        edges = (np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.uint64)
        for batch in batches:
            for i in range(batch.num_rows):
                vocabulary, classes, counts = (_ints(batch.column(k)[i], t) for k, t in ((1, "<u8"), (2, "<u2"), (3, "<i4")))
                cuts = np.append(np.searchsorted(vocabulary, edges), len(vocabulary))
                spans = [(r, a, b) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r for r, _, _ in spans], pa.int32()),
                        pa.array([batch.column(0)[i].as_py()] * len(spans), pa.int64()),
                        *(
                            pa.array([x[a:b].tobytes() for _, a, b in spans], pa.binary())
                            for x in (vocabulary, classes, counts)
                        ),
                    ],
                    ["range", "block", "vocabulary", "classes", "counts"],
                )

    def add_up(table: pa.Table) -> pa.Table:
        parts = [[_ints(x, t) for x in table.column(c)] for c, t in (("vocabulary", "<u8"), ("classes", "<u2"), ("counts", "<i4"))]
        words, first, number = np.unique(np.concatenate(parts[0]), return_index=True, return_inverse=True)
        counts = np.bincount(number, np.concatenate(parts[2]), len(words)).astype(np.int64)
        seen = counts > 0
        classes, of = np.unique(np.concatenate(parts[1])[first][seen], return_inverse=True)
        masses = np.bincount(of, counts[seen] + 0.5, len(classes))
        cuts = np.cumsum([len(x) for x in parts[0]])[:-1]
        back = [x.astype("<i8").tobytes() for x in np.split(counts[number], cuts)]
        n = len(back)
        return pa.table(
            {
                "block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()),
                "range": pa.array([table.column("range")[0].as_py()] * (n + 1), pa.int32()),
                "counts": pa.array([*back, None], pa.binary()),
                "n_tokens": pa.array([None] * n + [int(counts.sum())], pa.int64()),
                "n_distinct": pa.array([None] * n + [int(seen.sum())], pa.int64()),
                "n_single": pa.array([None] * n + [int((counts == 1).sum())], pa.int64()),
                "class_ids": pa.array([None] * n + [classes.astype(np.int32)], pa.list_(pa.int32())),
                "masses": pa.array([None] * n + [masses], pa.list_(pa.float64())),
            }
        )

    dealt = blocks.select("block", "vocabulary", "classes", "counts").mapInArrow(
        deal, "range int, block bigint, vocabulary binary, classes binary, counts binary"
    )
    return dealt.groupBy("range").applyInArrow(
        add_up,
        "block bigint, range int, counts binary, n_tokens bigint, n_distinct bigint, n_single bigint,"
        " class_ids array<int>, masses array<double>",
    )


@dataclass
class Corpus:
    """What all tasks need to know of the training tokens; bounded by the number of classes."""

    tokens: int
    distinct: int
    single: int
    masses: np.ndarray

    @property
    def unseen_mass(self) -> float:
        return min(0.5, max(self.single, 1) / (self.tokens + 2))

    @property
    def unseen_words(self) -> float:
        """How many words the unseen event stands for: as many as were seen once, so that each has 1 / (tokens + 2)."""
        return self.unseen_mass * (self.tokens + 2)

    def shares(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of each word's share of its class; the shares of a class, and those of the unseen words, sum to 1."""
        seen = np.log10(counts + 0.5) - np.log10(np.maximum(self.masses, 0.5))[classes]
        return np.where(counts > 0, seen, -math.log10(self.unseen_words))

    def background(self) -> np.ndarray:
        """P(class) over the corpus, for seen words."""
        total = self.masses.sum()
        return self.masses / total if total else np.full(CLASSES, 1 / CLASSES)


def corpus_sums(counts: DataFrame) -> Corpus:
    sums = counts.filter("block = -1")
    n = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_distinct", "n_single"))).first()
    masses = np.zeros(CLASSES)
    by_class = sums.select(F.explode(F.arrays_zip("class_ids", "masses")).alias("x")).groupBy("x.class_ids").agg(F.sum("x.masses")).toArrow()
    masses[by_class.column(0).to_numpy()] = by_class.column(1).to_numpy()
    return Corpus(*n, masses)


# --- the model --------------------------------------------------------------------


@dataclass
class Model:
    start: np.ndarray  # (states): first token of a text
    inner: np.ndarray  # (states): first token of a later segment, in training only
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states): P(class | state)

    @staticmethod
    def of(start, inner, move, emitted: np.ndarray, corpus: Corpus) -> Model:
        """From expected counts; ``emitted`` is (classes, states)."""
        emitted = emitted.copy()
        emitted[UNSEEN] = 0
        total = emitted.sum(axis=0)
        share = emitted / np.where(total > 0, total, 1)
        emit = (1 - BACKGROUND) * share + BACKGROUND * corpus.background()[:, None]
        emit[:, total == 0] = corpus.background()[:, None]
        emit *= 1 - corpus.unseen_mass
        emit[UNSEEN] = corpus.unseen_mass
        row = lambda x: (x + 1e-3) / (x + 1e-3).sum(axis=-1, keepdims=True)
        return Model(row(start), row(inner), row(move), emit)


def segments_of(lengths: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, is first of its text) of runs of up to ``SEGMENT`` tokens of training texts."""
    offset = np.concatenate(([0], np.cumsum(lengths)[:-1]))[training]
    lengths = lengths[training]
    pieces = -(-lengths // SEGMENT)
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(offset, pieces) + number * SEGMENT
    size = np.minimum(np.repeat(offset + lengths, pieces) - start, SEGMENT)
    return start, size, number == 0


def expect(classes: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, model: Model) -> tuple:
    """Expected counts of the segments: (start, inner, move, emitted), by forward and backward passes."""
    k = model.start.shape[0]
    begun, inner, move = np.zeros(k), np.zeros(k), np.zeros((k, k))
    emitted = np.zeros((CLASSES, k))
    emit, step = model.emit.astype(np.float32), model.move.astype(np.float32)
    order = np.argsort(-size, kind="stable")
    for at in range(0, len(order), BATCH):
        some = order[at : at + BATCH]
        a, n, f = start[some], size[some], first[some]
        steps = int(n[0])
        active = [int(np.searchsorted(-n, -t, "left")) for t in range(steps)]  # those with n > t
        seen = [classes[a[:m] + t] for t, m in enumerate(active)]
        forward, scale = [], []
        x = np.where(f[:, None], model.start, model.inner).astype(np.float32) * emit[seen[0]]
        for t, m in enumerate(active):
            if t:
                x = (x[:m] @ step) * emit[seen[t]]
            s = x.sum(axis=1, keepdims=True)
            x = x / s
            forward.append(x)
            scale.append(s)
        back = np.ones((active[-1], k), np.float32)
        posterior = [None] * steps
        for t in range(steps - 1, -1, -1):
            m = active[t]
            if t < steps - 1:
                later = active[t + 1]
                out = emit[seen[t + 1]] * back / scale[t + 1]
                move += (forward[t][:later].T @ out) * step
                back = np.ones((m, k), np.float32)
                back[:later] = out @ step.T
            posterior[t] = forward[t] * back
        begun += posterior[0][f].sum(axis=0)
        inner += posterior[0][~f].sum(axis=0)
        flat, weight = np.concatenate(seen), np.concatenate(posterior)
        for s in range(k):
            emitted[:, s] += np.bincount(flat, weight[:, s], CLASSES)
    return begun, inner, move, emitted


def first_model(sample: list[np.ndarray], corpus: Corpus, seed: int = 11, rounds: int = 12) -> Model:
    """Start from unlike segments of the sample, then run Baum-Welch on the sample alone."""
    rng = np.random.default_rng(seed)
    sticky = np.full((STATES, STATES), 0.1 / STATES) + np.eye(STATES) * 0.9
    even = np.ones(STATES)
    emitted = rng.random((CLASSES, STATES)) * corpus.background()[:, None]
    if not sample:
        return Model.of(even, even, sticky, emitted, corpus)
    lift = np.zeros((len(sample), 1024))
    for i, s in enumerate(sample):
        lift[i] = np.bincount(s % 1024, minlength=1024)
        lift[i] /= max(np.linalg.norm(lift[i]), 1e-9)
    chosen = [0]
    nearest = lift @ lift[0]
    while len(chosen) < min(STATES, len(sample)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, lift @ lift[chosen[-1]])
    group = (lift @ lift[chosen].T).argmax(axis=1)
    for i, s in enumerate(sample):
        emitted[:, group[i]] += np.bincount(s, minlength=CLASSES)
    model = Model.of(even, even, sticky, emitted, corpus)
    flat = np.concatenate(sample)
    size = np.array([len(s) for s in sample])
    start = np.cumsum(size) - size
    for _ in range(rounds):
        model = Model.of(*expect(flat, start, size, np.ones(len(size), bool), model), corpus)
    return model


def _training_parts(row_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = _ints(row_of("lengths"), "<i4").astype(np.int64)
    training = np.unpackbits(_ints(row_of("training"), np.uint8), count=len(lengths)).astype(bool)
    classes = _ints(row_of("classes"), "<u2")[_ints(row_of("tokens"), "<i4")]
    return lengths, training, classes


def train(blocks: DataFrame, corpus: Corpus, passes: int = PASSES) -> Model:
    """Baum-Welch over all training tokens, from a start found on at most about ``SAMPLE_SEGMENTS`` segments."""
    spark = blocks.sparkSession
    needed = blocks.select("lengths", "training", "classes", "tokens")
    total = corpus.tokens / SEGMENT
    share = min(1.0, SAMPLE_SEGMENTS / max(total, 1))

    def pick(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, training, classes = _training_parts(lambda c, i=i, b=batch: b.column(b.schema.get_field_index(c))[i])
                start, size, _ = segments_of(lengths, training)
                chance = K.mix(start.astype(np.uint64) + np.uint64(len(classes))) / 2.0**64
                taken = np.flatnonzero(chance < share)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([classes[start[j] : start[j] + size[j]].astype("<u2").tobytes() for j in taken], pa.binary())], ["segment"]
                )

    rows = needed.mapInArrow(pick, "segment binary").collect()
    sample = [np.frombuffer(s, "<u2").astype(np.int64) for s in sorted(bytes(r[0]) for r in rows)]
    model = first_model(sample, corpus)
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(model)

        def expected(batches, shared=shared):
            m = shared.value
            sums = None
            for batch in batches:
                for i in range(batch.num_rows):
                    lengths, training, classes = _training_parts(lambda c, i=i, b=batch: b.column(b.schema.get_field_index(c))[i])
                    start, size, first = segments_of(lengths, training)
                    if len(start):
                        new = expect(classes, start, size, first, m)
                        sums = new if sums is None else [x + y for x, y in zip(sums, new, strict=True)]
            if sums is not None:
                begun, inner, move, emitted = sums
                # The few other counts go as classes beyond the last.
                used = np.flatnonzero(emitted.sum(axis=1))
                ids = np.concatenate((used, CLASSES + np.arange(2 + STATES)))
                values = np.concatenate((emitted[used], begun[None], inner[None], move))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.astype(np.int32)), *(pa.array(values[:, s].astype(np.float32)) for s in range(STATES))],
                    ["class", *(f"s{s}" for s in range(STATES))],
                )

        columns = [f"s{s}" for s in range(STATES)]
        added = (
            needed.mapInArrow(expected, "class int, " + ", ".join(f"{c} float" for c in columns))
            .groupBy("class")
            .agg(*(F.sum(c).alias(c) for c in columns))
            .toArrow()
        )
        values = np.zeros((CLASSES + 2 + STATES, STATES))
        values[added.column("class").to_numpy()] = np.stack([added.column(c).to_numpy() for c in columns], axis=1)
        model = Model.of(values[CLASSES], values[CLASSES + 1], values[CLASSES + 2 :], values[:CLASSES], corpus)
    return model


def forward(classes: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """log10 P(classes) of each text, by the scaled forward recursion over all its tokens."""
    order = np.argsort(-lengths, kind="stable")
    n = lengths[order]
    start = (np.cumsum(lengths) - lengths)[order]
    out = np.zeros(len(lengths))
    if not len(lengths):
        return out
    x = model.start * model.emit[classes[start]]
    m = len(n)
    for t in range(int(n[0])):
        if t:
            m = int(np.searchsorted(-n[:m], -t, "left"))
            x = (x[:m] @ model.move) * model.emit[classes[start[:m] + t]]
        s = x.sum(axis=1)
        out[:m] += np.log10(s)
        x /= s[:, None]
    back = np.empty_like(out)
    back[order] = out
    return back


def score_blocks(blocks: DataFrame, counts: DataFrame, corpus: Corpus, model: Model, key: str) -> DataFrame:
    """(key, training, n_tokens, n_known, base_score, score) of every document of the blocks."""
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    shared = blocks.sparkSession.sparkContext.broadcast((corpus, model))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        corpus, model = shared.value
        floor = math.log10(corpus.tokens + 0.5 * (corpus.distinct + 1))
        by_range = sorted(zip(right.column("range").to_pylist(), right.column("counts"), strict=True), key=lambda x: x[0])
        known_counts = np.concatenate([_ints(c, "<i8") for _, c in by_range])
        lengths, training, classes = _training_parts(lambda c: left.column(c)[0])
        tokens = _ints(left.column("tokens")[0], "<i4")
        count = known_counts[tokens]
        logs = np.log10(known_counts + 0.5)[tokens]
        first = np.cumsum(lengths) - lengths
        known = count > 0
        classes = np.where(known, classes, UNSEEN)
        within = corpus.shares(classes, count)
        return pa.table(
            {
                key: left.column("keys").combine_chunks().values,
                "training": training,
                "n_tokens": lengths,
                "n_known": np.add.reduceat(known.astype(np.int64), first),
                "base_score": np.add.reduceat(logs, first) - lengths * floor,
                "score": forward(classes, lengths, model) + np.add.reduceat(within, first),
            }
        )

    wanted = blocks.select("block", "keys", "training", "lengths", "tokens", "classes")
    sent = counts.filter("block >= 0").select("block", "range", "counts")
    return (
        wanted.groupBy("block")
        .cogroup(sent.groupBy("block"))
        .applyInArrow(score, f"`{key}` {kind}, training boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    )


def score_documents(docs: DataFrame, key: str, text: str, training: str, folder: str) -> DataFrame:
    """Learn from the rows with ``training`` true and score all. ``folder`` (shared, new) takes blocks and counts."""
    spark = docs.sparkSession
    make_blocks(docs, key, text, training).write.parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    count_words(blocks).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    corpus = corpus_sums(counts)
    model = train(blocks, corpus)
    return score_blocks(blocks, counts, corpus, model, key).withColumn("train_tokens", F.lit(corpus.tokens).cast("bigint"))
