import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from redactlake.llm import hmm as H

COLUMNS = ("n_tokens", "n_known", "base_score", "score", "train_tokens")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def base(rows):
    counts = Counter(w for _, t, learn in rows for w in tokens(t) if learn)
    n, v = sum(counts.values()), len(counts)
    score = lambda ws: sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
    return sorted((len(ws), sum(counts[w] > 0 for w in ws), round(score(ws), 6)) for ws in (tokens(t) for _, t, _ in rows)), n


def run(df, folder):
    return H.score_documents(df, "doc_id", "text", "learn", folder).collect()


def check(df, folder):
    rows = [(r.doc_id, r.text, bool(r.learn)) for r in df.collect()]
    got = run(df, folder)
    expected, n = base(rows)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == expected
    assert {r.train_tokens for r in got} <= {n}
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in got)
    return got


def test_base_counts_and_odd_documents(docs, folder):
    check(docs.withColumn("learn", F.col("doc_id") % 2 == 1), folder)


def test_many_blocks_and_ranges(docs, folder, monkeypatch):
    monkeypatch.setattr(H, "COUNT_ROWS", 50)
    check(docs.withColumn("learn", F.lit(True)), folder)


def test_nothing_to_learn_from_and_no_rows(docs, folder):
    check(docs.withColumn("learn", F.lit(False)), folder)
    assert run(docs.filter("false").withColumn("learn", F.lit(True)), folder + "-2") == []


def test_states_beat_the_base_on_documents_kept_out(spark, folder):
    rng = random.Random(9)
    voices = [[f"{p}{i}x" for i in range(60)] for p in ("alp", "bet", "gam")]
    rows = [(i, " ".join(rng.choices(rng.choice(voices), k=80)), i % 5 != 1) for i in range(300)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"), folder)
    held = [r for r in got if not r.training]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.3 * sum(r.n_tokens for r in held)


def small_model(rng, corpus):
    return H.Model.of(rng.random(H.STATES), rng.random(H.STATES), rng.random((H.STATES, H.STATES)), rng.random((H.CLASSES, H.STATES)), corpus)


@pytest.fixture
def corpus():
    masses = np.zeros(H.CLASSES)
    masses[2:40] = np.arange(1, 39)
    return H.Corpus(int(masses.sum()), 38, 5, masses)


def by_definition(classes, m):
    x = m.start * m.emit[classes[0]]
    for c in classes[1:]:
        x = (x @ m.move) * m.emit[c]
    return math.log10(x.sum())


def test_forward_is_the_exact_likelihood(corpus):
    rng = np.random.default_rng(3)
    m = small_model(rng, corpus)
    lengths = np.array([3, 1, 7, 7, 2])
    classes = rng.integers(2, 40, lengths.sum())
    cuts = np.concatenate(([0], np.cumsum(lengths)))
    expected = [by_definition(classes[a:b], m) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert H.forward(classes, lengths, m) == pytest.approx(expected)


def test_emissions_are_distributions(corpus):
    m = small_model(np.random.default_rng(4), corpus)
    for p in (m.emit.sum(axis=0), m.move.sum(axis=1), m.start.sum(), m.inner.sum()):
        assert p == pytest.approx(1)


def test_words_seen_and_unseen_have_probabilities_that_sum_to_one():
    """A vocabulary of five words in two classes: with the unseen words, every state's emissions sum to 1."""
    counts, classes = np.array([4, 1, 1, 7, 2]), np.array([5, 5, 9, 9, 9])
    masses = np.zeros(H.CLASSES)
    np.add.at(masses, classes, counts + 0.5)
    corpus = H.Corpus(int(counts.sum()), 5, 2, masses)
    m = small_model(np.random.default_rng(6), corpus)
    m = H.Model.of(m.start, m.inner, m.move, m.emit * (masses > 0)[:, None], corpus)
    words = (m.emit[classes] * 10 ** corpus.shares(classes, counts)[:, None]).sum(axis=0)
    unseen = m.emit[H.UNSEEN] * 10 ** corpus.shares(np.array([H.UNSEEN]), np.array([0]))
    assert words + corpus.unseen_words * unseen == pytest.approx(np.ones(H.STATES))
    assert unseen == pytest.approx(np.full(H.STATES, 1 / (corpus.tokens + 2)))


def test_unseen_words_cost_more_than_seen_ones_and_known_texts_beat_the_base(spark, folder):
    rng = random.Random(10)
    voices = [[f"{p}{i}x" for i in range(60)] for p in ("alp", "bet", "gam")]
    rows = [(i, " ".join(rng.choices(rng.choice(voices), k=80)), True) for i in range(300)]
    for share in (0, 20, 40, 60, 80):  # unseen words of 80
        for _ in range(5):
            words = rng.choices(rng.choice(voices), k=80 - share) + [f"unheard{rng.random()}" for _ in range(share)]
            rng.shuffle(words)
            rows.append((1000 + share, " ".join(words), False))
    got = [r for r in check(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"), folder) if not r.training]
    mean = {s: sum(r.score / r.n_tokens for r in got if r.doc_id == 1000 + s) for s in (0, 20, 40, 60, 80)}
    assert sorted(mean, key=mean.get, reverse=True) == [0, 20, 40, 60, 80]
    known = [r for r in got if r.n_known == r.n_tokens]
    assert known and sum(r.score for r in known) > sum(r.base_score for r in known)


def test_each_pass_raises_the_likelihood(corpus):
    rng = np.random.default_rng(5)
    m = small_model(rng, corpus)
    size = np.full(20, 40)
    classes = np.concatenate([rng.integers(2, 20, 40) if i % 2 else rng.integers(20, 40, 40) for i in range(20)])
    start, first = np.cumsum(size) - size, np.ones(20, bool)
    seen = []
    for _ in range(6):
        seen.append(H.forward(classes, size, m).sum())
        m = H.Model.of(*H.expect(classes, start, size, first, m), corpus)
    assert seen[-1] > seen[0] and all(b > a - 1 for a, b in zip(seen[:-1], seen[1:], strict=True))
