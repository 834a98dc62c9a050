"""Language ID, toxicity, quality and trees: held-out accuracy, exact statistics, odd input."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from redactlake.llm import gbt, langid, quality, toxicity
from redactlake.llm import textkit as K

VOICES = {"xx": "ka lo mi tu ne".split(), "yy": "sch ein ung ter ach".split(), "zz": "ção ém ões ará lhe".split()}


def say(rng, voice, n):
    return " ".join("".join(rng.choices(VOICES[voice], k=rng.randint(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(2)
    rows = [(i, say(rng, v, rng.randint(3, 60)), v) for i in range(150) for v in [rng.choice(list(VOICES))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_of_documents_kept_out(spoken):
    model = langid.train(spoken.filter("doc_id % 3 > 0"), "doc_id", "text", "lang")
    rows = langid.predict(spoken.filter("doc_id % 3 = 0"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.lang_score <= 1 for r in rows) and np.mean([r.lang_rejected for r in rows]) < 0.1


def test_languages_of_odd_documents(docs, spoken):
    model = langid.train(spoken, "doc_id", "text", "lang")
    rows = langid.predict(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not letters) and (r.lang_score > 0) == letters
        assert letters or r.lang_rejected


def test_nothing_to_learn_languages_from(spoken, docs):
    model = langid.train(spoken.filter("false"), "doc_id", "text", "lang")
    assert {(r.lang_pred, r.lang_score, r.lang_rejected) for r in langid.predict(docs, model).collect()} == {("und", 0.0, True)}
    assert langid.predict(docs.filter("false"), model).collect() == []


@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1600):
        words, bad = say(rng, "xx", rng.randint(5, 50)).split(), int(rng.random() < 0.3)
        if bad:  # a word, a pair with one word between, or a stem with any ending
            words[1:1] = rng.choice([["grak"], ["ka", "vor", rng.choice("abc"), "dul"], ["blarg" + "".join(rng.choices(VOICES["yy"], k=2))]])
        rows.append((i, " ".join(words)))
        labels.append((i, bad))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_documents_kept_out(insults):
    docs, labels = insults
    model = toxicity.train(docs, labels.filter("doc_id % 4 > 0"), "doc_id", "text", "toxic")
    assert 0 < len(model.buckets) < 3000  # sparse
    rows = toxicity.score(docs.filter("doc_id % 4 = 0"), model).join(labels.withColumnRenamed("toxic", "y"), "doc_id").collect()
    assert np.mean([r.toxic == r.y for r in rows]) > 0.95
    assert all(r.toxic == 0 for r in rows if r.y == 0)


def test_toxicity_of_odd_documents(docs, insults):
    model = toxicity.train(*insults, "doc_id", "text", "toxic")
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.toxicity <= 1 and r.toxic == int(r.toxicity >= 0.7) for r in rows)
    none = toxicity.train(docs, insults[1].filter("false"), "doc_id", "text", "toxic")
    assert {r.toxic for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(docs.filter("false"), none).collect() == []


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in often for j in range(8)}
    signs = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), signs, len(lines) - len(set(lines)), len(covered)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab\n \t#é中", max_size=60), max_size=6))
def test_statistics_against_brute_force(texts):
    got = quality.statistics(K.texts_of(pa.array(texts, pa.string())))
    assert list(zip(*(got[c].tolist() for c in quality.COUNTS), strict=True)) == [brute_statistics(t) for t in texts]


def test_quality_of_odd_documents(docs, spark):
    stats = quality.add_statistics(docs)
    labels = spark.createDataFrame([(3, 1), (3, 0), (11, 1), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(docs, labels, "doc_id", "text", "quality")
    rows = quality.judge(stats, model).collect()
    texts = sorted([r.text for r in docs.collect()], key=str)
    expected = sorted(brute_statistics(t) for t in texts)
    assert sorted(tuple(r[c] for c in quality.COUNTS) for r in rows) == expected
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judge(quality.add_statistics(docs.filter("false")), None).collect() == []


def test_quality_learns_and_stays_monotonic(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        words, good = say(rng, "xx", rng.randint(30, 80)).split(), rng.random() < 0.6
        rows.append((i, " ".join(words if good else [w + rng.choice("#*$%") for w in words])))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    y = dict(labels)
    model = quality.train(docs.filter("doc_id % 3 > 0"), spark.createDataFrame(labels, "doc_id long, quality int"), "doc_id", "text", "quality")
    got = quality.judge(quality.add_statistics(docs.filter("doc_id % 3 = 0")), model).collect()
    assert np.mean([r.kept == y[r.doc_id] for r in got]) > 0.95
    x = np.tile([4.0, 4, 0, 0, 0, 0.02, 0, 0.1, 0.9, 12], (50, 1))
    x[:, quality.FEATURES.index("symbols_per_word")] = np.linspace(0, 2, 50)
    assert np.all(np.diff(model.margins(x)) <= 1e-9)


def test_trees_fit_and_obey_constraints():
    rng = np.random.default_rng(1)
    x = rng.random((1500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((gbt.fit(x, y).probabilities(x) > 0.5) == y).mean() > 0.97
    noisy = (rng.random(1500) < 0.3 + 0.4 * x[:, 0]).astype(float)
    model = gbt.fit(x, noisy, {0: 1, 1: -1})
    for k, sign in ((0, 1), (1, -1)):
        line = np.full((100, 3), 0.4)
        line[:, k] = np.linspace(0, 1, 100)
        assert np.all(sign * np.diff(model.margins(line)) >= -1e-9)


def test_trees_without_two_classes():
    assert gbt.fit(np.zeros((3, 2)), np.ones(3)).probabilities(np.zeros((2, 2))).min() > 0.99
    assert gbt.fit(np.zeros((0, 2)), np.zeros(0)).probabilities(np.zeros((1, 2)))[0] == pytest.approx(0.5)
