import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from helpers import nested, texts
from redactlake.functions import kernels, tags, text as T
from redactlake.operators import matching as M
from redactlake.operators import redact as R

PATTERNS = "surface string, item_id bigint, code string, desc string, variant string, alias_id bigint"


def patterns(spark, surfaces):
    return spark.createDataFrame([(s, i, "(1)(A)", f"d{i}", "c", None) for i, s in enumerate(surfaces, 1)], PATTERNS)


def tag_of(surfaces):
    return {s: f"[REDACTED(#{i}|var=c): (1)(A), d{i}]" for i, s in enumerate(surfaces, 1)}


def check(spark, docs, surfaces, bound):
    matcher = M.prepare_matcher(patterns(spark, surfaces), bound)
    df = texts(spark, docs)
    rows = M.match_all(df, matcher, ["doc_id"]).collect()
    got = sorted((r["doc_id"], r["doc_start"], r["doc_start"] + r["end"] - r["start"], r["surface"]) for r in rows)
    want = sorted((i, *m) for i, d in enumerate(docs) for m in brute.occurrences(d, surfaces))
    assert got == want
    for r in rows:
        base, chunk, _ = list(brute.chunks(docs[r["doc_id"]]))[r["seg_no"]]
        assert r["seg_start"] == base and chunk[r["start"] : r["end"]] is not None
    out = {r["doc_id"]: (r["redacted"], r["n_matches"]) for r in R.redact_documents(df, matcher, ["doc_id"]).collect()}
    expected = tag_of(surfaces)
    assert out == {i: brute.redact(d, expected) for i, d in enumerate(docs)}


@pytest.mark.parametrize("bound", [1 << 20, 0], ids=["broadcast", "join"])
def test_random_documents(spark, bound):
    rnd = random.Random(5)
    alphabet = ["a", "b", "é", "😀", " ", "■", "\n", "```", "\n```\n", "[REDACTED(#1|var=c): x, y]", "ab", "\U0010ffff"]
    docs = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(300)]
    surfaces = ["a", "ab", "ba", "aba", "b é", "😀", "é😀a", "■", "■■b", "abababababab", "a\nb", "b" * 9, "\U0010ffff", "]a"]
    check(spark, docs, surfaces, bound)


@pytest.mark.parametrize("bound", [1 << 20, 0], ids=["broadcast", "join"])
def test_long_texts_and_surfaces(spark, bound):
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    surfaces = [word(n).strip("") for n in (3, 7, 8, 9, 31, 32, 33, 100, 700)]
    docs = []
    for _ in range(6):
        parts = []
        for _ in range(60):
            parts += [word(rnd.randrange(2000)), rnd.choice(surfaces)]
        docs.append("".join(parts))
    docs += ["x" * 300000 + surfaces[-1], ""]
    check(spark, docs, surfaces, bound)


def test_window_borders(spark):
    """Hits that straddle the screen's windows and the splice's blocks."""
    docs = []
    for at in (4090, 4096, 131065, 131072, 131080, 262140):
        docs += ["." * at + "needle-needle" + "." * 20, "é" * at + "needle"]
    check(spark, docs, ["needle", "needle-needle"], 1 << 20)


def test_self_overlap_and_edges(spark):
    check(spark, ["baaa", "aaaa", "😀 x😀", "\r\n```\r\na\r\n```\r\n a"], ["ba", "aa", "x😀", "a"], 1 << 20)


def test_empty_inventory(spark):
    matcher = M.prepare_matcher(patterns(spark, ["x"]).limit(0))
    row = R.redact_documents(texts(spark, ["x marks nothing"]), matcher, ["doc_id"]).first()
    assert (row["redacted"], row["n_matches"]) == ("x marks nothing", 0)


def test_null_text(spark):
    for bound in (1 << 20, 0):
        matcher = M.prepare_matcher(patterns(spark, ["x"]), bound)
        row = R.redact_documents(texts(spark, [None]), matcher, ["doc_id"]).first()
        assert (row["redacted"], row["n_matches"]) == (None, 0)


def test_crowded_filter_still_exact(spark):
    """A filter far too small for the inventory lets false candidates through, never wrong results."""
    rnd = random.Random(3)
    surfaces = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randrange(3, 9))) for _ in range(3000)})
    docs = ["".join(rnd.choice("abcde") for _ in range(200)) for _ in range(20)]
    df = texts(spark, docs)
    want = {i: brute.redact(d, tag_of(surfaces)) for i, d in enumerate(docs)}
    for bound in (1 << 20, 0):
        matcher = M.prepare_matcher(patterns(spark, surfaces), bound, max_word_bits=M.MIN_WORD_BITS)
        got = R.redact_documents(df, matcher, ["doc_id"]).collect()
        assert {r["doc_id"]: (r["redacted"], r["n_matches"]) for r in got} == want


def made_words(rng, n):
    """``n`` random words of 8 to 24 letters (so that hardly any is met by chance), as an Arrow array."""
    size = rng.integers(8, 25, n)
    bounds = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    letters = rng.integers(97, 123, int(bounds[-1]), dtype=np.uint8)
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(bounds), pa.py_buffer(letters)])


def test_false_candidates_of_five_million_surfaces_are_few():
    """The filter takes 64 MiB, and of a text's windows one in a thousand at most passes without being a surface."""
    rng = np.random.default_rng(4)
    words = np.zeros(1 << M.MAX_WORD_BITS, np.uint64)
    for _ in range(10):
        last = made_words(rng, 500_000)
        bit = kernels.filter_bits(last, M.MAX_WORD_BITS)
        np.bitwise_or.at(words, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
    text = " ".join(made_words(rng, 60_000).to_pylist())
    known = last.slice(0, 500).to_pylist()
    data = np.frombuffer((text + " " + " ".join(known)).encode(), np.uint8)
    at, size = kernels._survivors(data, np.array([0, len(data)]), kernels.block_probe(words), range(8, 25), {})
    found = {data[a : a + n].tobytes().decode() for a, n in zip(at.tolist(), size.tolist())}
    assert set(known) <= found
    assert len(at) - len(known) < len(data) / 1000


def test_the_filter_built_by_tasks_in_slices(spark, monkeypatch):
    monkeypatch.setattr(kernels, "SLICE_WORDS", 512)
    surfaces = [f"surface number {i} é" for i in range(2000)]
    slices = M._filter_slices(patterns(spark, surfaces).repartition(5), len(surfaces), M.MAX_WORD_BITS)
    words = np.concatenate([np.frombuffer(s.value, np.uint64) for s in slices])
    assert len(slices) == 4 and len(words) == 2048
    expected = np.zeros(2048, np.uint64)
    bit = kernels.filter_bits(pa.array(surfaces), 11)
    np.bitwise_or.at(expected, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
    assert (words == expected).all()


def test_only_documents_with_a_candidate_are_stored_and_joined(spark, monkeypatch):
    stored = []
    keep = M.materialize
    monkeypatch.setattr(M, "materialize", lambda df: stored.append(keep(df)) or stored[-1])
    docs = texts(spark, ["nothing here"] * 500 + ["a hot one", "hot hot"])
    matcher = M.prepare_matcher(patterns(spark, ["hot"]), 0)
    got = R.redact_documents(docs, matcher, ["doc_id"])
    assert [r["n_matches"] for r in got.filter("n_matches > 0").orderBy("n_matches").collect()] == [1, 2]
    assert got.count() == 502 and stored[-1].count() < 10


def test_hot_surface_join(spark):
    docs = ["hot " * 500, *["cold hot"] * 50]
    check(spark, docs, ["hot", "cold"], 0)


def test_documents_sharing_a_key(spark):
    docs = spark.createDataFrame([(1, "a hot"), (1, "hot"), (1, "hot"), (1, "none")], "doc_id bigint, text string")
    for bound in (1 << 20, 0):
        matcher = M.prepare_matcher(patterns(spark, ["hot"]), bound)
        got = sorted(r["n_matches"] for r in R.redact_documents(docs, matcher, ["doc_id"]).collect())
        assert got == [0, 1, 1, 1]


def test_keys_that_are_null_or_named_like_match_columns(spark):
    rows = [(None, "a hot"), (None, "cold"), (None, "a hot"), (7, "hot hot"), (7, "none")]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "item_id bigint, `raw text` string, desc string")
    results = []
    for bound in (1 << 20, 0):
        matcher = M.prepare_matcher(patterns(spark, ["hot"]), bound)
        got = R.redact_documents(docs, matcher, ["item_id"], "raw text").collect()
        results.append(sorted(((r["item_id"], r["redacted"], r["n_matches"], r["desc"]) for r in got), key=str))
        found = M.match_all(docs, matcher, ["item_id", "desc"], "raw text")
        assert found.columns[:2] == ["item_id", "desc"] and {"match_item_id", "match_desc"} <= set(found.columns)
        assert sorted(str(r["item_id"]) for r in found.collect())[:2] == ["7", "7"]
    assert results[0] == results[1] and [r[2] for r in results[0]].count(1) == 2


def test_a_span_without_tag_fails(spark):
    df = spark.createDataFrame([("abc", [(0, 1, None)])], "text string, s array<struct<start:int,end:int,tag:string>>")
    with pytest.raises(Exception, match="no tag"):
        tags.splice(df, "text", "s", "out").collect()


def test_mask_keeps_length(spark):
    cases = [
        "at [REDACTED(#40|var=a2): (4)(B), call sign], then [REDACTED(#41|var=c):\nberth,\nold]",
        "[REDACTED(#40|var=q): (4)(B), call sign] and [REDACTED(#x|var=c): a, b]",
        "[REDACTED(#40|var=c): cut off",
        "tide",
    ]
    for r in texts(spark, cases).select("text", tags.mask_tags("text").alias("m")).collect():
        assert r["m"] == brute.TAG.sub(lambda m: T.MASK * len(m.group()), r["text"])


def test_small_inventory_needs_no_shuffle(spark):
    matcher = M.prepare_matcher(patterns(spark, ["x", "yy"]))
    df = R.redact_documents(texts(spark, ["x"]), matcher, ["doc_id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_filter_bits_move_before_they_are_put_together(spark, monkeypatch):
    """Tasks do not each make a page of their own for every page of the filter, and documents' windows are not sorted."""
    from redactlake.operators import matching
    from redactlake.operators import redact
    from redactlake.operators.inventory import from_nested

    plans, store = [], matching.materialize

    def stored(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    monkeypatch.setattr(matching, "materialize", stored)
    inv = from_nested(nested(spark, [(i, "(2)(B)", "gate", f"gate {i}", []) for i in range(1, 60)]))
    matcher = redact.matcher_for(inv, max_broadcast_bytes=0)
    assert "REPARTITION_BY_NUM" in plans[0]
    top = plans[0].split("bitmap_construct_agg", 1)[1].split("Exchange", 1)[0]
    assert top.count("bitmap_construct_agg") >= 1  # both steps stand above the exchange
    got = redact.redact_documents(texts(spark, ["at gate 7", "gate 59, gate 1", "no"]), matcher, ["doc_id"])
    assert {r["doc_id"]: r["n_matches"] for r in got.collect()} == {0: 1, 1: 2, 2: 0}


def test_a_batch_is_matched_in_bounded_memory(spark):
    """32 MB of text in one batch: the arrays of its own that the kernel holds do not grow with the batch."""
    matcher = M.prepare_matcher(patterns(spark, ["needle", "needles"]))
    batch = pa.array([("é" + "x" * 998 + " needles") * 8] * 4000)
    match = kernels.make_matcher(matcher.state, select=True).func
    few = match(batch.slice(0, 10))
    tracemalloc.start()
    found = match(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.slice(0, 10).to_pylist() == few.to_pylist() and len(found) == 4000
    assert [(m["start"], m["surface"]) for m in found[3999].as_py()] == [(1007 * i + 1000, "needles") for i in range(8)]
    assert peak < 16 << 20


def test_slices_of_a_batch_give_what_the_batch_gives():
    rows = ["a```b\n```\n", None, "", "x" * 300_000, "é```\nq\n```\nz"] * 40
    batch, spots = pa.array(rows, pa.string()), pa.array([[0, 1] if r and len(r) > 2 else [] for r in rows], pa.list_(pa.int32()))
    runs = list(kernels.slices(batch))
    assert len(runs) > 40 and [a for a, _ in runs] == np.cumsum([0] + [n for _, n in runs])[:-1].tolist() and sum(n for _, n in runs) == 200
    locate = kernels.make_locator().func
    assert locate(batch, spots).to_pylist() == [locate(batch.slice(i, 1), spots.slice(i, 1)).to_pylist()[0] for i in range(200)]
