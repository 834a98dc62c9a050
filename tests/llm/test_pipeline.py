import os
import sys

import numpy as np
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as P  # noqa: E402
from redactlake.llm.vocabularies import BYTE_BPE, vocabulary_path  # noqa: E402
from test_classifiers import say  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    import random

    rng = random.Random(12)
    folder = str(tmp_path_factory.mktemp("tables"))
    passage = say(rng, "xx", 14)
    rows, labels = [], []
    for i in range(240):
        voice = rng.choice(["xx", "yy", "zz"])
        text = say(rng, voice, rng.randint(25, 60))
        if i % 6 == 1:
            text = text.replace(" ", " grak ", 2)
        if i % 40 == 2:
            text = f"{text} {passage} {text[:40]}"
        rows.append((i, text, voice, "s", len(text)))
        labels.append((i, 1, int(i % 6 == 1)))
    for i in range(5):  # copies and near copies of document 0, a bare row, a row without id
        rows.append((300 + i, rows[0][1] + (" more" if i % 2 else ""), "xx", "s", 0))
    rows += [(400, None, "xx", "s", 0), (401, "?!", None, None, None), (None, say(rng, "yy", 30), "yy", "s", 1), rows[3]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, passage


def test_stages_one_after_another(spark, tables):
    folder, rows, passage = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = [r.doc_id for r in docs.collect()]
    plain = [i for i in range(240) if i % 6 != 1]
    assert not {400, 401} & set(kept["language_id"]) and len(set(plain) - set(kept["language_id"])) <= 4
    toxic = [i for i in kept["toxicity"] if i is not None and i < 240 and i % 6 == 1]
    assert len(toxic) <= 2 and len(set(kept["language_id"]) - set(kept["toxicity"])) <= 42
    after = kept["ngram_jaccard_join"]
    assert 0 in after and not {300, 301, 302, 303, 304} & set(after) and after.count(3) == 1 and None in after
    clean = set(after) - set(kept["benchmark_decontamination"])
    assert clean == {i for i in after if i is not None and i < 240 and i % 40 == 2}


def test_run_gives_the_tokens_of_what_is_left(spark, tables):
    folder, rows, _ = tables
    texts = {r[0]: r[1] for r in rows}
    library = Tokenizer.from_file(vocabulary_path(BYTE_BPE))
    got = P.run(spark, folder).collect()
    assert 150 < len(got) < 215
    for r in got:
        assert np.frombuffer(r.token_ids, "<u4").tolist() == library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(r.token_ids) // 4


@pytest.fixture
def resplit(spark, tmp_path):
    """Documents in 8 files, which are one split at first, and a function after which each file is its own."""
    rows = [(i, f"only {i} here are a few words of text {i} and {i + 1} more", "xx", "s", 0) for i in range(40)]
    rows += [(100 + i, "one two three four five six seven eight nine ten", "xx", "s", 0) for i in range(4)]
    path, changed = str(tmp_path / "documents.parquet"), {"spark.sql.files.maxPartitionBytes": "1m", "spark.sql.files.minPartitionNum": "8"}
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8).write.parquet(path)
    spark.createDataFrame([(1, rows[-1][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    assert spark.read.parquet(path).rdd.getNumPartitions() < 3

    def change():
        for k, v in changed.items():
            spark.conf.set(k, v)
        assert spark.read.parquet(path).rdd.getNumPartitions() == 8

    yield spark.read.parquet(path), str(tmp_path), change
    for k in changed:
        spark.conf.unset(k)


def test_near_duplicates_with_other_splits_in_the_last_scan(spark, resplit):
    docs, folder, change = resplit
    out = P.near_duplicates(spark, docs, folder)
    change()
    assert sorted(r.doc_id for r in out.collect()) == [*range(40), 100]


def test_decontamination_with_other_splits_in_the_last_scan(spark, resplit, monkeypatch):
    docs, folder, change = resplit
    find = P.decontaminate.find_hits

    def find_then_change(*args):
        find(*args).write.parquet(f"{folder}/hits")
        change()
        return spark.read.parquet(f"{folder}/hits")

    monkeypatch.setattr(P.decontaminate, "find_hits", find_then_change)
    out = P.benchmark_decontamination(spark, docs, folder)
    assert sorted(r.doc_id for r in out.collect()) == [*range(40)]


def test_batches_of_whole_texts_are_small(spark):
    """What a task hands to Python at once is bounded in bytes, unless the session has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def largest():
        P._prepare(spark)
        rows = spark.range(200).coalesce(1).selectExpr("repeat('x', 100000) as x")
        return max(r[0] for r in rows.mapInArrow(lambda b: (sized(x) for x in b), "n long").collect())

    import pyarrow as pa

    def sized(x):
        return pa.RecordBatch.from_pydict({"n": [x.num_rows * 100_000]})

    try:
        spark.conf.unset(name)
        assert largest() < 2 * (4 << 20)
        spark.conf.set(name, "1m")
        assert largest() < 2 << 20 and spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_no_stage_takes_two_python_workers_for_a_task(spark, tables):
    """Workers stay with an executor, so a stage that takes two for each task leaves all later ones less memory."""
    folder, _, _ = tables
    out = P.bpe_tokens(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
