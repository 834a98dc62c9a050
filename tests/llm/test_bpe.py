import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from redactlake.llm import bpe
from redactlake.llm.vocabularies import BYTE_BPE, vocabulary_path

PATH = vocabulary_path(BYTE_BPE)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab  \n\t'sdtxé中🎉’\xa0\x85\x1c1!<|", max_size=40), max_size=5))
def test_ids_are_those_of_the_library(library, texts):
    texts = [*texts, *(t.replace("<|", "<|endoftext|>") for t in texts)]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.load(PATH).encode(texts)] == expected


def test_documents_round_trip(docs, library):
    encoded = bpe.encode_documents(docs, PATH)
    rows = bpe.decode_documents(encoded, PATH).select("text", "token_ids", "decoded").collect()
    assert len(rows) == docs.count()
    for text, ids, decoded in rows:
        expected = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected
        assert decoded == library.decode(expected, skip_special_tokens=False) == (text or "")


def test_long_piece_without_spaces(library):
    text = "abcdefghijklmnopqrstuvwxyz" * 200 + "a" * 3000
    assert np.frombuffer(bpe.load(PATH).encode([text])[0], "<u4").tolist() == library.encode(text).ids


def test_ids_that_are_no_text(spark):
    v = bpe.load(PATH)
    ids = np.array([int(v.first[0xFF]), 10**6, 50256], "<u4").tobytes()
    df = spark.createDataFrame([(ids,), (None,), (b"",)], "token_ids binary")
    assert [r[0] for r in bpe.decode_documents(df, PATH).select("decoded").collect()] == ["�<|endoftext|>", "", ""]


def test_empty_table(docs):
    assert bpe.encode_documents(docs.filter(F.lit(False)), PATH).collect() == []


def test_round_trip_is_one_python_step_with_the_rows_of_two(docs):
    """Two steps in one stage would take two Python workers for each task."""
    more = docs.selectExpr("*", "1 as decoded")
    once = bpe.round_trip_documents(more, PATH)
    twice = bpe.decode_documents(bpe.encode_documents(more, PATH), PATH)
    assert once.schema == twice.schema
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.collect()))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (once, twice)]
    assert [p.count("MapInArrow") for p in plans] == [1, 2]
