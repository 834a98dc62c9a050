import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from redactlake.llm import textkit as K
from redactlake.llm import token_counts as T
from redactlake.llm.vocabularies import BYTE_BPE, vocabulary_path

PATH = vocabulary_path(BYTE_BPE)
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'", "s", "ll", "re", "'s", "'t", "don't", "'ve ", "<|endoftext|>", "<|", "é", "中", "🎉", "1", "23"]
PARTS += ["\xa0", "\x85", "\u2009", "!", "\x1c", "\x00"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def counts(texts):
    return T.load(PATH).count(K.texts_of(pa.array(texts, pa.string()))).tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), max_size=6))
def test_counts_are_those_of_the_library(library, texts):
    assert counts(texts) == library(texts)


def test_every_code_point(library):
    texts = [f"a{c}1 {c} {c}{c}'s!{c}" for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    assert counts(texts) == library(texts)


def test_a_long_text_without_a_space(library):
    texts = ["abcdefghijklmnopqrstuvwxyz" * 4000 + "a" * 30000, "word " * 300_000, "x" * 100_001 + "'s"]
    assert counts(texts) == library(texts)


def test_the_cache_may_be_emptied_at_any_time(library, monkeypatch):
    monkeypatch.setattr(T, "KNOWN_ENTRIES", 5)
    counter = T.TokenCounter(PATH)
    texts = [f"some {i} words, wordily {i % 3} worded" for i in range(40)]
    got = np.concatenate([counter.count(K.texts_of(pa.array(texts[i : i + 7]))) for i in range(0, 40, 7)])
    assert got.tolist() == library(texts) and len(counter.known_hash) <= 5


def test_documents(docs, library):
    rows = T.count_tokens(docs, PATH, limit=20).select("doc_id", "text", "n_bytes", "n_tokens", "over_limit", "words").collect()
    assert len(rows) == docs.count() and {r["words"] for r in rows} == {1}
    for _, text, n_bytes, n_tokens, over, _ in rows:
        expected = library([text or ""])[0]
        assert (n_bytes, n_tokens, over) == (len((text or "").encode()), expected, expected > 20)


def test_empty_table(docs):
    assert T.count_tokens(docs.filter(F.lit(False)), PATH).collect() == []


def test_other_kinds_of_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        T.TokenCounter(vocabulary_path("word_bpe_49k.json"))
