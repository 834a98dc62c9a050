import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from redactlake.llm import textkit as K

texts_of_lists = st.lists(st.text(alphabet="ab É\n\t\x0b.Z中", max_size=12), max_size=8)


def words(texts, separators):
    flat = K.texts_of(pa.array(texts, pa.string()))
    found = K.words_of(flat, separators)
    cut = [bytes(flat.data[a:b]).decode() for a, b in zip(found.start, found.end, strict=True)]
    return [cut[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]


@settings(max_examples=200, deadline=None)
@given(texts_of_lists)
def test_words_are_those_of_the_definition(texts):
    assert words(texts, K.SPACES) == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert words(texts, K.NON_WORD) == [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(texts_of_lists)
def test_equal_words_and_only_those_have_equal_hashes(texts):
    flat = K.texts_of(pa.array(texts, pa.string()))
    found = K.words_of(flat, K.SPACES)
    hashes = K.word_hashes(flat, found)
    seen = [w for t in words(texts, K.SPACES) for w in t]
    assert len(set(seen)) == len(set(hashes.tolist())) == len(set(zip(seen, hashes.tolist(), strict=True)))


def test_grams_do_not_cross_texts():
    flat = K.texts_of(pa.array(["a b c", "a b", "", "a b c"]))
    found = K.words_of(flat, K.SPACES)
    grams, bounds = K.gram_hashes(K.word_hashes(flat, found), found.first, 3)
    assert bounds.tolist() == [0, 1, 1, 1, 2] and grams[0] == grams[1]


def test_slices_cover_the_batch_and_keep_long_texts_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 50, None, "b" * 500, "", "c"])], ["text"])
    parts = list(K.slices(batch, "text", 100))
    assert pa.concat_arrays([p.column(0) for p in parts]).to_pylist() == batch.column(0).to_pylist()
    assert max(p.num_rows for p in parts) < 5
    assert np.all([p.num_rows for p in parts])


def test_columns_of_any_name_ride_along(spark):
    from redactlake.llm import token_counts
    from redactlake.llm.vocabularies import BYTE_BPE, vocabulary_path

    schema = "doc_id long, text string, `odd name` int, s struct<`a b`:int,`c,d`:array<string>>"
    df = spark.createDataFrame([(1, "one two", 3, (4, ["x"])), (None, None, None, None)], schema)
    counted = token_counts.count_tokens(df, vocabulary_path(BYTE_BPE))
    assert counted.schema.fields[:4] == df.schema.fields
    assert sorted(r["n_tokens"] for r in counted.collect()) == [0, 2]
