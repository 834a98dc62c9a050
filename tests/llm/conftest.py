import pytest

TEXTS = [
    None,
    "",
    " \n\t ",
    "One two three four five six seven eight nine ten eleven twelve.",
    "One two three four five six seven eight nine ten eleven twelve.",
    "one TWO three four five six seven eight nine ten eleven zwölf, dreizehn",
    "ÄÖ é ñ 中文 🎉 a",
    "x",
    "same line\nsame line\n\nother line\nsame line",
    "word " * 3000,
    "".join(f"token{i} " for i in range(4000)),
    "a b c d e f g h\na b c d e f g h i",
]


@pytest.fixture(scope="session")
def docs(spark):
    """Null ids, repeated rows, ties, odd texts, and extra columns named like inner ones."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[5]), (None, None)]
    more = "words long, row string, doc int, class string, x double, n_words string, token_ids string, lang_pred int"
    return spark.createDataFrame([(*r, 1, "r", 2, "c", 0.5, "n", "t", 4) for r in rows], "doc_id long, text string, " + more)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "tables")
