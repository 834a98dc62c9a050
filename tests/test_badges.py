import pytest
from pyspark.errors import PySparkException

from redactlake.functions import text as T
from redactlake.operators import badges as B
from pyspark.sql import functions as F


def parse(spark, lines, src="f"):
    rows = [(src, i, line) for i, line in enumerate(lines, 1)]
    return B.parse_badges(spark.createDataFrame(rows, "src string, line_no int, raw string"))


def one(spark, line):
    r = parse(spark, [line]).first()
    return r["kind"], r["code"], r["desc"], r["surface"]


@pytest.mark.parametrize(
    "line, expected",
    [
        ("[REDACTED: (2)(D)(e), bay number] => Bay 14/N", ("arrow", "(2)(D)(e)", "bay number", "Bay 14/N")),
        ("(4)(B)(d) | ship's call sign | DLQZ", ("pipe", "(4)(B)(d)", "ship's call sign", "DLQZ")),
        ("(4)(B) | sign | left|right", ("pipe", "(4)(B)", "sign", "left|right")),
        ("[REDACTED: (4)(E), tall, red mast] => M7", ("arrow", "(4)(E)", "tall, red mast", "M7")),
        ("\t[REDACTED:(3)(X) , crane ]=>  K 2   ", ("arrow", "(3)(X)", "crane", "K 2")),
        ("(4)(B) | tide [m] | 3 => 4", ("pipe", "(4)(B)", "tide [m]", "3 => 4")),
        ("the tide was high", ("invalid", None, None, None)),
        ("(7)(B)(d) | no such level | DLQZ", ("invalid", None, None, None)),
        ("(4)(B)(d) | sign | \t ", ("invalid", None, None, None)),
        ("#(4)(B) | sign | s", ("skip", None, None, None)),
        (" \t", ("skip", None, None, None)),
        ("\x1c# x", ("skip", None, None, None)),
    ],
)
def test_lines(spark, line, expected):
    assert one(spark, line) == expected


def test_counts_and_errors(spark):
    good = ["[REDACTED: (2)(D), berth] => B9", "", "(4)(B)(d) | call sign | DLQZ", "# tides", "\t# more"]
    row = B.validation_counts(parse(spark, good), ["src"]).first()
    assert (row["n_valid"], row["n_skipped"], row["first_error"]) == (2, 2, None)
    bad = parse(spark, ["(2)(D) | berth | B9", "(2)(D) | berth | B10", "no badge", "(8)(D) | berth | x"])
    assert B.first_error(bad, ["line_no"]).endswith("no badge") and "line 3" in B.first_error(bad, ["line_no"])
    assert "line 3" in B.validation_counts(bad, ["src"]).first()["first_error"]
    with pytest.raises(PySparkException, match="line 3.*no badge"):
        B.valid_badges(bad).collect()
    assert B.valid_badges(bad, "skip").count() == 2


def test_the_first_bad_line_is_named_however_the_lines_are_dealt(spark):
    lines = ["(2)(D) | berth | B9"] * 40 + ["broken 41"] + ["(2)(D) | berth | B9"] * 60 + [f"broken {i}" for i in range(102, 140)]
    parsed = parse(spark, lines).repartition(16)
    for rows in (parsed, parsed.orderBy(F.col("line_no").desc())):
        with pytest.raises(PySparkException, match="line 41:.*broken 41"):
            B.valid_badges(rows).collect()


def test_line_splitting(spark):
    samples = ["", "a", "a\n", "a\r\nb\rc", "a\n\nb\n\n", "x\x0by\x85z w ", "\n"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r["i"]: r["l"] for r in df.select("i", T.split_lines(F.col("s")).alias("l")).collect()}
    assert [got[i] for i in range(len(samples))] == [s.splitlines() for s in samples]


def test_strip_matches_unicode_strip(spark):
    blanks = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    samples = ["".join(blanks) + "a b" + "".join(blanks), "", " ​ ", "\x1f"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r["i"]: r["l"] for r in df.select("i", T.strip(F.col("s")).alias("l")).collect()}
    assert [got[i] for i in range(len(samples))] == [s.strip() for s in samples]


def test_codes(spark):
    codes = ["(1)(A)(c)", "(3)(E)", "(4)(X)(x)", "(5)(A)", "(1)(F)", "(1)(A)(f)", "(1)(A)(c)\n", "x(1)(A)", ""]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    parts = T.code_parts(F.col("c"))
    rows = df.filter(T.is_code(F.col("c"))).select(*[v.alias(k) for k, v in parts.items()]).collect()
    assert [tuple(r) for r in rows] == [("1", "A", "c"), ("3", "E", None), ("4", "X", "x")]
