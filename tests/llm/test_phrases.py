import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from redactlake.llm import phrases as P

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least=30, most=2000):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        frequent = {p: a for p, a in found.items() if a >= least}
        kept = []
        for p, a in frequent.items():
            if len(p) == 1:
                continue
            parts = lambda q: {q[i : i + len(p)] for i in range(len(q) - len(p) + 1)}  # noqa: E731, B023
            if any(len(q) > len(p) and p in parts(q) and 100 * b >= 80 * a for q, b in frequent.items()):
                continue
            score, _, left, right = min((2000000 * a // (found[p[:j]] + found[p[j:]]), j, found[p[:j]], found[p[j:]]) for j in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def made(seed, n=150):
    rng = random.Random(seed)
    fixed = ["new york city", "in the end of", "a b c d", "x x x", "Öl é 中文"]
    rows = []
    for _ in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice("the of a b c d x été".split()) for _ in range(rng.randint(0, 40))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in words)
        rows.append((text.upper() if rng.random() < 0.2 else text, rng.choice(["en", "en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", "fr"), (rows[0][0], rows[0][1])]


def mined(df, folder, **more):
    return sorted(tuple(r) for r in P.mine(df, folder, **more).select(*COLUMNS).collect())


@pytest.mark.parametrize("max_sent", [P.MAX_SENT, 0])
def test_against_brute_force(spark, folder, monkeypatch, max_sent):
    """Semi-joins with groups sent to the tasks, and by shuffle."""
    monkeypatch.setattr(P, "HELD_GROUPS", 40)
    rows = made(3)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    expected = brute(rows)
    assert {len(r[2].split()) for r in expected} == {2, 3, 4}
    assert mined(df, folder, max_sent=max_sent) == expected


def test_top_of_each_language_and_ties(spark, folder):
    rows = [("p q. r s. t u. v w", "en"), ("v w. q p", "fr")] * 31
    df = spark.createDataFrame(rows, "text string, lang string")
    assert mined(df, folder, per_lang=2) == brute(rows, most=2)
    assert brute(rows, most=2)[0][2] == "p q"


def test_a_long_text_and_clashing_columns(spark, folder):
    long = " ".join(f"w{i % 977} w{i % 31}" for i in range(120_000))
    rows = [(long, "en"), ("w1 w2 " * 20, "en"), (None, None)]
    df = spark.createDataFrame([(*r, 1, "b", 2.0) for r in rows], "text string, lang string, id int, word string, n double")
    assert mined(df, folder) == brute(rows)


def test_counts_whose_products_pass_64_bits(spark):
    big = 3 * 10**15
    df = spark.createDataFrame([(big, [big + 1, big], [7 * 10**15, big])], "a bigint, heads array<bigint>, tails array<bigint>")
    assert df.select(P.lowest_cut(2).alias("c")).first()["c"]["score"] == 2000000 * big // (big + 1 + 7 * 10**15)
    phrases = spark.createDataFrame([(1, 10**18), (2, 10**18)], "id bigint, a bigint")
    longer = spark.createDataFrame([(1, 2, 8 * 10**17), (1, 1, 3)], "left bigint, right bigint, a bigint")
    assert P.not_inside(phrases, longer, 80).count() == 0
    assert P.not_inside(phrases, longer.withColumn("a", F.col("a") - 1), 80).count() == 2


def test_empty_table(spark, folder):
    assert mined(spark.createDataFrame([], "text string, lang string"), folder) == []
