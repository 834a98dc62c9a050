import os
import subprocess
import sys
import random
import re

import pytest
from pyspark.sql import functions as F

from redactlake.llm import decontaminate as D


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    windows = [(i, cut(t)) for i, t in items if i is not None]
    windows = [(i, w, min(10, len(w))) for i, w in windows if w]
    for key, text in docs:
        w, hit, ids = cut(text), set(), set()
        for i, item, n in windows:
            wanted = {tuple(item[j : j + n]) for j in range(len(item) - n + 1)}
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in wanted:
                    hit.update(range(j, j + n))
                    ids.add(i)
        out.append((key, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def run(docs, items, **kw):
    rows = D.find_hits(docs, items, **kw)
    rows = rows.select("doc_id", "n_words", D.covered(F.col("spans")).alias("h"), F.array_sort("items").alias("i")).collect()
    return sorted(((r[0], r[1], r[2], r[3]) for r in rows), key=str)


@pytest.mark.parametrize("bound", [D.MAX_BROADCAST_BYTES, 0])
def test_against_brute_force(spark, bound):
    rng = random.Random(3)
    word = lambda: rng.choice("a b c Ä dd".split())
    items = [(i % 7, " ".join(word() for _ in range(rng.choice([0, 1, 2, 4, 5, 8, 9, 10, 11, 14])))) for i in range(12)]
    items += [(None, "a b c dd a b c dd a b"), (9, None), (3, items[5][1])]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60))) + " " + items[i % 12][1].upper().replace("Ä", "Ä")) for i in range(25)]
    docs += [(1, docs[1][1]), (None, docs[2][1]), (None, None), (77, "")]
    got = run(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_broadcast_bytes=bound)
    assert got == brute(docs, items)


def test_odd_documents_and_clashing_columns(spark, docs):
    items = [(1, "ONE two three four five six seven eight nine ten eleven"), (2, "word " * 12)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    plain = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert run(docs, frame) == brute(plain, items)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.items == [] and r.spans == [] for r in D.find_hits(docs, none).collect())
    assert D.find_hits(docs.filter("doc_id < -1"), none).collect() == []


LONG_TEXT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
from redactlake.llm import decontaminate as D
spark = SparkSession.builder.master("local[2]").config("spark.driver.memory", "1800m").config("spark.ui.enabled", "false").getOrCreate()
word = lambda i: F.concat(F.lit("w"), (i % 9973).cast("string"))
docs = spark.range(1).select(F.lit(1).alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1000000)), word), " ").alias("text"))
items = spark.createDataFrame([(5, " ".join(f"w{i}" for i in range(200, 230))), (6, "w300 w302 w304")], "item_id long, text string")
row = D.find_hits(docs, items).first()
print(row["n_words"], len(row["spans"]), list(row["items"]))
"""


def test_a_million_words_in_an_executor_of_the_check():
    """One text of a million words, in a JVM of its own with 1800 MB: every pass over the words of item 5 is found."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", LONG_TEXT, root], capture_output=True, text=True, timeout=600)
    n_words, n_spans, *found = done.stdout.split()
    passes = sum(1 for start in range(0, 1_000_000, 9973) if start + 229 <= 1_000_000)
    assert (n_words, found) == ("1000000", ["[5]"]) and int(n_spans) >= passes
