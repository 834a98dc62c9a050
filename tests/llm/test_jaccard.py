import itertools
import random
import re

import pytest

from redactlake.llm import jaccard as J


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            group[top(j)] = top(i)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((key, len(sets[i]), min(ids) if ids and sets[i] else key))
    return sorted(out, key=str)


def run(df, folder):
    return sorted((tuple(r) for r in J.group_similar(df, "doc_id", "text", folder).drop("class").collect()), key=str)


def near_copies(seed, n=60):
    rng = random.Random(seed)
    bases = [[f"w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 30, 120]))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 400)}"
        if rng.random() < 0.3:
            words += [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 8))]
        rows.append((i, " ".join(words).upper() if rng.random() < 0.3 else " ".join(words)))
    return rows


@pytest.mark.parametrize("full_factor, pivots", [(4, 4), (0, 1), (0, 3)])
def test_groups_against_brute_force(spark, folder, monkeypatch, full_factor, pivots):
    """Joined in full, and by pivots until the rounds are over."""
    monkeypatch.setattr(J, "FULL_FACTOR", full_factor)
    monkeypatch.setattr(J, "PIVOTS", pivots)
    monkeypatch.setattr(J, "PAIRS_PER_ROW", full_factor)
    rows = near_copies(5) + [(None, near_copies(5)[7][1]), (3, near_copies(5)[3][1])]
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), folder) == brute(rows)


def test_odd_documents_and_clashing_columns(docs, folder):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert run(docs, folder) == brute(rows)


def test_chain_of_links(spark, folder):
    """Ends of the chain are unlike each other, yet in one group."""
    words = [f"v{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[10 * i : 10 * i + 100])) for i in range(30)]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"), folder)
    assert got == brute(rows) and len({r[2] for r in got}) == 1


def test_threshold_is_met_exactly(spark, folder):
    same = [f"s{i}" for i in range(79)]  # 75 shingles in common, 25 more in one text
    rows = [(1, " ".join(same)), (2, " ".join(same + [f"t{i}" for i in range(25)])), (3, " ".join(same + [f"u{i}" for i in range(26)]))]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"), folder)
    assert got == brute(rows) == [(1, 75, 1), (2, 100, 1), (3, 101, 3)]


def test_one_group_of_many_near_copies_has_few_candidates(spark, folder):
    """5,000 near copies of one text and 300 other texts with a line of it: candidates are linear in the rows."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(5000):
        words = list(base)
        words[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(words)))
    for i in range(5000, 5300):
        rows.append((i, " ".join(base[20:32] + [f"y{rng.randrange(90)}" for _ in range(30)])))
    got = run(spark.createDataFrame(rows, "doc_id long, text string"), folder)
    assert {r[2] for r in got if r[0] < 5000} == {0} and len({r[2] for r in got}) > 290
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    pairs = sum(spark.read.parquet(f"{folder}/{n}").count() for n in names if n.startswith("pairs-"))
    assert pairs < 20 * len(rows)


@pytest.mark.parametrize("last", [False, True])
def test_cells_give_the_pairs_of_all_blocks(spark, monkeypatch, last):
    """Groups of several blocks: the pairs that pass the filters, whichever cell they meet in."""
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "PAIRS_AT_ONCE", 50)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    texts = [" ".join(w if rng.random() < 0.98 else f"x{rng.randrange(10**6)}" for w in base) for _ in range(60)]
    sets = J.shingle_sets(J.K.texts_of(J.pa.array(texts)))
    rows, n = [], 60
    for c, x in enumerate(sets):
        rows.append((1, c, len(x), 0, c % 9, n, 0, 1600.0, J.range_counts(x).tolist(), J.parities(x).tolist()))
    names = "token long, class long, size int, place int, component long, n long, first long, unlinked double, ranges array<int>, parities array<long>"
    pairs, left = J.next_candidates(spark.createDataFrame(rows, names), 1, 4, last)
    got = [tuple(r) for r in pairs.collect()]
    pivots = set(range(n)) - {r["class"] for r in left.collect()}
    assert len(got) == len(set(got)) and 0 in pivots and (len(pivots) == n) == last
    like = {(a, b) for a, b in itertools.combinations(range(n), 2) if a % 9 != b % 9 and J.similar(sets[a], sets[b])}
    assert len(like) > 500 and {p for p in like if pivots & set(p)} <= set(got)
    assert all(a % 9 != b % 9 and pivots & {a, b} for a, b in got)
    assert last or len(got) < len(like)


def test_ranges_bound_what_two_sets_share(spark):
    sets = [J.shingle_sets(J.K.texts_of(J.pa.array([" ".join(f"w{j}" for j in range(a, b))])))[0] for a, b in ((0, 50), (5, 55), (40, 90))]
    rows = [(i, J.range_counts(x).tolist()) for i, x in enumerate(sets)]
    assert [sum(r) for _, r in rows] == [46, 46, 46]
    df = spark.createDataFrame(rows, "class long, ranges array<int>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a long, b long")
    assert (0, 1) in {tuple(r) for r in J.suffix_filter(pairs, df).collect()}


def test_parities_bound_how_far_two_sets_differ(spark):
    texts = [" ".join(f"w{j}" for j in range(a, b)) for a, b in ((0, 5000), (1, 5001), (100, 5100), (0, 60), (4, 64), (30, 90))]
    sets = J.shingle_sets(J.K.texts_of(J.pa.array(texts)))
    rows = [(i, len(x), J.parities(x).tolist()) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "class long, size int, parities array<long>")
    pairs = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2)]
    kept = {tuple(r) for r in J.pairs_with(spark.createDataFrame(pairs, "a long, b long"), df, J.parity_condition()).collect()}
    assert {(a, b) for a, b in pairs if J.similar(sets[a], sets[b])} <= kept and (3, 5) not in kept


def test_group_of_texts_that_are_nearly_similar_enough_has_few_candidates(spark, folder):
    """121 texts, each with three words of one text changed, no two in more than one place: 73 % similar at most, so no pair links."""
    base, rows = [f"b{i}" for i in range(165)], []
    for i, j in itertools.product(range(11), repeat=2):
        words = list(base)
        for place in (i, 11 + j, 22 + (i + j) % 11):
            words[5 * place + 2] = f"x{i}-{j}-{place}"
        rows.append((11 * i + j, " ".join(words)))
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), folder) == brute(rows)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    pairs = sum(spark.read.parquet(f"{folder}/{n}").count() for n in names if n.startswith("pairs-"))
    assert pairs < 10 * len(rows)  # of 7,260


def test_empty_table(docs, folder):
    assert run(docs.filter("doc_id < -1"), folder) == []
