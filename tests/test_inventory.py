import random

import pytest
from pyspark.errors import PySparkException

from helpers import nested
from redactlake.operators import inventory as I
from redactlake.operators.numbering import number_rows

BADGES = "ord int, code string, desc string, surface string"


def items_of(inv):
    rows = I.to_nested(inv).orderBy("item_pos").collect()
    return [(r["id"], r["code"], r["desc"], r["surface"], [(a["id"], a["surface"]) for a in r["aliases"]]) for r in rows]


def expected_merge(start, badges):
    """Items after the merge and each badge's item, from keyed tables."""
    own, alias = {}, {}
    for pos, (id_, code, desc, surface, aliases) in enumerate(start):
        own.setdefault((code, surface), (pos, id_))
        for _, s in aliases:
            alias.setdefault((code, desc, s), (pos, id_))
    items, ids, last = list(start), [], max((i[0] for i in start), default=0)
    for _, code, desc, surface in badges:
        surface = surface.strip()
        hits = [t[k] for t, k in ((own, (code, surface)), (alias, (code, desc, surface))) if k in t]
        if not hits:
            last += 1
            own[(code, surface)] = (len(items), last)
            items.append((last, code, desc, surface, []))
            hits = [own[(code, surface)]]
        ids.append(min(hits)[1])
    return items, ids


def test_a_badge_read_twice_is_one_item(spark):
    badges = spark.createDataFrame([(n, "(3)(B)(d)", "door plan", "Plan 9/east") for n in (4, 8)], BADGES)
    result = I.merge_badges(I.empty_inventory(spark), badges)
    assert items_of(result.inventory) == [(1, "(3)(B)(d)", "door plan", "Plan 9/east", [])]
    assert [r["item_id"] for r in I.assign_badges(result, badges).collect()] == [1, 1]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_matches_keyed_tables(spark, seed):
    rnd = random.Random(seed)
    codes, descs, words = ["(1)(A)", "(2)(B)"], ["d1", "d2", "d3"], [f"w{i}" for i in range(12)]
    start = []
    for i in range(5):
        aliases = [(j, w) for j, w in enumerate(rnd.sample(words, 2), 1)]
        start.append((rnd.randrange(1, 20), rnd.choice(codes), rnd.choice(descs), rnd.choice(words), aliases))
    badges = [(i, rnd.choice(codes), rnd.choice(descs), rnd.choice([" ", ""]) + rnd.choice(words)) for i in range(120)]
    inv = I.from_nested(nested(spark, start))
    expected, ids = expected_merge(start, badges)
    df = spark.createDataFrame(badges, BADGES)
    result = I.merge_badges(inv, df)
    assert items_of(result.inventory) == expected
    assert [r["item_id"] for r in I.assign_badges(result, df).orderBy("ord").collect()] == ids


def test_blank_surface_is_an_error(spark):
    badges = spark.createDataFrame([(1, "(1)(A)", "d", " \t ")], BADGES)
    with pytest.raises(PySparkException, match="blank surface"):
        I.merge_badges(I.empty_inventory(spark), badges)


BAD_ITEMS = {
    "no id": (None, "(1)(A)", "d", "s", []),
    "code": (1, "(9)(A)", "d", "s", []),
    "no description": (1, "(1)(A)", None, "s", []),
    "blank surface": (1, "(1)(A)", "d", " ", []),
    "alias without": (1, "(1)(A)", "d", "s", [(1, "")]),
    "an alias": (1, "(1)(A)", "d", "s", [(None, "t")]),
}


@pytest.mark.parametrize("what", BAD_ITEMS)
def test_incomplete_items_are_errors_whatever_is_read(spark, what):
    inv = I.from_nested(nested(spark, [BAD_ITEMS[what]]))
    for df in (inv.items, inv.items.select("scope"), inv.items.agg({"item_pos": "max"}), inv.aliases.select("alias_pos"), I.pattern_set(inv)):
        with pytest.raises(PySparkException, match=what):
            df.collect()


def test_aliases(spark, depot):
    asked = [(1, 12, "gate 7731"), (2, 12, "7731QX"), (3, 12, " 7731-QX"), (4, 12, "QX "), (5, 12, "gate 7731")]
    requests = spark.createDataFrame(asked, "ord int, item_id bigint, surface string")
    inv, results = I.add_aliases(depot, requests)
    assert [r["alias_id"] for r in results.orderBy("ord").collect()] == [5, 0, 0, 6, 0]
    assert items_of(inv)[0][4] == [(1, "7731QX"), (4, "7731 qx"), (5, "gate 7731"), (6, "QX")]
    bad = spark.createDataFrame([(1, 40, "x"), (2, 12, "  ")], "ord int, item_id bigint, surface string")
    _, reported = I.add_aliases(depot, bad, on_error="report")
    assert [(r["alias_id"], r["error"] is None) for r in reported.collect()] == [(None, False)] * 2
    with pytest.raises(PySparkException):
        I.add_aliases(depot, bad)


def test_lookups(spark, depot):
    keys = spark.createDataFrame([(12, 4), (12, 77), (6, 1)], "item_id bigint, alias_id bigint")
    got = {(r["item_id"], r["alias_id"]): r["surface"] for r in I.find_aliases(depot, keys).collect()}
    assert got == {(12, 4): "7731 qx", (12, 77): None, (6, 1): None}
    assert I.find_items(depot, keys.select("item_id")).filter("surface is null").count() == 1
    assert [r["surface"] for r in I.list_aliases(depot, 12).collect()] == ["7731QX", "7731 qx"]
    with pytest.raises(LookupError):
        I.list_aliases(depot, 6)
    assert I.next_item_id(depot.items) == 13 and I.next_item_id(I.empty_inventory(spark).items) == 1


def test_last_of_equal_ids_and_surfaces_wins(spark):
    inv = I.from_nested(
        nested(spark, [(1, "(1)(A)", "a", "x", [(1, "y")]), (1, "(1)(B)", "b", "z", [(1, "x"), (1, "late")])])
    )
    assert I.by_id(inv).first()["surface"] == "z"
    assert I.alias_surfaces(inv).first()["surface"] == "x"
    got = {r["surface"]: (r["desc"], r["variant"]) for r in I.pattern_set(inv).collect()}
    assert got == {"x": ("b", "a"), "y": ("a", "a"), "z": ("b", "c"), "late": ("b", "a")}


def test_listing_and_snapshot(spark, depot):
    assert I.list_items(depot).first()["line"] == (
        "- #12 (2)(B)(a): gate code (7731-QX)  (aliases: 1:7731QX, 4:7731 qx)"
    )
    assert I.snapshot(I.empty_inventory(spark)).first()[0] == "(empty inventory)"
    many = I.from_nested(nested(spark, [(i, "(1)(A)", "d", f"s{i}", []) for i in range(1, 6)]))
    assert I.snapshot(many, 2).first()[0] == (
        "- #1 (1)(A) :: d :: s1\n- #2 (1)(A) :: d :: s2\n... (truncated; 3 more items)"
    )
    assert I.snapshot(many, 5).first()[0].count("\n") == 4


def test_number_rows_with_a_hot_group(spark):
    rows = [(0 if i % 3 else i % 50, i * 7919 % 5000) for i in range(5000)]
    df = spark.createDataFrame(rows, "g int, o int")
    got = {(r["g"], r["o"]): r["rn"] for r in number_rows(df, ["o"], ["g"]).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted(o for k, o in rows if k == g)
        assert [got[(g, o)] for o in mine] == list(range(1, len(mine) + 1))
    flat = number_rows(df.select("o"), ["o"]).collect()
    assert all(r["rn"] == r["o"] + 1 for r in flat)
