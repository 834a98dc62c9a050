import pytest

from helpers import nested, texts
from redactlake.operators import audit as A
from redactlake.operators import redact as R
from redactlake.operators import restore as S
from redactlake.operators.inventory import from_nested

OWN = "[REDACTED(#12|var=c): (2)(B)(a), gate code]"
OTHER = "[REDACTED(#12|var=a4): (2)(B)(a), gate code]"
CASES = [
    ("[REDACTED(#13|var=c): (2)(B)(a), gate code]", None),
    (OWN, "7731-QX"),
    (OTHER, "7731 qx"),
    (f"{OTHER}{OWN}; {OWN}", "7731 qx7731-QX; 7731-QX"),
    ("[REDACTED(#12|var=a3): any, words]", "7731-QX"),
    ("[REDACTED(#008|var=c): any, words] [REDACTED(#١٢|var=a٠٤): any, words]", "[REDACTED(#008|var=c): any, words] 7731 qx"),
    (f"```\n{OWN}\n```", "```\n7731-QX\n```"),
    ("[REDACTED(#12|var=c): over\ntwo, lines\n]?", "7731-QX?"),
    ("[REDACTED(#12|var=c): lacks a comma]", None),
    ("[REDACTED(#123456789012345678901|var=c): any, words]", None),
    ("[REDACTED(#12|var=d): any, words]", None),
    ("gate", None),
    ("", None),
    (None, None),
]
BOUNDS = pytest.mark.parametrize("bound", [1 << 20, 0], ids=["broadcast", "join"])


@BOUNDS
def test_restore(spark, depot, bound):
    docs = texts(spark, [c for c, _ in CASES])
    got = {r["doc_id"]: r["restored"] for r in S.restore_documents(docs, depot, ["doc_id"], max_broadcast_bytes=bound).collect()}
    assert [got[i] for i in range(len(CASES))] == [want or text for text, want in CASES]


@BOUNDS
def test_documents_sharing_a_key_or_having_none(spark, depot, bound):
    rows = [(3, f"x {OWN}"), (3, f"{OTHER} y"), (3, f"x {OWN}"), (None, OWN), (None, f"{OWN} z"), (None, None)]
    docs = spark.createDataFrame(rows, "item_id bigint, text string")
    got = S.restore_documents(docs, depot, ["item_id"], max_broadcast_bytes=bound).collect()
    want = [(3, "x 7731-QX", 1), (3, "7731 qx y", 1), (3, "x 7731-QX", 1), (None, "7731-QX", 1), (None, "7731-QX z", 1), (None, None, 0)]
    assert sorted(((r["item_id"], r["restored"], r["n_tags"]) for r in got), key=str) == sorted(want, key=str)


def test_round_trip_and_idempotency(spark, depot):
    docs = texts(spark, ["Ring, then type 7731QX; at night 7731-QX works as well.", "The gate is open.", f"Type {OWN} as ever."])
    matcher = R.matcher_for(depot)
    red = {r["doc_id"]: r for r in R.redact_documents(docs, matcher, ["doc_id"]).collect()}
    first = OTHER.replace("a4", "a1")
    assert red[0]["redacted"] == f"Ring, then type {first}; at night {OWN} works as well."
    assert [red[i]["n_matches"] for i in range(3)] == [2, 0, 0]
    audit = {r["doc_id"]: r["is_equal"] for r in A.roundtrip(docs, depot, matcher, ["doc_id"]).collect()}
    assert audit == {0: True, 1: True, 2: False}
    twice = A.idempotency(docs, matcher, ["doc_id"]).collect()
    assert all(r["n_second"] == 0 and r["is_equal"] for r in twice)


def test_bracket_in_description_is_reported(spark):
    inv = from_nested(nested(spark, [(5, "(2)(B)", "code [old] gate", "0000", [])]))
    docs = texts(spark, ["0000 was it"])
    assert A.roundtrip(docs, inv, R.matcher_for(inv), ["doc_id"]).first()["is_equal"] is False


def test_pieces_of_texts_are_not_sorted_for_the_inventory(spark, depot):
    """A task of the join holds its share of the inventory, not that of the texts."""
    docs = texts(spark, [f"{OWN} {i}" for i in range(20)])
    restored = S.restore_documents(docs, depot, ["doc_id"], max_broadcast_bytes=0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = S.resolve_tags(S.parse_tags(docs, ["doc_id"]), depot, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ShuffledHashJoin") == 2
        assert {r["restored"] for r in restored.collect()} == {f"7731-QX {i}" for i in range(20)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
