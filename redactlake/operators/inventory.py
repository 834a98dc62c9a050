"""The inventory of sensitive strings: merge, aliases, lookups, listings and patterns.

Items and aliases are kept as two flat tables, so one item may own any number of aliases. The
list order of the file form is data (it decides which of two equal surfaces wins), hence
``item_pos`` and ``alias_pos``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from .numbering import number_rows


@dataclass(frozen=True)
class Inventory:
    items: DataFrame
    aliases: DataFrame


@dataclass(frozen=True)
class MergeResult:
    inventory: Inventory
    assigned: DataFrame
    """One row per distinct (code, desc, surface) with its ``item_id`` and ``is_new``."""


def empty_inventory(spark: SparkSession) -> Inventory:
    """No items. Written as a false filter, so the optimizer folds away all that hangs on it."""

    def empty(schema: str) -> DataFrame:
        columns = (c.split() for c in schema.split(", "))
        return spark.range(1).selectExpr(*[f"cast(NULL AS {t}) AS `{c}`" for c, t in columns]).filter("false")

    return Inventory(empty(schemas.ITEMS), empty(schemas.ALIASES))


def _item_error(alias_blank: Column) -> Column:
    """What is wrong with a nested item, or null."""
    blank = F.coalesce(T.strip(F.col("surface")), F.lit("")) == ""
    named = F.concat(F.lit("inventory item "), F.coalesce(F.col("id").cast("string"), F.lit("without id")))
    return (
        F.when(F.col("id").isNull(), F.concat(F.lit("inventory item at position "), F.col("item_pos").cast("string"), F.lit(" has no id")))
        .when(~F.coalesce(T.is_code(F.col("code")), F.lit(False)), F.concat(named, F.lit(": code is not in the legend")))
        .when(F.col("desc").isNull(), F.concat(named, F.lit(": no description")))
        .when(blank, F.concat(named, F.lit(": blank surface")))
        .when(alias_blank, F.concat(named, F.lit(": an alias without id or surface")))
    )


def from_nested(nested: DataFrame) -> Inventory:
    """Flatten rows (item_pos, id, code, desc, surface, aliases, scope), rejecting incomplete ones.

    The check is a filter, which stays whatever columns are read later.
    """
    bad_alias = F.coalesce(
        F.exists("aliases", lambda a: a["id"].isNull() | (F.coalesce(T.strip(a["surface"]), F.lit("")) == "")), F.lit(False)
    )
    error = _item_error(bad_alias)
    nested = nested.filter(F.when(error.isNull(), F.lit(True)).otherwise(F.raise_error(error).cast("boolean")))
    items = nested.select(
        F.col("item_pos").cast("bigint").alias("item_pos"),
        F.col("id").cast("bigint").alias("id"),
        "code",
        "desc",
        T.strip(F.col("surface")).alias("surface"),
        F.coalesce(F.col("scope"), F.lit("global")).alias("scope"),
    )
    aliases = nested.select(
        F.col("item_pos").cast("bigint").alias("item_pos"),
        F.col("id").cast("bigint").alias("item_id"),
        F.posexplode("aliases").alias("alias_pos", "a"),
    ).select(
        "item_pos",
        "item_id",
        F.col("alias_pos").cast("bigint").alias("alias_pos"),
        F.col("a.id").cast("bigint").alias("alias_id"),
        T.strip(F.col("a.surface")).alias("surface"),
    )
    return Inventory(items, aliases)


def to_nested(inv: Inventory) -> DataFrame:
    """The file form: one row per item with its alias list."""
    lists = inv.aliases.groupBy("item_pos").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("alias_pos", F.col("alias_id").alias("id"), "surface"))),
            lambda a: F.struct(a["id"].alias("id"), a["surface"].alias("surface")),
        ).alias("aliases")
    )
    none = F.array().cast("array<struct<id:bigint,surface:string>>")
    return inv.items.join(lists, "item_pos", "left").select(
        "item_pos", "id", "code", "desc", "surface", F.coalesce("aliases", none).alias("aliases"), "scope"
    )


def next_item_id(items: DataFrame) -> int:
    return items.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1


def by_id(inv: Inventory) -> DataFrame:
    """One row per id; of items sharing an id the last one counts."""
    cols = inv.items.columns
    return inv.items.groupBy("id").agg(F.max_by(F.struct(*cols), "item_pos").alias("i")).select("i.*")


def find_items(inv: Inventory, ids: DataFrame) -> DataFrame:
    """Left-join the items to a column of ids (``item_id``)."""
    items = by_id(inv).withColumnRenamed("id", "item_id")
    return ids.join(items, "item_id", "left")


def alias_surfaces(inv: Inventory) -> DataFrame:
    """(item_id, alias_id, surface) as lookups see it."""
    current = by_id(inv).select("item_pos", F.col("id").alias("item_id"))
    return (
        inv.aliases.drop("item_id")
        .join(current, "item_pos")
        .groupBy("item_id", "alias_id")
        .agg(F.min_by("surface", "alias_pos").alias("surface"))
    )


def find_aliases(inv: Inventory, keys: DataFrame) -> DataFrame:
    """Left-join alias surfaces to (item_id, alias_id) keys."""
    return keys.join(alias_surfaces(inv), ["item_id", "alias_id"], "left")


def merge_badges(inv: Inventory, badges: DataFrame) -> MergeResult:
    """Upsert badges (ord, code, desc, surface).

    A badge is absorbed by an item with the same (code, surface), or by one with the same
    (code, desc) that has the surface as an alias. Others become items, one per (code,
    surface) with the first description seen, numbered on in order of first appearance.
    """
    stripped = T.strip(F.col("surface"))
    usable = F.when(F.coalesce(stripped, F.lit("")) != "", F.lit(True)).otherwise(
        F.raise_error(F.lit("a badge has a blank surface")).cast("boolean")
    )
    # Copies of a badge collapse map-side, before any join.
    distinct = (
        badges.filter(usable)
        .select("ord", "code", "desc", stripped.alias("surface"))
        .groupBy("code", "desc", "surface")
        .agg(F.min("ord").alias("ord"))
    )
    hit = F.struct("item_pos", "id")
    canonical = inv.items.groupBy("code", "surface").agg(F.min(hit).alias("by_surface"))
    alias_owner = (
        inv.aliases.select("item_pos", "surface")
        .join(inv.items.select("item_pos", "id", "code", "desc"), "item_pos")
        .groupBy("code", "desc", "surface")
        .agg(F.min(hit).alias("by_alias"))
    )
    tested = distinct.join(canonical, ["code", "surface"], "left").join(
        alias_owner, ["code", "desc", "surface"], "left"
    )
    fresh = (
        tested.filter(F.col("by_surface").isNull() & F.col("by_alias").isNull())
        .groupBy("code", "surface")
        .agg(F.min_by("desc", "ord").alias("desc"), F.min("ord").alias("ord"))
    )
    numbered = number_rows(fresh, ["ord"])
    last = inv.items.agg(F.max("id").alias("id"), F.max("item_pos").alias("pos")).first()
    new_items = numbered.select(
        (F.col("rn") + F.lit(-1 if last["pos"] is None else last["pos"])).alias("item_pos"),
        (F.col("rn") + F.lit(last["id"] or 0)).alias("id"),
        "code",
        "desc",
        "surface",
        F.lit("global").alias("scope"),
    )
    first_hit = F.least("by_surface", "by_alias")["id"]
    created = new_items.select("code", "surface", F.col("id").alias("new_id"))
    assigned = tested.join(created, ["code", "surface"], "left").select(
        "code",
        "desc",
        "surface",
        F.coalesce(first_hit, "new_id").alias("item_id"),
        first_hit.isNull().alias("is_new"),
    )
    return MergeResult(Inventory(inv.items.unionByName(new_items), inv.aliases), assigned)


def assign_badges(result: MergeResult, badges: DataFrame) -> DataFrame:
    """The item each single badge resolves to."""
    keyed = badges.withColumn("surface", T.strip(F.col("surface")))
    return keyed.join(result.assigned, ["code", "desc", "surface"], "left")


def add_aliases(inv: Inventory, requests: DataFrame, on_error: str = "raise") -> tuple[Inventory, DataFrame]:
    """Append aliases (ord, item_id, surface) in the order of ``ord``, which must be unique; also
    return the outcome per request.

    ``alias_id`` in the outcome is 0 when the surface was there already (as the item's own, as
    an alias, or from an earlier request). Unknown items and blank surfaces fail the job, or
    are reported in ``error`` with ``on_error='report'``.
    """
    requests = requests.select("ord", "item_id", T.strip(F.col("surface")).alias("surface"))
    current = by_id(inv).select(
        F.col("id").alias("item_id"), "item_pos", F.col("surface").alias("own_surface"), F.lit(True).alias("known")
    )
    distinct = requests.groupBy("item_id", "surface").agg(F.min("ord").alias("first_ord"))
    error = F.when(
        F.col("known").isNull(), F.concat(F.lit("no item with id "), F.coalesce(F.col("item_id").cast("string"), F.lit("null")))
    ).when(F.col("surface") == "", F.lit("an alias needs a surface that is not blank"))
    placed = distinct.join(current, "item_id", "left").withColumn("error", error)
    usable = F.col("error").isNull()
    if on_error == "raise":
        usable = F.when(usable, True).otherwise(F.raise_error("error").cast("boolean"))
    existing = inv.aliases.select("item_pos", "surface").distinct()
    new = placed.filter(usable & (F.col("surface") != F.col("own_surface"))).join(
        existing, ["item_pos", "surface"], "left_anti"
    )
    numbered = number_rows(new.select("item_pos", "item_id", "surface", "first_ord"), ["first_ord"], ["item_pos"])
    tops = inv.aliases.groupBy("item_pos").agg(
        F.max("alias_id").alias("top_id"), F.max("alias_pos").alias("top_pos")
    )
    added = numbered.join(tops, "item_pos", "left").select(
        "item_pos",
        "item_id",
        (F.coalesce("top_pos", F.lit(-1)) + F.col("rn")).alias("alias_pos"),
        (F.coalesce("top_id", F.lit(0)) + F.col("rn")).alias("alias_id"),
        "surface",
        "first_ord",
    )
    # Only the first request for a surface can have added it; joining on ``ord`` meets no hot key.
    created = added.select(F.col("first_ord").alias("ord"), F.col("alias_id").alias("new_id"))
    results = requests.join(created, "ord", "left")
    none = F.lit(None).cast("string")
    if on_error == "report":
        bad = placed.filter(F.col("error").isNotNull()).select("item_id", "surface", "error")
        results = results.join(bad, ["item_id", "surface"], "left")
    else:
        results = results.withColumn("error", none)
    results = results.select(
        "ord",
        "item_id",
        "surface",
        F.when(F.col("error").isNull(), F.coalesce("new_id", F.lit(0))).alias("alias_id"),
        "error",
    )
    aliases = inv.aliases.unionByName(added.drop("first_ord"))
    return Inventory(inv.items, aliases), results


def pattern_set(inv: Inventory) -> DataFrame:
    """Every surface to look for, canonical and alias; of equal surfaces the last one wins."""
    none = F.lit(None).cast("bigint")
    canonical = inv.items.select(
        "item_pos",
        F.lit(-1).cast("bigint").alias("alias_pos"),
        "surface",
        F.col("id").alias("item_id"),
        "code",
        "desc",
        F.lit("c").alias("variant"),
        none.alias("alias_id"),
    )
    owners = inv.items.select("item_pos", F.col("id").alias("item_id"), "code", "desc")
    alias = inv.aliases.drop("item_id").join(owners, "item_pos").select(
        "item_pos", "alias_pos", "surface", "item_id", "code", "desc", F.lit("a").alias("variant"), "alias_id"
    )
    return (
        canonical.unionByName(alias)
        .filter(F.col("surface") != "")
        .groupBy("surface")
        .agg(
            F.max_by(
                F.struct("item_id", "code", "desc", "variant", "alias_id"), F.struct("item_pos", "alias_pos")
            ).alias("p")
        )
        .select("surface", "p.*")
    )


def alias_notes(inv: Inventory) -> DataFrame:
    return inv.aliases.groupBy("item_pos").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("alias_pos", "alias_id", "surface"))),
                lambda a: F.concat(a["alias_id"].cast("string"), F.lit(":"), a["surface"]),
            ),
            ", ",
        ).alias("alias_note")
    )


# The display lines below, and the line that closes a cut snapshot, are fixed formats.


def list_items(inv: Inventory) -> DataFrame:
    """Items by (code, surface) with an ``id:surface, ..`` note of their aliases and a display line."""
    note = F.when(
        F.col("alias_note").isNotNull(), F.concat(F.lit("  (aliases: "), "alias_note", F.lit(")"))
    ).otherwise("")
    return (
        inv.items.join(alias_notes(inv), "item_pos", "left")
        .orderBy("code", "surface", "item_pos")
        .select(
            F.col("id").alias("item_id"),
            "code",
            "desc",
            "surface",
            "alias_note",
            F.concat(
                F.lit("- #"), F.col("id").cast("string"), F.lit(" "), "code", F.lit(": "), "desc",
                F.lit(" ("), "surface", F.lit(")"), note,
            ).alias("line"),
        )
    )


def list_aliases(inv: Inventory, item_id: int) -> DataFrame:
    """Aliases of one item in list order; an unknown item is an error."""
    found = by_id(inv).filter(F.col("id") == item_id).select("item_pos", "id", "code", "desc").first()
    if found is None:
        raise LookupError(f"the inventory has no item with id {item_id}")
    return (
        inv.aliases.filter(F.col("item_pos") == found["item_pos"])
        .orderBy("alias_pos")
        .select("item_id", "alias_pos", "alias_id", "surface")
    )


def snapshot_lines(inv: Inventory, max_items: int = 200) -> DataFrame:
    """The first ``max_items`` items by (code, surface) as prompt lines."""
    return (
        inv.items.orderBy("code", "surface", "item_pos")
        .limit(max_items)
        .select(
            "item_pos",
            "code",
            "surface",
            F.concat(
                F.lit("- #"), F.col("id").cast("string"), F.lit(" "), "code", F.lit(" :: "), "desc",
                F.lit(" :: "), "surface",
            ).alias("line"),
        )
    )


def snapshot(inv: Inventory, max_items: int = 200) -> DataFrame:
    """One row ``snapshot``: the prompt's view of the inventory, with a tail when cut."""
    order = [F.lit(0).alias("is_tail"), "code", "surface", "item_pos", "line"]
    none = F.lit(None).cast("string")
    n = F.col("n") - max_items
    tail = (
        inv.items.agg(F.count("*").alias("n"))
        .filter(n > 0)
        .select(
            F.lit(1).alias("is_tail"),
            none.alias("code"),
            none.alias("surface"),
            F.lit(None).cast("bigint").alias("item_pos"),
            F.concat(F.lit("... (truncated; "), n.cast("string"), F.lit(" more items)")).alias("line"),
        )
    )
    lines = snapshot_lines(inv, max_items).select(*order).unionByName(tail)
    ordered = F.array_sort(F.collect_list(F.struct("is_tail", "code", "surface", "item_pos", "line")))
    body = F.array_join(F.transform(ordered, lambda r: r["line"]), "\n")
    return lines.agg(F.when(F.count("*") == 0, "(empty inventory)").otherwise(body).alias("snapshot"))
