"""Schemas of the inventory, in nested (file) and flat (working) form."""

from __future__ import annotations

ITEM_JSON = (
    "id bigint, code string, desc string, surface string, aliases array<struct<id:bigint,surface:string>>, scope string"
)
ITEMS = "item_pos bigint, id bigint, code string, desc string, surface string, scope string"
ALIASES = "item_pos bigint, item_id bigint, alias_pos bigint, alias_id bigint, surface string"
PATTERNS = "surface string, item_id bigint, code string, desc string, variant string, alias_id bigint"
