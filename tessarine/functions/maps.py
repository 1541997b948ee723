"""Map columns and checked values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(a: Column, b: Column) -> Column:
    """Entries of both maps; where both have a key, b's entry wins. Null maps are empty."""
    none = F.create_map().cast("map<string,string>")
    left, right = F.coalesce(a, none), F.coalesce(b, none)
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def get(m: Column, key: str, default: str | None = None) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


#: What requests may say.
AGENTS = ("tile", "wsi", "aml")
QUALITIES = ("good", "bad")
EXPORTS = ("jpg", "png")


def rejection(**checks: Column) -> Column:
    """Name of the first check that doesn't hold (or is null), else null."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks.items()):
        out = F.when(~F.coalesce(ok, F.lit(False)), f"invalid_{name}").otherwise(out)
    return out


def request_error(agent: Column, quality: Column, export: Column, size: Column) -> Column:
    """What is wrong with a request's words and numbers, the first of it, or null."""
    return rejection(agent=agent.isin(*AGENTS), quality=quality.isin(*QUALITIES), export=export.isin(*EXPORTS), size=size > 0)
