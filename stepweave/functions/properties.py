"""Properties of nodes and edges: JSON text in tables, variants in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(c: Column) -> Column:
    """A struct, map or variant as JSON text; null as an empty object."""
    return F.coalesce(F.to_json(c), F.lit("{}"))


def decode(c: Column) -> Column:
    """JSON text as a variant; null, an empty text and what is no JSON as an empty object."""
    return F.coalesce(F.try_parse_json(F.when(c != "", c)), F.parse_json(F.lit("{}")))


def strings(c: Column, key: str) -> Column:
    """The strings of an array under a key, in order; null where there is no array."""
    items = F.from_json(F.get_json_object(c, f"$.{key}"), "array<variant>")
    return F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string"))
