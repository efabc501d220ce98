"""JSON texts: parsing, paths, what they hold, and writing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """A value of any kind; null for null and for what is no JSON."""
    return F.try_parse_json(text)


def at(text: Column, path: str, kind: str = "string") -> Column:
    """The value at a path as a type; null where there is none or it cannot be one."""
    return F.try_variant_get(parse(text), path, kind)


def contains(text: Column, path: str) -> Column:
    """Whether a path is there, a null at it included."""
    return F.coalesce(F.try_variant_get(parse(text), path, "variant").isNotNull(), F.lit(False))


# The kinds of JSON, by the types that a value is read as.
_KINDS = {"BOOLEAN": "boolean", "STRING": "string", "VOID": "null"}


def kind(text: Column, path: str = "$") -> Column:
    """object, array, string, number, boolean or null; null where the path is not there."""
    shown = F.schema_of_variant(F.try_variant_get(parse(text), path, "variant"))
    known = F.coalesce(*[F.when(shown == k, F.lit(v)) for k, v in _KINDS.items()])
    return F.when(shown.startswith("OBJECT"), "object").when(shown.startswith("ARRAY"), "array").when(known.isNotNull(), known).when(shown.isNotNull(), "number")


def dump(**fields: Column) -> Column:
    """An object with these fields, in this order."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
