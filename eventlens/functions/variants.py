"""Type tests on VARIANT values; never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How schema_of_variant names the JSON types.
_EXACT = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID", "integer": "BIGINT"}
_PREFIX = {"object": "OBJECT<", "array": "ARRAY<"}


def is_type(node: Column, name: str) -> Column:
    """Is the value of this JSON type?  Missing values are of no type.

    ``integer`` means written as a whole number; ``number`` is any number.
    """
    schema = F.schema_of_variant(node)
    if name in _PREFIX:
        found = schema.startswith(_PREFIX[name])
    elif name in _EXACT:
        found = schema == _EXACT[name]
    elif name == "number":
        found = schema.isin("BIGINT", "DOUBLE", "FLOAT") | schema.startswith("DECIMAL")
    else:
        raise ValueError(f"unknown JSON type {name!r}")
    return F.coalesce(found, F.lit(False))


def member(node: Column, name: str) -> Column:
    """Member of an object as VARIANT; SQL null only where there is none."""
    if "'" in name:
        raise ValueError(f"property name {name!r} cannot be addressed")
    return F.try_variant_get(node, f"$['{name}']", "variant")


def keys(node: Column) -> Column:
    return F.map_keys(F.try_variant_get(node, "$", "map<string,variant>"))
