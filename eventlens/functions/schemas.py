"""A subset of JSON Schema compiled to a Column predicate over VARIANT.

Supported: ``true``/``false`` schemas, ``type``, ``enum``, ``const``,
``required``, ``properties``, ``additionalProperties: false``, ``minimum``,
``maximum``, ``exclusiveMinimum``, ``exclusiveMaximum``, ``minLength``,
``maxLength``, ``pattern``, ``items``, ``minItems``, ``maxItems``, ``allOf``,
``anyOf`` and ``not``.  Any other constraint raises, so that a schema is never
half applied.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens.functions.variants import is_type, keys, member

_NOTES = {"title", "description", "$schema", "$id", "default", "examples", "$comment"}
_NUMERIC = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum")
KNOWN = _NOTES | set(_NUMERIC) | {
    "type", "enum", "const", "required", "properties", "additionalProperties",
    "minLength", "maxLength", "pattern", "items", "minItems", "maxItems",
    "allOf", "anyOf", "not",
}


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _holds(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def _number(node: Column) -> Column:
    return F.try_variant_get(node, "$", "double")


def type_check(node: Column, name: str) -> Column:
    if name == "integer":
        whole = _holds(_number(node) == F.floor(_number(node)))
        return is_type(node, "integer") | (is_type(node, "number") & whole)
    return is_type(node, name)


def _equals(node: Column, value: object) -> Column:
    if isinstance(value, bool):
        return type_check(node, "boolean") & _holds(
            F.try_variant_get(node, "$", "boolean") == F.lit(value)
        )
    if isinstance(value, (int, float)):
        return is_type(node, "number") & _holds(_number(node) == F.lit(float(value)))
    if isinstance(value, str):
        return type_check(node, "string") & _holds(
            F.try_variant_get(node, "$", "string") == F.lit(value)
        )
    if value is None:
        return type_check(node, "null")
    text = json.dumps(value, sort_keys=True)
    return _holds(F.to_json(node) == F.to_json(F.parse_json(F.lit(text))))


def valid_variant(node: Column, schema: dict | bool) -> Column:
    """Never-null boolean: does ``node`` satisfy ``schema``?"""
    if isinstance(schema, bool):
        return F.lit(schema)
    unknown = set(schema) - KNOWN
    if unknown:
        raise ValueError(f"unsupported schema constraints: {sorted(unknown)}")
    parts: list[Column] = []
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        parts.append(reduce(lambda a, b: a | b, [type_check(node, n) for n in names]))
    if "enum" in schema:
        parts.append(
            reduce(lambda a, b: a | b, [_equals(node, v) for v in schema["enum"]], F.lit(False))
        )
    if "const" in schema:
        parts.append(_equals(node, schema["const"]))

    number = _number(node)
    numeric = []
    for rule, test in (
        ("minimum", lambda v: number >= v),
        ("maximum", lambda v: number <= v),
        ("exclusiveMinimum", lambda v: number > v),
        ("exclusiveMaximum", lambda v: number < v),
    ):
        if rule in schema:
            numeric.append(test(F.lit(float(schema[rule]))))
    if numeric:
        parts.append(~is_type(node, "number") | _holds(_all(numeric)))

    text = F.try_variant_get(node, "$", "string")
    textual = []
    if "minLength" in schema:
        textual.append(F.length(text) >= schema["minLength"])
    if "maxLength" in schema:
        textual.append(F.length(text) <= schema["maxLength"])
    if "pattern" in schema:
        textual.append(text.rlike(schema["pattern"]))
    if textual:
        parts.append(~type_check(node, "string") | _holds(_all(textual)))

    items = F.try_variant_get(node, "$", "array<variant>")
    listed = []
    if "minItems" in schema:
        listed.append(F.size(items) >= schema["minItems"])
    if "maxItems" in schema:
        listed.append(F.size(items) <= schema["maxItems"])
    if "items" in schema:
        listed.append(F.forall(items, lambda x: valid_variant(x, schema["items"])))
    if listed:
        parts.append(~type_check(node, "array") | _holds(_all(listed)))

    keyed = []
    for name in schema.get("required", []):
        keyed.append(member(node, name).isNotNull())
    for name, sub in schema.get("properties", {}).items():
        keyed.append(member(node, name).isNull() | valid_variant(member(node, name), sub))
    extra = schema.get("additionalProperties", True)
    if extra is False:
        known = F.array(*[F.lit(n) for n in schema.get("properties", {})])
        keyed.append(F.size(F.array_except(keys(node), known.cast("array<string>"))) == 0)
    elif extra is not True:
        raise ValueError("additionalProperties must be true or false")
    if keyed:
        parts.append(~type_check(node, "object") | _holds(_all(keyed)))

    for sub in schema.get("allOf", []):
        parts.append(valid_variant(node, sub))
    if "anyOf" in schema:
        parts.append(reduce(lambda a, b: a | b, [valid_variant(node, s) for s in schema["anyOf"]]))
    if "not" in schema:
        parts.append(~valid_variant(node, schema["not"]))
    return _all(parts)


def valid_json(json_text: Column, schema_text: str) -> Column:
    return valid_variant(F.try_parse_json(json_text), json.loads(schema_text))
