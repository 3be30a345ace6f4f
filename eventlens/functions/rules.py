"""JSON Schemas as data: rows of rules that one expression tests, however many schemas there are.

A schema becomes clauses that all have to hold; a clause is a list of rules of which one has to. A rule
names a path into the value and a test. What has no such form (``items``) is refused with `NotRules`.
"""

from __future__ import annotations

import json
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens.functions.schemas import KNOWN, type_check
from eventlens.functions.variants import is_type, keys

RULE = (
    "path string, op string, negated boolean, num double, text string, texts array<string>, nums array<double>"
)
RULES = f"array<array<struct<{RULE.replace(' ', ': ').replace(',: ', ', ')}>>>"
_TYPES = ("object", "array", "string", "boolean", "null", "integer", "number")
#: Clauses that one schema may become.
MOST = 512


class NotRules(ValueError):
    """The schema has a part that no list of rules expresses."""


def _rule(path: str, op: str, **more) -> dict:
    return {"path": path, "op": op, "negated": False, "num": None, "text": None, "texts": [], "nums": []} | more


def _child(path: str, name: str) -> str:
    if "'" in name:
        raise ValueError(f"property name {name!r} cannot be addressed")
    return f"{path}['{name}']"


Formula = tuple  # ("rule", rule) | ("and", [Formula]) | ("or", [Formula]) | ("not", Formula)


def _formula(schema: dict | bool, path: str) -> Formula:
    if isinstance(schema, bool):
        return ("and", []) if schema else ("or", [])
    unknown = set(schema) - KNOWN
    if unknown:
        raise ValueError(f"unsupported schema constraints: {sorted(unknown)}")
    if "items" in schema:
        raise NotRules("items")
    parts: list[Formula] = []

    def add(op: str, **more) -> None:
        parts.append(("rule", _rule(path, op, **more)))

    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if set(names) - set(_TYPES):
            raise ValueError(f"unknown JSON type in {names!r}")
        add("type", texts=names)
    for name in ("enum", "const"):
        if name in schema:
            values = schema["enum"] if name == "enum" else [schema["const"]]
            plain = [v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
            rest = [json.dumps(v, sort_keys=True) for v in values if v not in plain or isinstance(v, bool)]
            add("enum", nums=[float(v) for v in plain], texts=rest)
    for name in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "minItems", "maxItems"):
        if name in schema:
            add(name, num=float(schema[name]))
    if "pattern" in schema:
        add("pattern", text=schema["pattern"])
    for name in schema.get("required", []):
        add("required", text=_child(path, name))
    for name, sub in schema.get("properties", {}).items():
        child = _child(path, name)
        parts.append(("or", [("rule", _rule(child, "absent")), _formula(sub, child)]))
    extra = schema.get("additionalProperties", True)
    if extra is False:
        add("keys", texts=list(schema.get("properties", {})))
    elif extra is not True:
        raise ValueError("additionalProperties must be true or false")
    parts += [_formula(sub, path) for sub in schema.get("allOf", [])]
    if "anyOf" in schema:
        parts.append(("or", [_formula(sub, path) for sub in schema["anyOf"]]))
    if "not" in schema:
        parts.append(("not", _formula(schema["not"], path)))
    return ("and", parts)


def _clauses(formula: Formula, negated: bool = False) -> list[list[dict]]:
    kind, value = formula
    if kind == "rule":
        return [[value | {"negated": value["negated"] != negated}]]
    if kind == "not":
        return _clauses(value, not negated)
    if (kind == "and") != negated:
        found = [clause for part in value for clause in _clauses(part, negated)]
    else:
        found = [[]]
        for part in value:
            found = [a + b for a, b in product(found, _clauses(part, negated))]
            if len(found) > MOST:
                break
    if len(found) > MOST:
        raise NotRules("too many clauses")
    return found


def rules_of(schema: dict | bool) -> list[list[dict]]:
    """The clauses of a schema, as rows of a configuration table hold them."""
    return _clauses(_formula(schema, "$"))


def _test(node: Column, rule: Column) -> Column:
    value = F.try_variant_get(node, rule["path"], "variant")
    number = F.try_variant_get(value, "$", "double")
    text = F.try_variant_get(value, "$", "string")
    size = F.size(F.try_variant_get(value, "$", "array<variant>"))
    num, op = rule["num"], rule["op"]
    typed = F.lit(False)
    for name in _TYPES:
        typed = typed | (F.array_contains(rule["texts"], name) & type_check(value, name))
    # texts are compared as compact JSON of a parsed value on both sides
    same = F.exists(rule["texts"], lambda t: F.to_json(F.parse_json(t)) == F.to_json(value))
    listed = (is_type(value, "number") & F.coalesce(F.array_contains(rule["nums"], number), F.lit(False))) | F.coalesce(
        ~is_type(value, "number") & same, F.lit(False)
    )
    numeric = {
        "minimum": number >= num, "maximum": number <= num, "exclusiveMinimum": number > num, "exclusiveMaximum": number < num,
    }
    textual = {"minLength": F.length(text) >= num, "maxLength": F.length(text) <= num, "pattern": F.rlike(text, rule["text"])}
    sized = {"minItems": size >= num, "maxItems": size <= num}
    found = F.when(op == "type", typed).when(op == "enum", listed).when(op == "absent", value.isNull())
    for tests, name in ((numeric, "number"), (textual, "string"), (sized, "array")):
        for key, test in tests.items():
            found = found.when(op == key, ~is_type(value, name) | F.coalesce(test, F.lit(False)))
    there = F.try_variant_get(node, rule["text"], "variant").isNotNull()
    found = found.when(op == "required", ~is_type(value, "object") | there)
    only = F.size(F.array_except(keys(value), rule["texts"])) == 0
    found = found.when(op == "keys", ~is_type(value, "object") | F.coalesce(only, F.lit(False)))
    return found != rule["negated"]


def holds(node: Column, clauses: Column) -> Column:
    """Never-null boolean: does ``node`` satisfy the rules?"""
    return F.coalesce(F.forall(clauses, lambda clause: F.exists(clause, lambda rule: _test(node, rule))), F.lit(False))
