"""Schemas as rules say what compiled schemas say."""

import json

import pytest
from pyspark.sql import functions as F

from eventlens.functions.rules import RULES, NotRules, holds, rules_of
from eventlens.functions.schemas import valid_json
from eventlens.operators import normalize
from eventlens.operators.lookup import config_table

SCHEMAS = [
    True,
    False,
    {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer", "minimum": 2}, "b": {"type": ["string", "null"]}}},
    {"properties": {"a": {"properties": {"c": {"enum": [1, "x", None, True, [1, 2], {"q": 1}]}}, "additionalProperties": False}}},
    {"anyOf": [{"required": ["a"]}, {"properties": {"b": {"pattern": "^x+$", "minLength": 2, "maxLength": 3}}, "required": ["b"]}]},
    {"not": {"properties": {"a": {"const": 1}}, "required": ["a"]}},
    {"allOf": [{"minItems": 1}, {"maxItems": 2}], "type": ["array", "object"]},
    {"not": {"anyOf": [{"type": "string"}, {"exclusiveMinimum": 3, "exclusiveMaximum": 9, "type": "number"}]}},
    {"const": "x"},
    {"additionalProperties": False, "properties": {"a": True, "b": {"not": {"maximum": 1}}}},
]
VALUES = ["1", "4", "9.5", '"x"', '"xx"', "null", "true", "[]", "[1]", "[1,2]", "[1,2,3]", "{}", '{"a":1}', '{"a":1.0}', '{"a":2,"b":"s"}',
          '{"a":5,"b":null}', '{"a":2.5,"b":"x"}', '{"b":"xx"}', '{"b":"xxxx"}', '{"b":7}', '{"a":{"c":1}}', '{"a":{"c":"x"}}', '{"a":{"c":"y"}}',
          '{"a":{"c":[1,2]}}', '{"a":{"c":{"q":1}}}', '{"a":{"c":null,"d":1}}', '{"a":{"c":true}}', '{"z":1}', '{"b":0}', '{"a":null}']


@pytest.mark.parametrize("number", range(len(SCHEMAS)))
def test_rules_agree_with_compiled_schemas(spark, number):
    schema = SCHEMAS[number]
    rows = spark.createDataFrame([(v,) for v in VALUES], "j string").coalesce(1)
    table = config_table(spark, [{"rules": rules_of(schema)}], f"rules {RULES}")
    got = rows.join(table).select(
        "j", holds(F.parse_json("j"), F.col("rules")).alias("ruled"), valid_json(F.col("j"), json.dumps(schema)).alias("compiled")
    )
    assert [r["j"] for r in got.collect() if r["ruled"] != r["compiled"]] == []


def test_what_rules_cannot_say():
    with pytest.raises(NotRules):
        rules_of({"items": {"type": "string"}})
    with pytest.raises(NotRules):
        rules_of({"anyOf": [{"required": [f"{i}{j}" for j in range(9)]} for i in range(4)]})
    with pytest.raises(ValueError, match="unsupported"):
        rules_of({"contains": {}})


def test_compiled_and_ruled_schemas_side_by_side(make_events):
    rows = make_events([("1", "a", "k", 1, '{"x":["s"]}'), ("2", "a", "k", 1, '{"x":[1]}'), ("3", "b", "k", 1, '{"x":3}'), ("4", "b", "k", 1, "[broken")])
    book = normalize.SchemaBook({"a": {"properties": {"x": {"items": {"type": "string"}}}}, "b": {"properties": {"x": {"maximum": 5}}}}, [])
    got = {r["event_id"]: r["schema_invalid"] for r in normalize.validate_semantic(rows, book).collect()}
    assert got == {"1": None, "2": True, "3": None, "4": True}


def test_plans_do_not_grow_with_schemas(make_events):
    import time

    rows = make_events([(str(i), f"s{i}", "k", 1, f'{{"x":{i}}}') for i in range(20)])
    book = normalize.SchemaBook({f"s{i}": {"title": str(i), "properties": {"x": {"maximum": 9}}} for i in range(5000)}, [])
    begun = time.monotonic()
    checked = normalize.validate_semantic(rows, book)
    checked._jdf.queryExecution().executedPlan()
    assert time.monotonic() - begun < 20
    assert checked.where("schema_invalid").count() == 10
