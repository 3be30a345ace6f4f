import fnmatch
import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlens.functions import embedding
from eventlens.functions.globs import any_glob, glob_filter, glob_match, glob_regex
from eventlens.functions.scalars import (
    ID_ALPHABET,
    day_of,
    generated_id,
    kind_name,
    kind_version,
    parse_marked,
    semantic_size,
    strict_value,
    utf8_cut,
    was_cut,
)
from eventlens.functions.schemas import valid_json
from eventlens.functions.topics import (
    csv_fields,
    decode_payload,
    source_from_topic,
    string_at,
    topic_matches,
)


def column(spark, values, expr, kind="string"):
    """Values of ``expr(col)`` over one-column rows, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


NAMES = ["cam.front", "cam.back", "CAM.front", "door_state", "doorXstate", "a/b/c", "a.b", "x[1]"]


@pytest.mark.parametrize(
    ("pattern", "expected"),
    [
        ("cam.*", {"cam.front", "cam.back"}),
        ("door_state", {"door_state"}),
        ("door_*", {"door_state"}),
        ("*", set(NAMES)),
        ("a*c", {"a/b/c"}),
        ("a?b", {"a.b"}),
        ("cam.[a-b]*", {"cam.back"}),
        ("cam.[!b]*", {"cam.front"}),
        ("{a.b,door_state}", {"a.b", "door_state"}),
        (r"x\[1\]", {"x[1]"}),
        ("", set()),
    ],
)
def test_globs(spark, pattern, expected):
    hits = column(spark, NAMES, lambda c: glob_match(c, pattern))
    assert {n for n, hit in zip(NAMES, hits) if hit} == expected


@pytest.mark.parametrize("pattern", ["[abc", "{a,b", "a}", "x\\"])
def test_bad_globs(pattern):
    with pytest.raises(ValueError, match="glob"):
        glob_regex(pattern)


def test_glob_lists(spark):
    assert column(spark, NAMES, lambda c: glob_filter(c, None)) == [True] * len(NAMES)
    assert column(spark, NAMES, lambda c: glob_filter(c, [])) == [True] * len(NAMES)
    assert column(spark, NAMES, lambda c: any_glob(c, [])) == [False] * len(NAMES)


def test_globs_like_fnmatch(spark):
    for pattern in ["*a*", "?am.*", "*[xk]*", "c*.f*t"]:
        got = column(spark, NAMES, lambda c, p=pattern: glob_match(c, p))
        assert got == [fnmatch.fnmatchcase(n, pattern) for n in NAMES]


def test_prefix_globs_are_pushed_down(spark, tmp_path, make_events):
    make_events([("1", "cam.a", "k", 1)]).write.parquet(str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    plan = stored.where(glob_match(F.col("source_id"), "cam.*"))._jdf.queryExecution().toString()
    assert "StringStartsWith(source_id,cam.)" in plan


def test_kind_refs(spark):
    kinds = ["door", "door@v2", "a@b@c", "", "@v1", "door@"]
    assert column(spark, kinds, kind_name) == ["door", "door", "a", None, None, None]
    assert column(spark, kinds, kind_version) == [None, "v2", "b@c", None, None, None]


def test_day(spark):
    days = column(spark, [0, 86_399_999, 86_400_000, -1], day_of, "long")
    assert [str(d) for d in days] == ["1970-01-01", "1970-01-01", "1970-01-02", "1969-12-31"]


def test_generated_id(spark):
    now = 1_700_000_000_123
    row = spark.range(1).select(generated_id(F.lit(now), F.lit("a"), F.lit(7)).alias("x")).first()
    digest = hashlib.sha256(b"a\x1f7").hexdigest()
    bits = int(digest[:20], 16)
    value = (now << 80) | bits
    expected = "".join(ID_ALPHABET[(value >> (5 * i)) & 31] for i in range(25, -1, -1))
    assert row["x"] == expected


def test_generated_ids_sort_by_time(spark):
    got = column(spark, [5, 40, 1 << 40, 1 << 41], lambda c: generated_id(c, F.lit("s")), "long")
    assert got == sorted(got) and {len(x) for x in got} == {26}


TEXTS = st.text(st.characters(codec="utf-8", exclude_characters="\0"), max_size=40)
SLOW = settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


@SLOW
@given(st.lists(TEXTS, min_size=20, max_size=60), st.integers(4, 20))
def test_utf8_cut(spark, texts, limit):
    cut = column(spark, texts, lambda c: utf8_cut(c, limit))
    flags = column(spark, texts, lambda c: was_cut(c, limit))
    for text, got, flag in zip(texts, cut, flags):
        raw = text.encode()
        assert got == raw[:limit].decode(errors="ignore")
        assert flag == (len(raw) > limit)


def test_utf8_cut_example(spark):
    assert column(spark, ["aaa日本"], lambda c: utf8_cut(c, 5)) == ["aaa"]


def walk_size(value):
    if value is None:
        return 4
    if isinstance(value, bool):
        return 5
    if isinstance(value, (int, float)):
        return 16
    if isinstance(value, str):
        return len(value.encode()) + 2
    if isinstance(value, list):
        return sum(map(walk_size, value)) + 2
    return sum(len(k.encode()) + 4 + walk_size(v) for k, v in value.items()) + 2


JSON = st.recursive(
    st.none()
    | st.booleans()
    | st.integers(-(10**9), 10**9)
    | st.floats(allow_nan=False, allow_infinity=False)
    | TEXTS
    | st.sampled_from(["\\", '"', "\\\\n", "tab\t", "\x01", "null 1 {", "é", "😀", "\\u0041"]),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(TEXTS, inner, max_size=4),
    max_leaves=12,
)


@SLOW
@given(st.lists(JSON, min_size=40, max_size=80))
def test_semantic_size(spark, values):
    for ascii_only in (True, False):
        texts = [json.dumps(v, ensure_ascii=ascii_only) for v in values]
        assert column(spark, texts, semantic_size) == [walk_size(v) for v in values]


def test_strict_json(spark):
    texts = ['{"a":1}', " [1] ", "1", '"x"', '{"a":1}}', "[1]]", "1,2", "", "{} {}", "null", "{"]
    parsed = column(spark, texts, lambda c: F.to_json(strict_value(parse_marked(c))))
    assert parsed == ['{"a":1}', "[1]", "1", '"x"', *[None] * 5, "null", None]


@pytest.mark.parametrize(
    ("topic_filter", "topic", "template", "expected"),
    [
        ("home/+/temp", "home/kitchen/temp", "temp.{+1}", "temp.kitchen"),
        ("home/+/temp", "home/kitchen/hum", "t", None),
        ("a/#", "a/b/c", "{#}", "b/c"),
        ("a/#", "a", "x{#}", "x"),
        ("#", "a/b", "{#}", "a/b"),
        ("+/+", "a/b", "{+2}-{+1}", "b-a"),
        ("a/+", "a/b/c", "t", None),
        ("a.b/+", "aXb/c", "t", None),
        ("a/+", "a/", "<{+1}>", "<>"),
        ("exact", "exact", "s", "s"),
    ],
)
def test_topics(spark, topic_filter, topic, template, expected):
    matches = column(spark, [topic], lambda c: topic_matches(c, topic_filter))[0]
    assert matches == (expected is not None)
    if matches:
        got = column(spark, [topic], lambda c: source_from_topic(c, topic_filter, template))
        assert got == [expected]


@pytest.mark.parametrize("template", ["{+2}", "{+0}", "{#}", "{x}", "{+1", "a{+9}"])
def test_bad_templates(spark, template):
    assert source_from_topic(F.lit("a/b"), "a/+", template) is None


CSV_LINES = {
    '"a""b",c': ['a"b', "c"],
    "a,b\r\nsecond": ["a", "b"],
    "": [""],
    ",": ["", ""],
    "a,": ["a", ""],
    ",b": ["", "b"],
    '"a,b",c': ["a,b", "c"],
    '"",x': ["", "x"],
    '"a"tail,b': ["atail", "b"],
    'mid"quote,b': ['mid"quote', "b"],
    '"open,b': ["open,b"],
    '"open,': ["open,"],
    '""""': ['"'],
    '"a""': ['a"'],
    '"""x""","y"': ['"x"', "y"],
    '"a"b"c,d': ['ab"c', "d"],
    "é,日本": ["é", "日本"],
    'x,"",': ["x", "", ""],
}


def test_csv(spark):
    assert column(spark, list(CSV_LINES), csv_fields) == list(CSV_LINES.values())


@SLOW
@given(st.lists(st.lists(st.text('ab", ', max_size=5), min_size=1, max_size=4), min_size=50))
def test_quoted_csv_round_trip(spark, rows):
    lines = [",".join('"' + f.replace('"', '""') + '"' for f in row) for row in rows]
    assert column(spark, lines, csv_fields) == rows


def test_decoders(spark):
    data = [b"\x00\xffA", b'{"b":1, "a":[ ]}', b"x"]
    raw = [json.loads(x) for x in column(spark, data, lambda c: decode_payload("raw", c), "binary")]
    assert [r["bytes_base64"] for r in raw] == ["AP9B", "eyJiIjoxLCAiYSI6WyBdfQ", "eA"]
    hexed = column(spark, data, lambda c: decode_payload("hex", c), "binary")
    assert json.loads(hexed[0]) == {"encoding": "hex", "hex": "00ff41"}
    parsed = column(spark, data, lambda c: decode_payload("json", c), "binary")
    assert parsed == [None, '{"a":[],"b":1}', None]
    assert column(spark, data, lambda c: decode_payload("csv", c), "binary")[0] is None


def test_string_at(spark):
    texts = ['{"a":{"b":["x"]}}', '{"a":{"b":[42]}}', '{"a":1}', "[]"]
    got = column(spark, texts, lambda c: string_at(F.try_parse_json(c), "$.a.b[0]"))
    assert got == ["x", None, None, None]
    with pytest.raises(ValueError, match="unsupported path"):
        string_at(F.lit("{}"), "$..a")


SCHEMA_CASES = [
    ({"type": "object", "required": ["x"]}, ['{"x":1}'], ["{}", "[]", "1"]),
    ({"properties": {"x": {"type": "integer"}}}, ['{"x":1}', "{}", '{"x":2.0}', "3"], ['{"x":1.5}']),
    ({"type": ["string", "null"]}, ['"a"', "null"], ["1", "true"]),
    ({"enum": [1, "a", None, {"k": [1]}]}, ["1", '"a"', "null", '{"k":[1]}'], ["2", '"b"', "{}"]),
    ({"minimum": 2, "exclusiveMaximum": 5}, ["2", "4.9", '"text"'], ["1", "5"]),
    ({"minLength": 2, "pattern": "^a"}, ['"ab"', "1"], ['"a"', '"bb"']),
    ({"items": {"type": "number"}, "maxItems": 2}, ["[]", "[1,2.5]", "{}"], ['["a"]', "[1,2,3]"]),
    (
        {"properties": {"a": {}}, "additionalProperties": False},
        ['{"a":1}', "{}"],
        ['{"b":1}', '{"a":1,"b":2}'],
    ),
    ({"anyOf": [{"type": "string"}, {"const": 3}]}, ['"x"', "3"], ["4"]),
    ({"not": {"type": "boolean"}}, ["1"], ["true"]),
    ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, ["1", "2"], ["0", "3"]),
    (False, [], ["1", "{}"]),
]


@pytest.mark.parametrize(("schema", "good", "bad"), SCHEMA_CASES)
def test_schemas(spark, schema, good, bad):
    got = column(spark, good + bad, lambda c: valid_json(c, json.dumps(schema)))
    assert got == [True] * len(good) + [False] * len(bad)


def test_unknown_schema_rules_are_refused():
    with pytest.raises(ValueError, match="unsupported schema"):
        valid_json(F.lit("1"), '{"multipleOf": 2}')


def embed_by_hand(text, dim):
    out = [0.0] * dim
    for token in text.split():
        raw = token.encode()
        for i, byte in enumerate(hashlib.sha256(raw).digest()):
            out[(i + len(raw)) % dim] += (byte - 127.5) / 127.5
    norm = sum(x * x for x in out) ** 0.5
    return [x / norm for x in out] if norm else out


@pytest.mark.parametrize("dim", [64, 48, 10])
def test_hash_embedding(spark, dim):
    texts = ["door opened", "  door\topened ", "", "Tür auf auf", "x" * 300, None]
    model = embedding.hash_embedder(dim)
    got = column(spark, texts, model.embed)
    for text, vector in zip(texts, got):
        assert vector == pytest.approx(embed_by_hand(text or "", dim), abs=1e-6)
    assert got[0] == got[1] == model.embed_text("door opened")


def test_embedding_groups(monkeypatch):
    texts = [f"word{i} again" for i in range(50)]
    whole = embedding._hash_vectors(texts, 64)
    monkeypatch.setattr(embedding, "_GROUP_CHARS", 30)
    assert (embedding._hash_vectors(texts, 64) == whole).all()


def test_vector_arithmetic(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    scaled = [r[0] for r in rows.select(embedding.l2_normalize(F.col("v"))).collect()]
    assert scaled[0] == pytest.approx([0.6, 0.8]) and scaled[1] == [0.0, 0.0]
    dots = [r[0] for r in rows.select(embedding.dot(F.col("v"), [1.0, 0.5])).collect()]
    assert dots == pytest.approx([5.0, 0.0])
