"""Parsing, admission, rate limits, normalisation and routing."""

import json
import random

import pytest

from eventlens.functions.scalars import ID_ALPHABET
from eventlens.model import KIND, Subscription, TokenScope
from eventlens.operators import admission, health, normalize, routing
from eventlens.sources.payloads import parse_payloads, read_payloads

EVENT = {"source_id": "s", "kind": "k", "ts_ms_utc": 5, "semantic": {"x": 1}}
PAYLOADS = {
    "wrapped": ({"events": [EVENT, EVENT]}, 2),
    "bare": ([EVENT], 1),
    "single": (EVENT, 1),
    "extra wrapper field": ({"events": [EVENT], "note": 1}, 1),
    "full": (
        {**EVENT, "event_id": "01hzzzzzzzzzzzzzzzzzzzzzzz", "trace_id": None, "producer_id": "p",
         "links": [{"rel": "r", "uri": "u", "bytes": 3, "other": 1}]}, 1
    ),
    "null semantic": ({**EVENT, "semantic": None}, 1),
    "unknown field": ({**EVENT, "seq": 1}, "invalid event"),
    "one bad event": ({"events": [EVENT, {**EVENT, "ts_ms_utc": "5"}]}, "invalid event"),
    "fractional time": ({**EVENT, "ts_ms_utc": 5.5}, "invalid event"),
    "missing kind": ({k: v for k, v in EVENT.items() if k != "kind"}, "invalid event"),
    "missing semantic": ({k: v for k, v in EVENT.items() if k != "semantic"}, "invalid event"),
    "number as source": ({**EVENT, "source_id": 3}, "invalid event"),
    "bad id": ({**EVENT, "event_id": "nope"}, "invalid event"),
    "bad link": ({**EVENT, "links": [{"rel": "r"}]}, "invalid event"),
    "empty list": ([], "no events in payload"),
    "empty wrapper": ({"events": []}, "no events in payload"),
    "scalar": (3, "not an event or a list of events"),
}


def test_payload_shapes(spark):
    rows = [(name, json.dumps(body)) for name, (body, _) in PAYLOADS.items()]
    rows += [("broken", "{"), ("trailing", json.dumps(EVENT) + "}")]
    parsed = parse_payloads(spark.createDataFrame(rows, "name string, body string"))
    got = {r["name"]: r["count"] for r in parsed.events.groupBy("name").count().collect()}
    got |= {r["name"]: r["reason"] for r in parsed.rejected.collect()}
    expected = {name: outcome for name, (_, outcome) in PAYLOADS.items()}
    assert got == {**expected, "broken": "invalid JSON", "trailing": "invalid JSON"}
    full = parsed.events.where("name = 'full'").first()
    assert full["event_id"] == "01HZZZZZZZZZZZZZZZZZZZZZZZ"
    assert full["links"][0].asDict() == {
        "rel": "r", "uri": "u", "mime": None, "bytes": 3, "sha256": None
    }
    assert full["semantic"] == '{"x":1}'


def test_payload_files(spark, tmp_path):
    (tmp_path / "in.txt").write_text(json.dumps([EVENT]) + "\n" + json.dumps(EVENT) + "\n")
    rows = read_payloads(spark, "text", str(tmp_path))
    assert parse_payloads(rows.select("body")).events.count() == 2


TOKENS = [
    TokenScope("cam", ("cam.front_door.*",), ("*",)),
    TokenScope("none"),
    TokenScope("all", ("*",), ("*",)),
]


def batches(spark, rows):
    """(batch, ord, token, source, text length) rows as admission input."""
    return spark.createDataFrame(
        [
            (b, o, t, 10, f"{b}-{o}", s, "k", 1, json.dumps({"t": "x" * n}))
            for b, o, t, s, n in rows
        ],
        "batch_id long, ord long, token_name string, at_ms long, event_id string, "
        "source_id string, kind string, ts_ms_utc long, semantic string",
    )


def test_admission(spark, ids):
    rows = batches(
        spark,
        [
            (1, 0, "cam", "cam.front_door.zone1", 1),
            (1, 1, "cam", "cam.front_door.zone2", 500),
            (2, 0, "cam", "cam.front_door.zone1", 1),
            (2, 1, "cam", "cam.back_yard", 1),
            (3, 0, "all", "a", 500),
            (3, 1, "all", "b", 2000),
            (3, 2, "all", "c", 500),
            (4, 0, "none", "a", 1),
            (5, 0, "stranger", "a", 1),
            (6, 1, "cam", "other", 1),
            (6, 0, "cam", "cam.front_door.z", 2000),
        ],
    )
    result = admission.admit_batches(rows, TOKENS, hard_cap=1000, soft_cap=100)
    assert ids(result.accepted) == ["1-0", "1-1"]
    audit = {r["batch_id"]: r for r in result.audit.collect()}
    assert {b: r["reason"] for b, r in audit.items()} == {
        1: None,
        2: "unauthorized",
        3: "payload_too_large",
        4: "unauthorized",
        5: "unauthorized",
        6: "payload_too_large",
    }
    assert {b: r["soft_oversize"] for b, r in audit.items() if r["soft_oversize"]} == {1: 1, 3: 1}
    assert audit[3]["source_id"] == "b" and audit[6]["source_id"] == "cam.front_door.z"
    assert result.rejected.count() == 9
    errors = health.recent_errors(health.admission_errors(result.audit)).collect()
    assert {r["source_id"]: r["counters"] for r in errors}["a"] == {"unauthorized": 2}


def test_cap_comparison_is_strict(spark):
    size = 2 + 1 + 4 + 10 + 2
    rows = batches(spark, [(1, 0, "all", "a", 10)])
    at = admission.batch_verdicts(rows, TOKENS, hard_cap=size, soft_cap=size).first()
    assert (at["reason"], at["soft_oversize"]) == (None, 0)
    over = admission.batch_verdicts(rows, TOKENS, hard_cap=size - 1, soft_cap=0).first()
    assert over["reason"] == "payload_too_large"


def test_size_audit(spark):
    rows = batches(spark, [(1, 0, "all", "a", 10), (1, 1, "all", "a", 100)])
    got = admission.size_audit(rows, hard_cap=100, soft_cap=50).first()
    assert (got["events"], got["estimated_bytes"], got["over_soft"], got["over_hard"]) == (
        2, 19 + 109, 1, 1,
    )
    assert got["json_bytes"] == 19 + 109


@pytest.mark.parametrize("text", ["0/s", "5", "5/d", "x/s", "-1/s", ""])
def test_bad_rates(text):
    with pytest.raises(ValueError, match="invalid rate"):
        admission.parse_rate(text)


def gcra_by_hand(times, burst, step):
    due, out = 0, []
    for t in times:
        now = t * 1_000_000
        late = max(due, now) + step
        ok = late - now <= burst * step
        out.append(ok)
        due = late if ok else due
    return out


@pytest.mark.parametrize("rate", ["3/s", "7/m", "1/s"])
def test_rate_limit_equals_one_by_one(spark, rate):
    rng = random.Random(rate)
    rows = []
    for token in ("a", "b", "free", None):
        now = 0
        for i in range(200):
            now += rng.choice([0, 0, 0, 40, 900])
            rows.append((f"{token}-{i:04d}", token, now))
    tokens = [TokenScope("a", rate_limit=rate), TokenScope("b", rate_limit="2/m"), TokenScope("free")]
    df = spark.createDataFrame(rows, "batch_id string, token_name string, at_ms long")
    got = {
        r["batch_id"]: r["allowed"]
        for r in admission.rate_limit(df, tokens, rows_per_range=60).collect()
    }
    assert len(got) == len(rows)
    for token, text in (("a", rate), ("b", "2/m")):
        mine = [(b, t) for b, name, t in rows if name == token]
        expected = gcra_by_hand([t for _, t in mine], *admission.parse_rate(text))
        assert [got[b] for b, _ in mine] == expected
    assert all(ok for b, ok in got.items() if b.startswith(("free", "None")))


def test_rate_limited_batches_charge_every_event(spark):
    rows = batches(spark, [(b, o, "slow", f"s{o}", 1) for b in (1, 2) for o in (0, 1)])
    tokens = [TokenScope("slow", ("*",), ("*",), "1/h")]
    result = admission.admit_batches(rows, tokens, limit_rates=True)
    assert {r["batch_id"] for r in result.accepted.collect()} == {1}
    assert {r["reason"] for r in result.rejected.collect()} == {"rate_limit"}
    log = health.event_errors(result.rejected, "rate_limit", "at_ms")
    assert {r["source_id"] for r in health.recent_errors(log).collect()} == {"s0", "s1"}
    assert health.admission_errors(result.audit).count() == 0


def test_normalize(spark):
    rows = spark.createDataFrame(
        [("a", "k", 5, "{}", None, 2), ("a", "k", 4, "{}", "MINE", 1), ("b", "k", 1, "{}", None, 3)],
        "source_id string, kind string, ts_ms_utc long, semantic string, event_id string, at int",
    )
    got = {
        (r["source_id"], r["seq"]): r for r in normalize.normalize(rows, ["at"], 1000).collect()
    }
    assert set(got) == {("a", 1), ("a", 2), ("b", 1)}
    assert got["a", 1]["event_id"] == "MINE"
    made = got["a", 2]
    assert made["ingest_ts_ms_utc"] == 1000 and made["schema_invalid"] is None
    assert len(made["event_id"]) == 26 and set(made["event_id"]) <= set(ID_ALPHABET)
    assert made["trace_id"] != made["event_id"]
    again = normalize.normalize(rows, ["at"], 1000).where("source_id = 'b'").first()
    assert again["event_id"] == got["b", 1]["event_id"]


def needs(field):
    return {"type": "object", "required": [field]}


@pytest.mark.parametrize(
    ("source", "kind", "semantic", "expected"),
    [
        ("s", "door", '{"two":1}', None),
        ("s", "door", '{"one":1}', True),
        ("s", "door@v1", '{"one":1}', None),
        ("s", "door@v1", '{"two":1}', True),
        ("s", "door@v9", "{}", None),
        ("s", "light", "{}", None),
        ("s", "light@v1", "{}", True),
        ("s", "unknown", "{}", None),
        ("s", "@v1", "{}", None),
        ("special", "door", '{"two":1}', True),
        ("special", "anything", '{"own":1}', None),
    ],
)
def test_schema_choice(make_events, source, kind, semantic, expected):
    book = normalize.SchemaBook(
        {"special": needs("own")},
        [
            normalize.KindSchema("door", "v1", needs("one")),
            normalize.KindSchema("door", "v2", needs("two")),
            normalize.KindSchema("door", "v10", needs("ten")),
            normalize.KindSchema("light", "v1", needs("x")),
            normalize.KindSchema("light", "v2"),
        ],
    )
    rows = make_events([("e", source, kind, 1, semantic)])
    assert normalize.validate_semantic(rows, book).first()["schema_invalid"] is expected


def test_latest_versions(spark):
    rows = [("d", "v2"), ("d", "v10"), ("e", None)]
    values = [(n, v, None, None, None, None, None, None, i) for i, (n, v) in enumerate(rows)]
    got = normalize.latest_versions(spark.createDataFrame(values, KIND)).collect()
    assert {r["name"]: r["version"] for r in got} == {"d": "v2", "e": "v1"}


BLOB = '{"bytes_base64":"/w","encoding":"raw"}'
SUBS = [
    Subscription("a/+", "first.{+1}", kind="k"),
    Subscription("+/+", "second.{+2}", kind_field="$.type"),
    Subscription("raw/#", "raw/{#}", kind="blob", payload="raw"),
    Subscription("broken/x/+", "{+7}", kind="k"),
    Subscription("csv/x/+", "csv", kind_field="$.encoding", payload="csv"),
    Subscription("none/x/y", "n"),
]


@pytest.mark.parametrize(
    ("topic", "payload", "expected"),
    [
        ("a/b", b"{}", ("first.b", "k", "{}", "ok")),
        ("c/d", b'{"type":"t"}', ("second.d", "t", '{"type":"t"}', "ok")),
        ("c/d", b'{"type":42}', ("second.d", None, '{"type":42}', "decode_failed")),
        ("a/b", b"{", ("first.b", "k", None, "decode_failed")),
        ("raw/x/y", b"\xff", ("raw/x/y", "blob", BLOB, "ok")),
        ("broken/x/y", b"{}", (None, "k", "{}", "decode_failed")),
        ("csv/x/y", b"a,b", ("csv", "csv", '{"encoding":"csv","fields":["a","b"]}', "ok")),
        ("none/x/y", b"{}", ("n", None, "{}", "decode_failed")),
        ("nobody/listens/to/this", b"{}", (None, None, None, "unmatched")),
    ],
)
def test_routing(spark, topic, payload, expected):
    rows = spark.createDataFrame(
        [("b1", topic, bytearray(payload), 7)],
        "broker_id string, topic string, payload binary, ts_ms long",
    )
    got = routing.route_outcomes(rows, SUBS).first()
    assert (got["source_id"], got["kind"], got["semantic"], got["outcome"]) == expected
    routed = routing.route_messages(rows, SUBS)
    assert (routed.events.count(), routed.failed.count()) == (
        (1, 0) if expected[3] == "ok" else (0, 1)
    )


def test_counters(spark):
    accepted = spark.createDataFrame(
        [("t", True), ("t", None), (None, None)], "token_name string, schema_invalid boolean"
    )
    audit = spark.createDataFrame(
        [("t", None, 2), ("t", "rate_limit", 0), ("u", "unauthorized", 1)],
        "token_name string, reason string, soft_oversize long",
    )
    routed = spark.createDataFrame([("b", "ok"), ("b", "ok")], "broker_id string, outcome string")
    got = {
        (r["counter"], r["label"]): r["n"]
        for r in health.ingest_counters(accepted, audit, routed).collect()
    }
    assert got == {
        ("accepted", None): 3,
        ("accepted_by_token", "t"): 2,
        ("schema_invalid", None): 1,
        ("shed_by_reason", "rate_limit"): 1,
        ("shed_by_reason", "unauthorized"): 1,
        ("shed_by_token", "t"): 1,
        ("shed_by_token", "u"): 1,
        ("oversized_soft", None): 3,
        ("routed_ok", "b"): 2,
    }
    nothing = health.ingest_counters(accepted.where("false"), audit.where("false"))
    assert {r["counter"]: r["n"] for r in nothing.collect()} == {
        "accepted": 0,
        "schema_invalid": 0,
        "oversized_soft": 0,
    }


def test_read_formats(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(json.dumps(EVENT),)], "payload string").write.parquet(path)
    rows = read_payloads(spark, "parquet", path, body="payload")
    assert parse_payloads(rows.select("body")).events.first()["source_id"] == "s"
    streamed = read_payloads(
        spark, "parquet", path, streaming=True, body="payload", schema="payload string"
    )
    assert streamed.isStreaming and "body" in streamed.columns
