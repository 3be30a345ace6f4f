"""Stored log and vectors, peers and progress."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.model import VECTOR, Peer, RetentionPolicy
from eventlens.operators import federation, health
from eventlens.sources import events_log, vectors

DAY = 86_400_000


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def days(path):
    return sorted(f for f in os.listdir(path) if f.startswith("day="))


def test_first_write_wins(spark, make_events, path):
    rows = make_events(
        [("a", "s", "k", 1, '"late"', 9), ("a", "s", "k", 2, '"first"', 3), ("b", "s", "k", DAY)]
    )
    events_log.append_events(rows, path)
    events_log.append_events(make_events([("a", "s", "k", 5), ("c", "s", "k", 7)]), path)
    events_log.append_events(rows, path)
    log = events_log.read_log(spark, path)
    assert {r["event_id"]: r["semantic"] for r in log.collect()} == {
        "a": '"first"', "b": "{}", "c": "{}"
    }
    assert days(path) == ["day=1970-01-01", "day=1970-01-02"]
    assert events_log.count_events(log).first()["n"] == 3


def test_missing_ingest_time_becomes_event_time(spark, make_events, path):
    rows = make_events([("a", "s", "k", 7)]).withColumn(
        "ingest_ts_ms_utc", F.lit(None).cast("long")
    )
    events_log.append_events(rows, path)
    assert events_log.read_log(spark, path).first()["ingest_ts_ms_utc"] == 7


def test_reading_an_absent_log(spark, path):
    assert events_log.read_log(spark, path).count() == 0


def test_lookups(spark, make_events, ids):
    log = make_events([("a", "s", "k", 1), ("b", "s", "j", 1), ("c", "r", "k", 1)])
    assert ids(events_log.get_by_id(log, ["a", "c", "zz"])) == ["a", "c"]
    wanted = spark.createDataFrame([("b",), ("b",)], "event_id string")
    assert ids(events_log.get_by_id(log, wanted)) == ["b"]
    assert events_log.count_pair(log, "s", "k").first()["n"] == 1
    assert [tuple(r) for r in events_log.distinct_pairs(log).collect()] == [
        ("r", "k"), ("s", "j"), ("s", "k")
    ]


def test_sweeping_the_log(spark, make_events, path):
    rows = [(f"{d}{i}", "s", "k", d * DAY + i) for d in range(4) for i in range(3)]
    events_log.append_events(make_events(rows + [("keep", "other", "k", 0)]), path)
    untouched = os.listdir(f"{path}/day=1970-01-04")
    policies = [RetentionPolicy(match_source_id="s", max_age_ms=3 * DAY - 1, max_count=5)]
    counts = events_log.sweep_log(spark, path, policies, 4 * DAY)
    assert {str(r["day"]): r["dropped"] for r in counts.collect()} == {
        "1970-01-01": 3, "1970-01-02": 3, "1970-01-03": 1
    }
    left = sorted(r["event_id"] for r in events_log.read_log(spark, path).collect())
    assert left == ["21", "22", "30", "31", "32", "keep"]
    assert days(path) == ["day=1970-01-01", "day=1970-01-03", "day=1970-01-04"]
    assert os.listdir(f"{path}/day=1970-01-04") == untouched
    assert events_log.sweep_log(spark, path, policies, 4 * DAY).count() == 0


def vector_rows(spark, rows, model="m"):
    full = [(i, "s", "k", t, False, model, v, n) for i, t, v, n in rows]
    order = T.StructField("n", T.IntegerType())
    return spark.createDataFrame(full, T.StructType([*VECTOR.fields, order]))


def stored_vectors(spark, path):
    rows = vectors.load_vectors(spark, path, "m", 2).collect()
    return {r["event_id"]: (r["ts_ms_utc"], r["vector"]) for r in rows}


def test_last_vector_wins(spark, path):
    one = vector_rows(spark, [("a", 1, [1.0, 0.0], 1), ("a", 1, [2.0, 0.0], 2), ("b", DAY, [3.0, 0.0], 1)])
    vectors.append_vectors(one, path, "m", 2, ["n"])
    assert stored_vectors(spark, path) == {"a": (1, [2.0, 0.0]), "b": (DAY, [3.0, 0.0])}
    kept_files = os.listdir(f"{path}/day=1970-01-02")
    two = vector_rows(spark, [("a", 2, [5.0, 0.0], 1), ("c", 3, [6.0, 0.0], 1)])
    vectors.append_vectors(two, path, "m", 2, ["n"])
    assert stored_vectors(spark, path)["a"] == (2, [5.0, 0.0])
    assert os.listdir(f"{path}/day=1970-01-02") == kept_files
    moved = vector_rows(spark, [("b", 4, [7.0, 0.0], 1)])
    vectors.append_vectors(moved, path, "m", 2, ["n"])
    assert stored_vectors(spark, path)["b"] == (4, [7.0, 0.0])
    assert days(path) == ["day=1970-01-01"]
    assert len(stored_vectors(spark, path)) == 3


def test_models_do_not_mix(spark, path):
    rows = vector_rows(spark, [("a", 1, [1.0, 0.0], 1)])
    with pytest.raises(vectors.IndexMismatch, match="other with 2"):
        vectors.append_vectors(vector_rows(spark, [("a", 1, [1.0, 0.0], 1)], "other"), path, "m", 2, ["n"])
    with pytest.raises(vectors.IndexMismatch):
        vectors.append_vectors(rows, path, "m", 3, ["n"])
    vectors.append_vectors(rows, path, "m", 2, ["n"])
    with pytest.raises(vectors.IndexMismatch):
        vectors.load_vectors(spark, path, "m", 64)


def test_sweeping_vectors(spark, path):
    rows = vector_rows(spark, [("a", 10, [1.0, 0.0], 1), ("b", 200, [1.0, 0.0], 1),
                               ("c", 3 * DAY, [1.0, 0.0], 1)])
    vectors.append_vectors(rows, path, "m", 2, ["n"])
    policy = [RetentionPolicy(vector_max_age_ms=100)]
    assert vectors.sweep_vectors(spark, path, policy, 300) == 1
    assert sorted(stored_vectors(spark, path)) == ["b", "c"]
    assert vectors.sweep_vectors(spark, path, policy, 2 * DAY) == 1
    assert days(path) == ["day=1970-01-04"]
    assert vectors.sweep_vectors(spark, path, policy, 300) == 0


def test_federation(spark, make_events, tmp_path):
    columns = ["source_id", "kind", "event_id"]
    local = make_events([("l", "cam", "k", 1)]).select(*columns)
    for name in ("p1", "p2"):
        remote = make_events([(name, f"{name}.cam", "k", 1), (name, "hidden", "k", 1)])
        remote.select(*columns, F.lit("upstream").alias("peer_id")).write.parquet(
            str(tmp_path / name)
        )
    peers = [Peer(p, str(tmp_path / p)) for p in ("p1", "p2", "gone")]
    merged = federation.federate(local, peers, ["*cam"])
    assert sorted((r["event_id"], r["peer_id"]) for r in merged.rows.collect()) == [
        ("l", None), ("p1", "p1"), ("p2", "p2")
    ]
    status = {r["peer_id"]: r["status"] for r in merged.status.collect()}
    assert status == {"p1": "ok", "p2": "ok", "gone": "error"}
    assert federation.federate(local, []).status.count() == 0


def test_slow_peers_are_not_waited_for(spark, make_events, tmp_path):
    """One answers, one is not there, one takes too long and its job is cancelled."""
    import time

    columns = ["source_id", "kind", "event_id"]
    make_events([("p", "cam", "k", 1), ("q", "hidden", "k", 1)]).select(*columns).write.parquet(str(tmp_path / "quick"))

    def reader(session, peer):
        rows = federation.open_peer(session, peer)
        if peer.peer_id == "slow":
            nap = F.udf(lambda s: time.sleep(60) or s, "string")
            rows = rows.withColumn("source_id", nap("source_id"))
        return rows

    local = make_events([("l", "cam", "k", 1)]).select(*columns)
    peers = [Peer("slow", str(tmp_path / "quick"), wait_ms=3000), Peer("quick", str(tmp_path / "quick")), Peer("gone", str(tmp_path / "gone"))]
    begun = time.monotonic()
    merged = federation.federate_within(local, peers, 50_000, ["*cam"], reader=reader)
    assert time.monotonic() - begun < 45
    assert {r["peer_id"]: r["status"] for r in merged.status.collect()} == {"slow": "timeout", "quick": "ok", "gone": "error"}
    assert sorted((r["event_id"], r["peer_id"] or "") for r in merged.rows.collect()) == [("l", ""), ("p", "quick")]


def test_forwarding(make_events):
    rows = make_events([("e", "temp.fridge", "k", 5)]).withColumn("trace_id", F.lit("t"))
    sent = federation.forward_events(rows, "kitchen").first().asDict()
    assert sent == {
        "event_id": "e", "source_id": "kitchen.temp.fridge", "kind": "k", "ts_ms_utc": 5,
        "semantic": "{}", "trace_id": "t", "producer_id": None,
    }


def test_progress(spark):
    commits = spark.createDataFrame(
        [("log", 0, 5, 0, 0, None, 1), ("log", 1, 7, 2, 1, None, 2), ("log", 2, 9, 0, 0, "disk", 3)],
        "sink string, batch_id long, rows long, truncated long, dropped long, error string, "
        "ts_ms long",
    )
    got = health.sink_progress(commits).first().asDict()
    assert got == {"sink": "log", "batches": 2, "rows": 12, "truncated": 2, "dropped": 1,
                   "errors": 1, "last_error": "disk"}
