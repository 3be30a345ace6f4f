"""Streams give what the batch operators give, across restarts and replays."""

import json
import random

import pytest
from pyspark.sql import functions as F

from eventlens.functions.embedding import hash_embedder
from eventlens.model import EVENT, KIND, SOURCE, TokenScope
from eventlens.operators import admission, health, normalize, state
from eventlens.sources import events_log, vectors, versions
from eventlens.streaming import jobs


@pytest.fixture(scope="module")
def slices(make_events):
    """Three slices in arrival order, mostly of one source, with late events."""
    rng = random.Random(8)
    rows, ingest = [], 0
    for i in range(300):
        ingest += rng.choice([0, 3, 20])
        source = "hot" if i % 3 else f"s{rng.randrange(4)}"
        ts = ingest - rng.choice([0, 0, 50])
        rows.append((f"{i:04d}", source, rng.choice("ab"), ts, f'{{"i":{i}}}', ingest))
    return [rows[:100], rows[100:220], rows[220:]]


@pytest.fixture
def stream(spark, slices, make_events, tmp_path):
    """Run a job over the slices, with one restart per slice."""

    def run(attach):
        folder = str(tmp_path)
        for rows in slices:
            make_events(rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            source = spark.readStream.schema(EVENT).parquet(f"{folder}/in")
            attach(source, folder).awaitTermination()
        return folder, make_events([r for part in slices for r in part])

    return run


def same(a, b, columns):
    assert sorted(map(tuple, a.select(*columns).collect())) == sorted(
        map(tuple, b.select(*columns).collect())
    )


def test_latest(spark, stream):
    def attach(rows, folder):
        sink = jobs.changes_sink(f"{folder}/out")
        return jobs.start(jobs.latest_stream(rows), sink, f"{folder}/ck", "update")

    folder, rows = stream(attach)
    columns = ["source_id", "kind", "event_id"]
    same(jobs.read_changes(spark, f"{folder}/out"), state.latest_by_event_time(rows), columns)


def test_ring(spark, stream):
    def attach(rows, folder):
        sink = jobs.changes_sink(f"{folder}/out")
        return jobs.start(jobs.ring_stream(rows, 6, 40), sink, f"{folder}/ck", "update")

    folder, rows = stream(attach)
    same(jobs.read_changes(spark, f"{folder}/out"), state.hot_window(rows, 6, 40), ["event_id"])


def test_normalize(spark, stream):
    def attach(rows, folder):
        sink = jobs.normalize_sink(f"{folder}/log", f"{folder}/seq", rows_per_range=30)
        return jobs.start(rows, sink, f"{folder}/ck")

    folder, rows = stream(attach)
    log = events_log.read_log(spark, f"{folder}/log")
    same(log, normalize.normalize(rows, jobs.ARRIVAL), ["event_id", "source_id", "seq"])


def test_a_replayed_batch_changes_nothing(spark, slices, make_events, tmp_path):
    log, counters = str(tmp_path / "log"), str(tmp_path / "seq")
    sink = jobs.normalize_sink(log, counters)
    for batch_id in (0, 1, 1, 2, 2):
        sink(make_events(slices[batch_id]), batch_id)
    rows = make_events([r for part in slices for r in part])
    expected = normalize.normalize(rows, jobs.ARRIVAL)
    same(events_log.read_log(spark, log), expected, ["event_id", "source_id", "seq"])


def test_fan_out_and_commit_log(spark, stream):
    def attach(rows, folder):
        sinks = {
            "log": jobs.log_sink(f"{folder}/log"),
            "forward": jobs.forward_sink(f"{folder}/hub", "p"),
        }
        sinks = {n: jobs.logged(n, f"{folder}/commits", s) for n, s in sinks.items()}
        running = jobs.fan_out(lambda: rows, sinks, f"{folder}/ck", every=None)
        running["log"].awaitTermination()
        return running["forward"]

    folder, rows = stream(attach)
    assert events_log.read_log(spark, f"{folder}/log").count() == 300
    hub = spark.read.parquet(f"{folder}/hub")
    assert hub.where(F.col("source_id").startswith("p.")).count() == 300
    progress = health.sink_progress(jobs.read_commits(spark, f"{folder}/commits"))
    got = {r["sink"]: (r["batches"], r["rows"], r["errors"]) for r in progress.collect()}
    assert got == {"log": (3, 300, 0), "forward": (3, 300, 0)}


def test_failures_are_noted(spark, make_events, tmp_path):
    def broken(batch, batch_id):
        raise OSError("disk full")

    commits = str(tmp_path / "commits")
    rows = make_events([("a", "s", "k", 1)])
    with pytest.raises(OSError, match="disk full"):
        jobs.logged("log", commits, broken)(rows, 0)
    jobs.logged("log", commits, jobs.log_sink(str(tmp_path / "log")))(rows, 0)
    got = health.sink_progress(jobs.read_commits(spark, commits)).first()
    assert (got["batches"], got["rows"], got["errors"], got["last_error"]) == (1, 1, 1, "disk full")


def test_embedding(spark, stream):
    kinds = [tuple({"name": "a", "embed": True, "ord": 0}.get(f) for f in KIND.fieldNames())]
    kind_table = spark.createDataFrame(kinds, KIND)
    source_table = spark.createDataFrame([], SOURCE)

    def attach(rows, folder):
        sink = jobs.embed_sink(f"{folder}/vectors", source_table, kind_table)
        return jobs.start(rows, jobs.logged("embed", f"{folder}/commits", sink), f"{folder}/ck")

    folder, rows = stream(attach)
    stored = vectors.load_vectors(spark, f"{folder}/vectors", "hash-sha256-64", 64)
    same(stored, rows.where("kind = 'a'"), ["event_id", "source_id", "ts_ms_utc"])
    commits = jobs.read_commits(spark, f"{folder}/commits")
    assert commits.agg(F.sum("rows")).first()[0] == stored.count()


def test_near_duplicates(spark, make_events, tmp_path):
    rows = [("a", "s", "k", 1000), ("a", "s", "k", 2000), ("b", "s", "k", 3000)]
    make_events(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    jobs.start(jobs.dedupe_stream(stream), jobs.changes_sink(out), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_lost_counters_stop_the_stream(make_events, tmp_path):
    sink = jobs.normalize_sink(str(tmp_path / "log"), str(tmp_path / "counters"))
    rows = make_events([("a", "s", "k", 1)])
    sink(rows, 0)
    with pytest.raises(RuntimeError, match="counters before batch 2"):
        sink(rows, 2)


def test_last_arrival_wins_whatever_its_event_time(spark, make_events, tmp_path):
    sources = spark.createDataFrame([("s", True)], "source_id string, embed boolean")
    kinds = spark.createDataFrame([], "name string, embed boolean, ord int")
    model = hash_embedder()
    sink = jobs.embed_sink(str(tmp_path / "vectors"), sources, kinds, model)
    sink(make_events([("a", "s", "k", 9, '{"t":"early"}', 100), ("a", "s", "k", 5, '{"t":"late"}', 200)]), 0)
    stored = vectors.load_vectors(spark, str(tmp_path / "vectors"), model.model_id, model.dim).first()
    assert stored["ts_ms_utc"] == 5


def test_rates_go_on_after_restarts(spark, tmp_path):
    """Slices in time order, with several batches of one millisecond and a token without a rate."""
    rng = random.Random(3)
    tokens = [TokenScope("a", (), (), "2/s"), TokenScope("b", (), (), "30/m"), TokenScope("free")]
    rows, at = [], 1000
    for i in range(300):
        at += rng.choice([0, 0, 20, 400])
        rows.append((i, rng.choice(["a", "a", "b", "free", None]), at))
    schema = "batch_id long, token_name string, at_ms long"
    cuts = sorted({rows[100][2], rows[210][2]})
    parts = [[r for r in rows if sum(r[2] >= c for c in cuts) == n] for n in range(3)]
    for part in parts:
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        judged = jobs.rate_limit_stream(source, tokens)
        jobs.start(judged, jobs.changes_sink(f"{tmp_path}/out"), f"{tmp_path}/ck", "update").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    same(got, admission.rate_limit(spark.createDataFrame(rows, schema), tokens), ["batch_id", "token_name", "at_ms", "allowed"])


def test_a_busy_pair_sends_its_newest_rows_only(spark):
    """100 000 events of one pair in a batch: at most ring size times partitions reach the state."""
    number = F.col("id").cast("string")
    rows = spark.range(100_000, numPartitions=4).select(
        F.lpad(number, 8, "0").alias("event_id"), F.lit("s").alias("source_id"), F.lit("k").alias("kind"),
        (F.col("id") * 7919 % 100_000).alias("ingest_ts_ms_utc"), F.col("id").alias("ts_ms_utc"),
    )
    kept = jobs.newest_rows(rows, 6)
    assert kept.count() <= 6 * 4
    newest = [r["event_id"] for r in kept.orderBy(F.desc("ingest_ts_ms_utc")).limit(6).collect()]
    assert newest == [r["event_id"] for r in rows.orderBy(F.desc("ingest_ts_ms_utc")).limit(6).collect()]


def test_many_pairs_pass_in_bounded_memory(spark):
    rows = spark.range(5000, numPartitions=2).select(
        F.col("id").cast("string").alias("event_id"), (F.col("id") % 1000).cast("string").alias("source_id"),
        F.lit("k").alias("kind"), F.col("id").alias("ingest_ts_ms_utc"),
    )
    kept = jobs.newest_rows(rows, 2, held=300)
    assert {r["event_id"] for r in kept.collect()} >= {str(i) for i in range(3000, 5000) if i >= 4000 or i < 2500}


def test_counters_write_what_a_batch_brings(spark, make_events, tmp_path, monkeypatch):
    """A batch's counters are those of its own sources; buckets of many files are merged, a replay sees the old ones."""
    monkeypatch.setattr(jobs, "_MERGE_AT", 3)
    log, counters = str(tmp_path / "log"), str(tmp_path / "seq")
    sink = jobs.normalize_sink(log, counters)
    rows, batches = [], 8
    for n in range(batches):
        part = [(f"{n}-{s}-{i}", f"s{s}", "k", i, "{}", n * 100 + i) for s in (range(40) if n == 0 else sorted({1, n})) for i in range(2)]
        rows += part
        sink(make_events(part), n)
        sink(make_events(part), n)
        base = versions.snapshot(spark, counters)
        if n == 1:
            added = [f for f in base.files.values() if f.path not in first.files]
            assert len(added) == 1
        first = base if n == 0 else first
    slots = [f.slot for f in versions.snapshot(spark, counters).files.values()]
    assert max(map(slots.count, slots)) <= 4
    expected = normalize.normalize(make_events(rows), jobs.ARRIVAL)
    same(events_log.read_log(spark, log), expected, ["event_id", "source_id", "seq"])


def test_rings_of_many_pairs_need_no_call_per_pair(spark, stream):
    """State is a built-in aggregation, so pairs cost no round trips; rings are those of the batch form, an old event behind a young one included."""
    plans = []

    def attach(rows, folder):
        sink = jobs.changes_sink(f"{folder}/out")

        def noted(batch, batch_id):
            plans.append(batch._jdf.queryExecution().toString())
            sink(batch, batch_id)

        return jobs.start(jobs.ring_stream(rows, 4, 30, ["event_id"]), noted, f"{folder}/ck", "update")

    folder, rows = stream(attach)
    assert len(plans) == 3 and not any("TransformWithState" in plan for plan in plans)
    got = jobs.read_changes(spark, f"{folder}/out")
    assert got.columns[: len(rows.columns)] == rows.columns
    same(got, state.hot_window(rows, 4, 30, ["event_id"]), ["event_id", "source_id", "kind", "semantic"])


def test_a_batch_of_bodies_is_judged_once(spark, tmp_path, monkeypatch):
    """What is let in is read from stored verdicts, whatever reads it; a replayed batch gives the same rows."""
    rows = [(i, "t", 1000 + i, json.dumps({"source_id": f"s{i % 3}", "kind": "k", "ts_ms_utc": i, "semantic": {"x": "y" * i}})) for i in range(40)]
    bodies = spark.createDataFrame(rows, "batch_id long, token_name string, at_ms long, body string")
    added, appended = [], jobs.append_events

    def noted(events, path, arrival):
        added.append(events._jdf.queryExecution().optimizedPlan().toString())
        return appended(events, path, arrival)

    monkeypatch.setattr(jobs, "append_events", noted)
    folder = str(tmp_path)
    tokens = [TokenScope("t", ("*",), ("*",), "20/s")]
    sink = jobs.ingest_sink(f"{folder}/log", f"{folder}/state", f"{folder}/errors", tokens, hard_cap=30)
    for attempt in range(2):
        sink(bodies, 0)
        log = events_log.read_log(spark, f"{folder}/log")
        assert sorted(r["ts_ms_utc"] for r in log.collect()) == list(range(20)) and log.select("source_id", "seq").distinct().count() == 20
        errors = health.recent_errors(spark.read.parquet(f"{folder}/errors")).collect()
        # a body's size is 9 and its y's: 22 are small enough, of which the rate lets 20 in
        assert [sum(r["counters"].get(reason, 0) for r in errors) for reason in ("payload_too_large", "rate_limit")] == [18, 2]
    assert len(added) == 2 and not any("regexp_count" in plan or "min_by" in plan for plan in added)
