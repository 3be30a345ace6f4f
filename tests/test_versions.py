"""Versioned tables: one switch per change, nothing lost between writers, only touched files read."""

import os

import pytest
from pyspark.sql import functions as F

from eventlens.functions.scalars import generated_id, id_time_ms
from eventlens.model import RetentionPolicy
from eventlens.sources import events_log, vectors, versions

DAY = 86_400_000


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "a table")


def ulid(day, n):
    """A time-sortable id of a day, by plain arithmetic."""
    digits = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
    ms, text = day * DAY + n, ""
    for _ in range(10):
        ms, digit = divmod(ms, 32)
        text = digits[digit] + text
    return text + f"{n:016d}"


def stored(spark, path):
    return sorted(r["event_id"] for r in events_log.read_log(spark, path).collect())


def test_time_of_an_id(spark):
    rows = spark.createDataFrame([(ulid(19_800, 7),), ("short",), ("U" * 26,), (None,), ("8" + "0" * 25,)], "event_id string")
    assert [r[0] for r in rows.select(id_time_ms(F.col("event_id"))).collect()] == [19_800 * DAY + 7, None, None, None, None]
    made = spark.range(1).select(generated_id(F.lit(1_706_659_200_123), F.lit("x")).alias("event_id"))
    assert made.select(id_time_ms(F.col("event_id"))).first()[0] == 1_706_659_200_123


def test_every_append_is_one_version(spark, make_events, path):
    for n in range(3):
        added = events_log.append_events(make_events([(f"e{i}", "s", "k", i * DAY) for i in range(n, n + 2)]), path)
        assert added == (2 if n == 0 else 1)
    assert events_log.append_events(make_events([("e0", "s", "k", 9)]), path) == 0
    assert versions.snapshot(spark, path).version == 3
    assert stored(spark, path) == ["e0", "e1", "e2", "e3"]


def test_a_batch_reads_the_id_files_of_its_own_days(spark, make_events, path):
    for day in range(5):
        events_log.append_events(make_events([(ulid(day, n), "s", "k", day * DAY + n) for n in range(20)]), path)
    base = versions.snapshot(spark, path)
    batch = make_events([(ulid(3, 5), "s", "k", 0), (ulid(3, 50), "s", "k", 3 * DAY)])
    files = versions.id_files(spark, base, batch)
    assert files and {f.slot.split("/")[0] for f in files} == {"1970-01-04"}
    assert len(files) < len([f for f in base.of_ids() if f.slot.startswith("1970-01-04")])
    assert events_log.append_events(batch, path) == 1


def test_a_lookup_reads_the_days_of_its_ids(spark, make_events, path):
    rows = [(ulid(day, n), "s", "k", day * DAY + n) for day in range(6) for n in range(4)]
    events_log.append_events(make_events([*rows, ("odd", "s", "k", 2 * DAY)]), path)
    found = events_log.lookup(spark, path, [ulid(4, 1), "odd", "unknown"])
    assert sorted(r["event_id"] for r in found.collect()) == sorted([ulid(4, 1), "odd"])
    read = {f.split("/")[-2] for f in found.inputFiles()}
    assert read == {"day=1970-01-05", "day=1970-01-03"}
    assert events_log.lookup(spark, path, ["unknown"]).count() == 0


def test_a_plain_folder_is_taken_over(spark, make_events, path):
    rows = make_events([(f"e{i}", "s", "k", i * DAY) for i in range(3)])
    plain = rows.withColumn("day", F.to_date(F.timestamp_millis("ts_ms_utc"))).select(*events_log.STORED)
    plain.write.partitionBy("day").parquet(path)
    assert stored(spark, path) == ["e0", "e1", "e2"]
    events_log.append_events(make_events([("e1", "s", "k", 7), ("new", "s", "k", 8)]), path)
    assert stored(spark, path) == ["e0", "e1", "e2", "new"]


def test_a_failed_writer_leaves_the_table_as_it_was(spark, make_events, path, monkeypatch):
    events_log.append_events(make_events([("a", "s", "k", 1)]), path)

    def fails(*args):
        raise OSError("disk")

    monkeypatch.setattr(versions, "stage_ids", fails)
    with pytest.raises(OSError, match="disk"):
        events_log.append_events(make_events([("b", "s", "k", 2)]), path)
    monkeypatch.undo()
    assert stored(spark, path) == ["a"]
    events_log.append_events(make_events([("b", "s", "k", 2)]), path)
    assert stored(spark, path) == ["a", "b"]


def during(monkeypatch, name, act):
    """Let ``act`` run once, just before a writer's next call of ``versions.name``."""
    real, done = getattr(versions, name), []

    def first(*args, **kwargs):
        if not done:
            done.append(True)
            act()
        return real(*args, **kwargs)

    monkeypatch.setattr(versions, name, first)


def test_two_writers_of_the_same_id(spark, make_events, path, monkeypatch):
    """The one that commits first wins, the other looks again and adds only what is new."""
    events_log.append_events(make_events([("a", "s", "k", 1)]), path)
    during(monkeypatch, "commit", lambda: events_log.append_events(make_events([("b", "s", "k", 2, '"first"')]), path))
    assert events_log.append_events(make_events([("b", "s", "k", 3, '"second"'), ("c", "s", "k", 4)]), path) == 1
    log = {r["event_id"]: r["semantic"] for r in events_log.read_log(spark, path).collect()}
    assert log == {"a": "{}", "b": '"first"', "c": "{}"}


def test_an_append_between_classification_and_switch_survives(spark, make_events, path, monkeypatch):
    events_log.append_events(make_events([(f"e{i}", "s", "k", i) for i in range(6)]), path)
    during(monkeypatch, "commit", lambda: events_log.append_events(make_events([("late", "s", "k", 3)]), path))
    events_log.sweep_log(spark, path, [RetentionPolicy(max_count=2)], DAY)
    assert stored(spark, path) == ["e4", "e5", "late"]


def test_two_sweeps_at_once(spark, make_events, path, monkeypatch):
    events_log.append_events(make_events([(f"e{i}", "s", "k", i) for i in range(6)]), path)
    during(monkeypatch, "commit", lambda: events_log.sweep_log(spark, path, [RetentionPolicy(max_count=4)], DAY))
    counts = events_log.sweep_log(spark, path, [RetentionPolicy(max_count=3)], DAY).collect()
    assert stored(spark, path) == ["e3", "e4", "e5"]
    assert [r["dropped"] for r in counts] == [1]


def test_a_swept_id_may_come_again(spark, make_events, path):
    events_log.append_events(make_events([("a", "s", "k", 1), ("b", "s", "k", 2)]), path)
    events_log.sweep_log(spark, path, [RetentionPolicy(max_count=1)], DAY)
    assert events_log.append_events(make_events([("a", "s", "k", 5), ("b", "s", "k", 2)]), path) == 1
    assert stored(spark, path) == ["a", "b"]


def test_expired_days_are_not_read(spark, make_events, path, monkeypatch):
    events_log.append_events(make_events([(f"e{d}{i}", f"s{i}", "k", d * DAY + i) for d in range(5) for i in range(3)]), path)
    read, real = [], versions.read_files

    def noted(spark, path, files, schema):
        read.extend(f.first_day for f in files)
        return real(spark, path, files, schema)

    monkeypatch.setattr(versions, "read_files", noted)
    policies = [RetentionPolicy(max_age_ms=2 * DAY), RetentionPolicy(match_source_id="s1", max_age_ms=DAY)]
    counts = events_log.sweep_log(spark, path, policies, 5 * DAY).collect()
    assert set(read) - {""} <= {"1970-01-04", "1970-01-05"}  # new files have no day yet
    assert {str(r["day"]): (r["events"], r["dropped"]) for r in counts} == {
        "1970-01-01": (3, 3), "1970-01-02": (3, 3), "1970-01-03": (3, 3), "1970-01-04": (3, 1)
    }
    monkeypatch.undo()
    assert stored(spark, path) == ["e30", "e32", "e40", "e41", "e42"]
    assert events_log.append_events(make_events([("e00", "s", "k", 9 * DAY)]), path) == 1


def test_whole_lists_every_so_many_versions(spark, make_events, path, monkeypatch):
    monkeypatch.setattr(versions, "WHOLE_EVERY", 3)
    for n in range(8):
        events_log.append_events(make_events([(f"e{n}", "s", "k", n)]), path)
        if n % 3 == 2:
            events_log.sweep_log(spark, path, [RetentionPolicy(max_count=2)], DAY)
    assert stored(spark, path) == ["e4", "e5", "e6", "e7"]
    base = versions.snapshot(spark, path)
    assert base.version > 8
    there = {f"{p}/{f}" for p, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "_staged" not in p}
    assert {f"{path}/{f}" for f in base.files} == there


def test_vectors_know_their_model_without_being_read(spark, path, monkeypatch):
    rows = [("a", "s", "k", 1, False, "m", [1.0, 0.0], 1), ("b", "s", "k", DAY, False, "m", [1.0, 0.0], 1)]
    schema = "event_id string, source_id string, kind string, ts_ms_utc long, truncated boolean, model_id string, vector array<float>, n int"
    vectors.append_vectors(spark.createDataFrame(rows, schema), path, "m", 2, ["n"])
    monkeypatch.setattr(vectors, "check_vectors", None)
    assert vectors.load_vectors(spark, path, "m", 2).count() == 2
    with pytest.raises(vectors.IndexMismatch):
        vectors.load_vectors(spark, path, "m", 3)


def test_only_files_with_a_replaced_vector_are_written_anew(spark, path):
    schema = "event_id string, source_id string, kind string, ts_ms_utc long, truncated boolean, model_id string, vector array<float>, n int"

    def write(rows):
        full = [(i, "s", "k", t, False, "m", v, 1) for i, t, v in rows]
        vectors.append_vectors(spark.createDataFrame(full, schema), path, "m", 1, ["n"])

    write([("a", 1, [1.0]), ("x", DAY, [1.0])])
    write([("b", 2, [1.0])])
    before = {f.path for f in versions.snapshot(spark, path).of_rows()}
    write([("b", 3, [2.0])])
    after = {f.path for f in versions.snapshot(spark, path).of_rows()}
    assert len(before - after) == 1 and len(after - before) == 1
    got = {r["event_id"]: r["vector"] for r in vectors.load_vectors(spark, path, "m", 1).collect()}
    assert got == {"a": [1.0], "b": [2.0], "x": [1.0]}
