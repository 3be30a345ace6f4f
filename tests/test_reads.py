"""Window scans, current state and descriptors."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from eventlens.model import KIND, SOURCE, Anchor, RetentionPolicy, WindowFilter
from eventlens.operators import descriptors, state, window
from eventlens.operators.health import recent_errors

# --- window -------------------------------------------------------------------


@pytest.fixture(scope="module")
def ten(make_events):
    return make_events([(f"e{i}", "s", "k", i * 10) for i in range(10)])


def test_half_open_range(ten):
    rows = window.window_scan(ten, WindowFilter(20, 60)).collect()
    assert [r["ts_ms_utc"] for r in rows] == [20, 30, 40, 50]


@pytest.mark.parametrize("end", [20, 10])
def test_empty_range_is_an_error(ten, end):
    with pytest.raises(ValueError, match="empty time range"):
        window.window_scan(ten, WindowFilter(20, end))


def test_globs(make_events, ids):
    rows = make_events([(s, s, "k", 1) for s in ("cam.front", "cam.back", "therm.kitchen")])
    flt = WindowFilter(0, 9, ("cam.*",))
    assert ids(window.window_scan(rows, flt)) == ["cam.back", "cam.front"]


def test_keyset_resume(ten):
    flt = WindowFilter(0, 100, limit=3)
    rows = window.window_scan(ten, flt, Anchor(20, "e2")).collect()
    assert [r["event_id"] for r in rows] == ["e3", "e4", "e5"]


def test_resume_inside_equal_times(make_events):
    rows = make_events([(f"e{i}", "s", "k", 5) for i in range(6)])
    pages = list(window.iter_pages(rows, WindowFilter(0, 9, limit=4)))
    assert [[r["event_id"] for r in p.rows] for p in pages] == [
        ["e0", "e1", "e2", "e3"],
        ["e4", "e5"],
    ]


def test_exact_last_page_is_followed_by_an_empty_one(ten):
    pages = list(window.iter_pages(ten, WindowFilter(0, 100, limit=5)))
    assert [len(p.rows) for p in pages] == [5, 5, 0]
    assert pages[-1].next_token is None


def test_tokens(ten):
    flt = WindowFilter(0, 100, ("b*", "s"), None, 3)
    token = window.get_page(ten, flt).next_token
    same = WindowFilter(0, 100, ("s", "b*"), (), 3)
    assert window.read_token(token, same) == Anchor(20, "e2")
    for other in (
        WindowFilter(0, 90, ("b*", "s"), None, 3),
        WindowFilter(0, 100, ("s",), None, 3),
        WindowFilter(0, 100, ("b*", "s"), None, 4),
    ):
        with pytest.raises(window.CursorMismatch, match="cursor_filter_mismatch"):
            window.get_page(ten, other, token)
    for bad in ("", "!!", "abcd", "ä", token[:-5]):
        with pytest.raises(window.CursorMalformed):
            window.read_token(bad, flt)


def test_scans_have_no_cap_of_their_own(spark, make_events):
    many = spark.range(10_050).selectExpr(
        "lpad(id, 8, '0') AS event_id", "'s' AS source_id", "'k' AS kind", "id AS ts_ms_utc"
    )
    assert window.window_scan(many, WindowFilter(0, 20_000)).count() == 10_050
    assert window.window_scan(many, WindowFilter(0, 20_000, limit=10_020)).count() == 10_020
    assert len(window.get_page(many, WindowFilter(0, 20_000)).rows) == 10_000


def test_page_size_is_clamped():
    assert WindowFilter(0, 1).page_size == 10_000
    assert WindowFilter(0, 1, limit=10**6).page_size == 10_000
    flt, big = WindowFilter(0, 1, limit=10_000), WindowFilter(0, 1, limit=99_999)
    assert window.read_token(window.page_token(flt, Anchor(0, "a")), big) == Anchor(0, "a")


def test_plan_is_a_top_n(ten):
    plan = window.window_scan(ten, WindowFilter(0, 99, limit=5))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_days_prune_directories(spark, ten, tmp_path):
    path = str(tmp_path / "log")
    ten.withColumn("day", F.lit("1970-01-01").cast("date")).write.partitionBy("day").parquet(path)
    rows = window.window_rows(spark.read.parquet(path), WindowFilter(0, 50))
    plan = rows._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(ts" in plan
    assert rows.count() == 5


# --- state --------------------------------------------------------------------


def test_latest_is_by_event_time_and_first_arrival(make_events):
    rows = make_events(
        [("a", "s", "k", 100), ("b", "s", "k", 200, "{}", 10), ("c", "s", "k", 150),
         ("d", "s", "k", 200, "{}", 20), ("e", "s", "k@v2", 1)]
    )
    got = {r["kind"]: r["event_id"] for r in state.latest_by_event_time(rows).collect()}
    assert got == {"k": "b", "k@v2": "e"}


def test_hot_latest_is_by_arrival(make_events, ids):
    rows = make_events([("a", "s", "k", 200, "{}", 1), ("b", "s", "k", 100, "{}", 2)])
    assert ids(state.hot_latest(rows)) == ["b"]


def test_ring_counts(make_events, ids):
    rows = make_events([(f"e{i}", "s", "k", i) for i in range(5)])
    assert ids(state.hot_window(rows, max_events=3)) == ["e2", "e3", "e4"]


def test_ring_age_uses_ingest_time(make_events, ids):
    rows = make_events(
        [("old", "s", "k", 99_999, "{}", 0), ("edge", "s", "k", 0, "{}", 9950),
         ("new", "s", "k", 0, "{}", 10_000)]
    )
    assert ids(state.hot_window(rows, max_age_ms=50)) == ["edge", "new"]


def test_rings_are_independent(make_events):
    rows = make_events([("a", "s", "x", 1), ("b", "s", "x", 2), ("c", "s", "y", 1)])
    ring = state.hot_window(rows, max_events=2)
    assert {r["kind"]: r["count"] for r in ring.groupBy("kind").count().collect()} == {
        "x": 2,
        "y": 1,
    }
    assert state.hot_keys(ring).count() == 2


def test_quiet_ring_keeps_its_events(make_events, ids):
    rows = make_events([("a", "quiet", "k", 0), ("b", "busy", "k", 10**9)])
    assert ids(state.hot_window(rows, max_age_ms=1)) == ["a", "b"]


def expected_ring(pushes, max_events, max_age):
    """The newest pushes without the run of too old ones at their front."""
    cutoff = pushes[-1][1] - max_age
    kept = itertools.dropwhile(lambda p: p[1] < cutoff, pushes[-max_events:])
    return [name for name, _ in kept]


@pytest.mark.parametrize("max_events", [1, 4, 30])
def test_rings_of_many_pairs(make_events, ids, max_events):
    rng = random.Random(max_events)
    rows, expected = [], []
    for key in range(15):
        now, pushes = 0, []
        for i in range(rng.randrange(1, 40)):
            now += rng.choice([0, 1, 5, 30])
            pushes.append((f"{key:02d}-{i:03d}", now))
        rows += [(name, f"s{key}", "k", 0, "{}", at) for name, at in pushes]
        expected += expected_ring(pushes, max_events, 40)
    assert ids(state.hot_window(make_events(rows), max_events, 40)) == sorted(expected)


def test_snapshot_is_oldest_first(make_events):
    rows = make_events([("b", "s", "k", 2), ("a", "s", "k", 1), ("c", "s", "k", 3)])
    snap = state.hot_snapshot(state.hot_window(rows)).first()
    assert [e["event_id"] for e in snap["events"]] == ["a", "b", "c"]


def source(source_id, kinds, ord=0, **more):
    values = {"source_id": source_id, "kinds": kinds, "ord": ord, **more}
    return tuple(values.get(f) for f in SOURCE.fieldNames())


def kind(name, ord=0, **more):
    values = {"name": name, "ord": ord, **more}
    return tuple(values.get(f) for f in KIND.fieldNames())


@pytest.fixture(scope="module")
def declared(spark):
    sources = [
        source("cam", ["motion", "unheard"], 0, description="Camera", usage="", units="px",
               freshness_ttl_ms=40, semantic_schema='{"a":1}'),
        source("door", ["open"], 1, description="", caveats=None),
        source("attic", ["motion"], 2, freshness_ttl_ms=10**6),
    ]
    kinds = [
        kind("motion", 1, version="v2", description="second"),
        kind("motion", 0, version="v1", description="Motion", usage="count", units="n",
             semantic_schema='{"b":1}'),
        kind("open", 2, description="Door opened"),
    ]
    return descriptors.resolve_descriptors(
        spark.createDataFrame(sources, SOURCE), spark.createDataFrame(kinds, KIND)
    )


def test_descriptor_merge(declared):
    rows = {(r["source_id"], r["kind"]): r for r in declared.collect()}
    assert len(rows) == 4
    cam = rows["cam", "motion"]
    assert (cam["description"], cam["usage"], cam["caveats"]) == ("Camera", "count", "")
    assert (cam["semantic_schema"], cam["units"], cam["kind_version"]) == ('{"a":1}', "px", "v1")
    unheard = rows["cam", "unheard"]
    assert (unheard["kind_version"], unheard["usage"]) == ("v1", "")
    assert rows["door", "open"]["description"] == "Door opened"
    assert rows["attic", "motion"]["semantic_schema"] == '{"b":1}'


def test_current_state(declared, make_events):
    hot = make_events([("h", "cam", "motion", 950)])
    cold = make_events(
        [("c1", "cam", "motion", 990), ("c2", "door", "open", 2000), ("c3", "attic", "motion", 1),
         ("c4", "stranger", "open", 1), ("c5", "cam", "motion@v2", 1)]
    )
    got = {
        r["source_id"]: (r["event_id"], r["age_ms"], r["stale"], r["from_cold"])
        for r in state.current_state(declared, hot, cold, 1000).collect()
    }
    assert got == {
        "cam": ("h", 50, True, False),
        "door": ("c2", -1000, False, True),
        "attic": ("c3", 999, False, True),
    }
    assert state.current_state(declared, hot, None, 1000).count() == 1
    some = state.current_state(declared, hot, cold, 1000, ["a*"], ["mot*"])
    assert [r["descriptor"]["source_id"] for r in some.collect()] == ["attic"]


def test_describe_sources(spark, declared):
    log = spark.createDataFrame(
        [("cam", "rate_limit", 5), ("cam", "rate_limit", 9), ("cam", "unauthorized", 7)],
        "source_id string, reason string, ts_ms long",
    )
    policies = [RetentionPolicy(match_kind="motion", max_age_ms=7)]
    rows = descriptors.describe_sources(declared, recent_errors(log), policies, ["c*", "d*"])
    got = {(r["source_id"], r["kind"]): r for r in rows.collect()}
    assert set(got) == {("cam", "motion"), ("cam", "unheard"), ("door", "open")}
    cam = got["cam", "motion"]
    assert cam["recent_errors"]["counters"] == {"rate_limit": 2, "unauthorized": 1}
    assert cam["recent_errors"]["last_error_ts_ms_utc"] == 9
    assert cam["effective_retention"]["max_age_ms"] == 7
    assert got["cam", "unheard"]["effective_retention"] is None
    assert got["door", "open"]["recent_errors"] is None


def test_current_state_of_a_log(declared, make_events):
    """As from separate hot and cold rows, with two scans and no aggregate over whole rows."""
    rows = make_events([("h", "cam", "motion", 10, "{}", 900), ("c", "cam", "motion", 50, "{}", 100), ("d", "door", "open", 7, "{}", 8),
                        ("d2", "door", "open", 7, "{}", 9), ("e", "attic", "motion", 3, "{}", 950), ("x", "zz", "motion", 3)])
    hot = state.hot_latest(rows.where("ingest_ts_ms_utc >= 500"))
    expected = state.current_state(declared, hot, state.latest_by_event_time(rows), 1000)
    got = state.current_state_of(declared, rows, 500, 1000)
    columns = ["source_id", "kind", "event_id", "ts_ms_utc", "age_ms", "stale", "from_cold"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, expected.select(*columns).collect()))
    assert {(r["event_id"], r["from_cold"]) for r in got.collect()} == {("h", False), ("d", True), ("e", False)}
    assert got.columns == expected.columns


def test_repeated_rows_are_one_latest_row(make_events):
    rows = make_events([("a", "s", "k", 5), ("a", "s", "k", 5)])
    assert state.latest_by_event_time(rows).count() == state.hot_latest(rows).count() == 1


def test_latest_rows_aggregate_narrow_keys(spark, make_events, tmp_path):
    make_events([("a", "s", "k", 5), ("b", "s", "k", 6)]).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    for frame in (state.latest_by_event_time(log), state.hot_latest(log)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        aggregates = [line for line in plan.splitlines() if "Aggregate(" in line]
        assert aggregates and not any("semantic" in line for line in aggregates)
        assert plan.count("FileScan") == 2
