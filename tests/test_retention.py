import random

import pytest

from eventlens.model import VECTOR, RetentionPolicy
from eventlens.operators import retention

P = RetentionPolicy


@pytest.fixture(scope="module")
def ten(make_events):
    return make_events([(f"e{i}", "s", "k", i * 10) for i in range(10)])


def effective(make_events, source, kind, policies):
    row = retention.resolve_retention(make_events([("e", source, kind, 1)]), policies).first()
    return tuple(row[limit] for limit in retention.LIMITS)


def test_source_rule_beats_earlier_kind_rule(make_events):
    policies = [P(match_kind="k", max_age_ms=7), P(match_source_id="s", max_age_ms=30)]
    assert effective(make_events, "s", "k", policies) == (30, None, None, None)


def test_each_limit_on_its_own(make_events):
    policies = [P(max_bytes=1, max_age_ms=9), P(match_source_id="s", max_count=5),
                P(match_kind="k", max_age_ms=7, vector_max_age_ms=3)]
    assert effective(make_events, "s", "k", policies) == (7, 5, 1, 3)


def test_configured_order_within_a_tier(make_events):
    policies = [P(match_source_id="s", match_kind="k", max_age_ms=1),
                P(match_source_id="s", max_age_ms=2)]
    assert effective(make_events, "s", "k", policies)[0] == 1
    assert effective(make_events, "s", "k", policies[::-1])[0] == 2


def test_kind_matches_raw_or_bare(make_events):
    bare, raw = [P(match_kind="k", max_count=1)], [P(match_kind="k@v2", max_count=1)]
    assert effective(make_events, "s", "k@v2", bare)[1] == 1
    assert effective(make_events, "s", "k@v2", raw)[1] == 1
    assert effective(make_events, "s", "k", raw)[1] is None


def test_pairs_without_limits_are_left_out(make_events):
    rows = make_events([("a", "s", "k", 1), ("b", "s", "other", 1)])
    assert retention.effective_retention(rows, [P(match_kind="k", max_count=1)]).count() == 1


def test_age_is_strict(ten, ids):
    policies = [P(max_age_ms=50)]
    assert ids(retention.expired_by_age(ten, policies, 100)) == ["e0", "e1", "e2", "e3", "e4"]
    report = retention.sweep_report(ten, policies, 100).first()
    dry = retention.dry_run_report(ten, policies, 100).first()
    assert report["events_dropped"] == dry["events_dropped"] == 5


def test_count(ten, ids):
    assert ids(retention.expired_by_count(ten, [P(max_count=3)])) == [f"e{i}" for i in range(7)]
    assert retention.sweep_report(ten, [P(max_count=3)], 0).first()["events_dropped"] == 7


def test_bytes_count_characters_and_keep_the_newest(make_events, ids):
    rows = make_events([("a", "s", "k", 1, "éé"), ("b", "s", "k", 2, "xx"), ("c", "s", "k", 3, "x")])
    assert ids(retention.expired_by_bytes(rows, [P(max_bytes=5)])) == []
    assert ids(retention.expired_by_bytes(rows, [P(max_bytes=4)])) == ["a"]
    assert ids(retention.expired_by_bytes(rows, [P(max_bytes=2)])) == ["a", "b"]


def test_steps_work_on_what_is_left(ten):
    policies = [P(max_age_ms=50, max_count=4, max_bytes=6)]
    reasons = {
        r["event_id"]: r["drop_reason"]
        for r in retention.drop_reasons(ten, policies, 100).collect()
    }
    assert reasons == {**{f"e{i}": "age" for i in range(5)}, "e5": "count", "e6": "bytes"}
    exact = retention.sweep_report(ten, policies, 100).first()
    dry = retention.dry_run_report(ten, policies, 100).first()
    assert (exact["events_dropped"], dry["events_dropped"]) == (7, 5 + 6 + 7)
    assert retention.sweep_totals(retention.sweep_report(ten, policies, 100)).first() == (7, 0)


def test_warnings(make_events):
    rows = make_events([(f"e{i:05d}", "s", "k", i) for i in range(1005)])
    warned = retention.sweep_warnings(rows, [P(max_count=10, max_bytes=5)], 10**6).collect()
    assert [(r["limit"], r["rows"]) for r in warned] == [("max_count", 1005)]
    dry = retention.sweep_warnings(rows, [P(max_count=10, max_bytes=5)], 10**6, dry_run=True)
    assert {r["limit"] for r in dry.collect()} == {"max_count", "max_bytes"}
    aged = retention.sweep_warnings(rows, [P(max_age_ms=10, max_count=10)], 1005)
    assert aged.count() == 0


def vectors(spark, rows):
    full = [(i, s, k, t, False, "m", [1.0, 0.0]) for i, s, k, t in rows]
    return spark.createDataFrame(full, VECTOR)


def test_vectors(spark, ten, ids):
    rows = vectors(spark, [("e1", "s", "k", 10), ("v", "s", "k", 200)])
    policies = [P(vector_max_age_ms=100)]
    assert ids(retention.expired_vectors(rows, policies, 300)) == ["e1"]
    report = retention.sweep_report(ten, policies, 300, rows).first()
    assert (report["events_dropped"], report["vectors_dropped"]) == (0, 1)
    assert ids(retention.orphan_vectors(rows, ten)) == ["v"]


def sweep_by_hand(rows, policies, now):
    """Sequential sweep; rows are (id, source, kind, ts, semantic)."""
    out = {}
    for pair in {(r[1], r[2]) for r in rows}:
        mine = sorted((r for r in rows if (r[1], r[2]) == pair), key=lambda r: (r[3], r[0]))
        age, count, size = policies.get(pair[1], (None, None, None))
        if age is not None:
            out |= {r[0]: "age" for r in mine if r[3] < now - age}
            mine = [r for r in mine if r[3] >= now - age]
        if count is not None:
            extra = mine[: max(0, len(mine) - count)]
            out |= {r[0]: "count" for r in extra}
            mine = mine[len(extra) :]
        if size is not None:
            running = 0
            for r in reversed(mine):
                running += len(r[4])
                if running > size:
                    out[r[0]] = "bytes"
    return out


@pytest.mark.parametrize("rows_per_range", [40, 300, 10**6])
def test_sweep_with_a_hot_pair(make_events, rows_per_range):
    """Half of all rows belong to one pair and share few event times."""
    rng = random.Random(1)
    rows = []
    for i in range(1200):
        source = "hot" if i % 2 else f"s{rng.randrange(6)}"
        kind = rng.choice(["age", "count", "bytes", "all", "free"]) if i % 3 else "all"
        ts = rng.choice([10, 20, 20, 20, 30, 40])
        rows.append((f"{i:05d}", source, kind, ts, "x" * rng.randrange(1, 9)))
    limits = {"age": (12, None, None), "count": (None, 25, None), "bytes": (None, None, 120),
              "all": (25, 200, 700)}
    policies = [
        P(match_kind=k, max_age_ms=a, max_count=c, max_bytes=b) for k, (a, c, b) in limits.items()
    ]
    events = make_events(rows)
    got = retention.drop_reasons(events, policies, 45, rows_per_range)
    assert {r["event_id"]: r["drop_reason"] for r in got.collect()} == sweep_by_hand(
        rows, limits, 45
    )
    left = retention.survivors(events, policies, 45, rows_per_range)
    assert left.count() + got.count() == len(rows)
    assert left.columns == events.columns


def test_policies_need_no_join(ten):
    plan = retention.expired_by_age(ten, [P(max_age_ms=1)], 9)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan
