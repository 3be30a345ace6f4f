"""What is true now: recency windows, latest rows and staleness.

Two meanings of "latest" exist and both are kept: the last event to *arrive*
(`hot_latest`) and the event with the greatest *event time*
(`latest_by_event_time`).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.globs import glob_filter
from eventlens.model import RING_MAX_AGE_MS, RING_MAX_EVENTS

PAIR = ("source_id", "kind")


def _push_time() -> Column:
    return F.coalesce("ingest_ts_ms_utc", "ts_ms_utc")


def hot_window(
    events: DataFrame,
    max_events: int = RING_MAX_EVENTS,
    max_age_ms: int = RING_MAX_AGE_MS,
    arrival: Sequence[str] = ("ingest_ts_ms_utc", "event_id"),
) -> DataFrame:
    """Recent events of each (source, kind) as of that pair's own last arrival.

    Both limits hold: at most ``max_events``, and none older than
    ``max_age_ms`` at the front.  Expiry stops at the first event young enough,
    so an old one behind it stays.  Age is counted from ingest time, and a pair
    that has gone quiet keeps what it last held.

    A first round per pair and input partition bounds what one task of the second
    receives for a hot pair; there are as many shares as the data has partitions.
    Catalyst keeps only the newest rows of each before the shuffle where
    ``max_events`` is below its own limit for that.
    """
    newest_first = [F.col(c).desc() for c in arrival]
    salted = Window.partitionBy(*PAIR, "__share").orderBy(*newest_first)
    per_pair = Window.partitionBy(*PAIR).orderBy(*newest_first)
    older = per_pair.rowsBetween(0, Window.unboundedFollowing)
    rounds = (
        events.withColumn("__share", F.spark_partition_id())
        .withColumn("__n", F.row_number().over(salted))
        .where(F.col("__n") <= max_events)
        .drop("__share", "__n")
    )
    last = (
        rounds.withColumn("__rank", F.row_number().over(per_pair))
        .where(F.col("__rank") <= max_events)
        .withColumn("__cutoff", F.first(_push_time()).over(per_pair) - max_age_ms)
    )
    young = _push_time() >= F.col("__cutoff")
    return (
        last.withColumn("__live", F.max(young).over(older))
        .where("__live")
        .drop("__rank", "__cutoff", "__live")
    )


def _fetched(events: DataFrame, winners: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows of ``events`` that agree with a pair's winner in ``fields``, one per pair, with the winners' other columns.

    Only the pairs' narrow keys are aggregated; whole rows are read for the winners alone.
    """
    named = winners.select(
        *[F.col(c).alias(f"__won_{c}") for c in (*PAIR, *fields)],
        *[c for c in winners.columns if c not in (*PAIR, *fields)],
    )
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__won_{c}")) for c in (*PAIR, *fields)])
    found = events.join(named, same).drop(*[f"__won_{c}" for c in (*PAIR, *fields)])
    # rows repeated in full are one event
    order = Window.partitionBy(*PAIR).orderBy(*fields)
    return found.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def hot_latest(
    events: DataFrame, arrival: Sequence[str] = ("ingest_ts_ms_utc", "event_id")
) -> DataFrame:
    """The last event to arrive, per (source, kind)."""
    last = events.groupBy(*PAIR).agg(F.max(F.struct(*arrival)).alias("k")).select(*PAIR, "k.*")
    return _fetched(events, last, arrival)


def hot_snapshot(window: DataFrame, arrival: Sequence[str] = ("ingest_ts_ms_utc", "event_id")):
    """A `hot_window` as one row per pair with its events, oldest first.

    The window is bounded per pair, and so is the array.
    """
    rest = [c for c in window.columns if c not in PAIR]
    ordered = [*arrival, *[c for c in rest if c not in arrival]]
    return window.groupBy(*PAIR).agg(
        F.sort_array(F.collect_list(F.struct(*ordered))).alias("events")
    )


def hot_keys(window: DataFrame) -> DataFrame:
    return window.select(*PAIR).distinct()


def latest_by_event_time(
    events: DataFrame, arrival: Sequence[str] = ("ingest_ts_ms_utc", "event_id")
) -> DataFrame:
    """The event with the greatest event time per (source, kind).

    Among equal times the first to arrive stays.  Keys are reduced on every task
    before the shuffle, so that hot pairs shrink.
    """
    fields = ["ts_ms_utc", *[c for c in arrival if c != "ts_ms_utc"]]
    first = events.groupBy(*PAIR).agg(F.min(_time_key(arrival)).alias("k"))
    winners = first.select(*PAIR, (-F.col("k.t")).alias("ts_ms_utc"), *[f"k.{c}" for c in fields[1:]])
    return _fetched(events, winners, fields)


def _time_key(arrival: Sequence[str]) -> Column:
    return F.struct((-F.col("ts_ms_utc")).alias("t"), *arrival)


def staleness(now_ms: int, ttl: Column | None = None) -> list[Column]:
    """Columns ``age_ms`` (negative for future times) and ``stale``."""
    age = F.lit(now_ms) - F.col("ts_ms_utc")
    ttl = F.col("freshness_ttl_ms") if ttl is None else ttl
    return [
        age.alias("age_ms"),
        F.coalesce(age > ttl, F.lit(False)).alias("stale"),
    ]


def current_state(
    descriptors: DataFrame,
    hot: DataFrame,
    cold: DataFrame | None,
    now_ms: int,
    sources: Sequence[str] | None = None,
    kinds: Sequence[str] | None = None,
) -> DataFrame:
    """Latest event of every *declared* pair, with age and staleness.

    ``hot`` and ``cold`` hold one row per pair (`hot_latest` of recent events,
    `latest_by_event_time` of the log); a hot row wins, and a pair with neither
    gives no row.  A kind sent with a version is another pair than its bare
    declaration.
    """
    wanted = descriptors.where(
        glob_filter(F.col("source_id"), sources) & glob_filter(F.col("kind"), kinds)
    )
    candidates = hot.withColumn("from_cold", F.lit(False))
    if cold is not None:
        missing = cold.join(hot.select(*PAIR), list(PAIR), "left_anti")
        candidates = candidates.unionByName(
            missing.withColumn("from_cold", F.lit(True)), allowMissingColumns=True
        )
    event_columns = [c for c in candidates.columns if c not in (*PAIR, "from_cold")]
    descriptor_columns = [c for c in wanted.columns if c not in PAIR]
    return candidates.join(wanted, list(PAIR)).select(
        *PAIR,
        *event_columns,
        *staleness(now_ms),
        "from_cold",
        F.struct(*PAIR, *descriptor_columns).alias("descriptor"),
        F.lit(None).cast("string").alias("peer_id"),
    )


def current_state_of(
    descriptors: DataFrame,
    events: DataFrame,
    since_ms: int,
    now_ms: int,
    sources: Sequence[str] | None = None,
    kinds: Sequence[str] | None = None,
    arrival: Sequence[str] = ("ingest_ts_ms_utc", "event_id"),
) -> DataFrame:
    """`current_state` straight from a log: what arrived from ``since_ms`` on counts as hot.

    One conditional aggregate over narrow keys finds both winners of each pair, and whole rows are read for
    the winners of declared pairs alone: two scans.
    """
    recent = F.col("ingest_ts_ms_utc") >= since_ms
    keys = events.groupBy(*PAIR).agg(
        F.max(F.when(recent, F.struct(*arrival))).alias("hot"), F.min(_time_key(arrival)).alias("cold")
    )
    from_cold = F.col("hot").isNull()
    chosen = [F.when(from_cold, F.col(f"cold.{c}")).otherwise(F.col(f"hot.{c}")).alias(c) for c in arrival]
    wanted = descriptors.where(
        glob_filter(F.col("source_id"), sources) & glob_filter(F.col("kind"), kinds)
    )
    described = wanted.select(*PAIR, F.struct(*wanted.columns).alias("descriptor"))
    winners = keys.select(*PAIR, *chosen, from_cold.alias("from_cold")).join(described, list(PAIR))
    event_columns = [c for c in events.columns if c not in PAIR]
    ages = staleness(now_ms, F.col("descriptor.freshness_ttl_ms"))
    return _fetched(events, winners, arrival).select(
        *PAIR, *event_columns, *ages, "from_cold", "descriptor", F.lit(None).cast("string").alias("peer_id")
    )
