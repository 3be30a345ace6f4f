"""Policy-driven expiry of events and vectors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.scalars import bare_kind
from eventlens.model import COSTLY_SWEEP_ROWS, RetentionPolicy
from eventlens.operators.lookup import config_table
from eventlens.operators.ordered import (
    RANGE,
    ROWS_PER_RANGE,
    range_totals,
    with_ranges,
)

PAIR = ["source_id", "kind"]
ORDER = ["ts_ms_utc", "event_id"]
LIMITS = ["max_age_ms", "max_count", "max_bytes", "vector_max_age_ms"]


def _tier(policy: RetentionPolicy) -> int:
    """Rules naming a source first, then rules naming a kind, then the rest."""
    if policy.match_source_id is not None:
        return 0
    return 1 if policy.match_kind is not None else 2


def resolve_retention(rows: DataFrame, policies: Sequence[RetentionPolicy]) -> DataFrame:
    """Add the four limits that apply to each row's (source, kind).

    Every limit comes from the first matching policy that sets it, going by
    tier and then by configured order.  Policies become small tables, one for each way
    of naming what they match, with the first policy of each name; a row looks
    up its source and its kind, as sent and without version, and takes the
    first of what it finds.
    """
    ranked = sorted(policies, key=_tier)  # stable: configured order within a tier
    tables: dict[tuple[bool, bool], dict[tuple, dict]] = {}
    for rank, policy in enumerate(ranked):
        name = (policy.match_source_id, policy.match_kind)
        entry = tables.setdefault((name[0] is not None, name[1] is not None), {}).setdefault(name, {})
        for limit in LIMITS:
            if (value := getattr(policy, limit)) is not None:
                entry.setdefault(limit, {"rank": rank, "value": value})

    columns, found = rows.columns, []
    rows = rows.withColumn("__bare", bare_kind(F.col("kind")))
    fields = ", ".join(f"{limit} struct<rank: int, value: bigint>" for limit in LIMITS)
    for (by_source, by_kind), entries in sorted(tables.items()):
        if not by_source and not by_kind:
            only = entries[None, None]
            kept = {k: F.struct(F.lit(v["rank"]).alias("rank"), F.lit(v["value"]).cast("long").alias("value")) for k, v in only.items()}
            found.append(kept)
            continue
        listed = [{"s": s, "k": k, "limits": {**dict.fromkeys(LIMITS), **e}} for (s, k), e in entries.items()]
        table = config_table(rows.sparkSession, listed, f"s string, k string, limits struct<{fields}>")
        for kind in ("kind", "__bare") if by_kind else (None,):
            at = f"__found{len(found)}"
            same = [F.col("source_id") == F.col("__s")] if by_source else []
            same += [F.col(kind) == F.col("__k")] if kind else []
            named = table.select(F.col("s").alias("__s"), F.col("k").alias("__k"), F.col("limits").alias(at))
            rows = rows.join(named, reduce(Column.__and__, same), "left").drop("__s", "__k")
            found.append({limit: F.col(at)[limit] for limit in LIMITS})

    none = F.lit(None).cast("struct<rank: int, value: bigint>")
    firsts = {limit: [f[limit] for f in found if limit in f] for limit in LIMITS}
    limits = [F.least(none, none, *firsts[limit])["value"].alias(limit) for limit in LIMITS]
    return rows.select(*columns, *limits)


def effective_retention(pairs: DataFrame, policies: Sequence[RetentionPolicy]) -> DataFrame:
    """Pairs that have at least one limit, with all four."""
    resolved = resolve_retention(pairs.select(*PAIR).distinct(), policies)
    return resolved.where(F.coalesce(*LIMITS).isNotNull())


def expired_by_age(events: DataFrame, policies: Sequence[RetentionPolicy], now_ms: int):
    """Rows strictly older than their pair's ``max_age_ms``."""
    resolved = resolve_retention(events, policies)
    return resolved.where(
        F.col("ts_ms_utc") < F.lit(now_ms) - F.col("max_age_ms")
    ).select(*events.columns)


def expired_by_count(
    events: DataFrame, policies: Sequence[RetentionPolicy], rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """All but the newest ``max_count`` rows of each pair."""
    limited = resolve_retention(events, policies).where("max_count is not null")
    ranked = _with_running(limited, rows_per_range)
    return ranked.where("__n > max_count").select(*events.columns)


def expired_by_bytes(
    events: DataFrame, policies: Sequence[RetentionPolicy], rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Rows at which the newest-first running payload length exceeds ``max_bytes``.

    Length counts the characters of the stored text.
    """
    limited = resolve_retention(events, policies).where("max_bytes is not null")
    summed = _with_running(limited, rows_per_range)
    return summed.where("__size > max_bytes").select(*events.columns)


def expired_vectors(vectors: DataFrame, policies: Sequence[RetentionPolicy], now_ms: int):
    """Vectors strictly older than their pair's ``vector_max_age_ms``."""
    resolved = resolve_retention(vectors, policies)
    return resolved.where(
        F.col("ts_ms_utc") < F.lit(now_ms) - F.col("vector_max_age_ms")
    ).select(*vectors.columns)


def orphan_vectors(vectors: DataFrame, events: DataFrame) -> DataFrame:
    """Vectors whose event is no longer stored."""
    return vectors.join(events.select("event_id"), "event_id", "left_anti")


def _rank_only_the_undecided(
    ranged: DataFrame, sums: dict[str, Column], limits: dict[str, str]
) -> DataFrame:
    """Running sums, skipping ranges whose rows are kept or dropped as a whole.

    From the totals of each range alone it is known whether a limit is crossed
    before it, after it or inside it.  Only ranges with a crossing inside are
    shuffled and ranked; the other rows get the sum at the start (not crossed)
    or the end of their range, which falls on the right side of the limit.
    """
    totals = range_totals(ranged, PAIR, sums, newest_first=True)
    located = ranged.join(totals, [*PAIR, RANGE])
    crossed_inside = F.lit(False)
    for name, limit in limits.items():
        start = F.col(f"__before_{name}")
        crossed_inside |= F.coalesce(
            (start <= F.col(limit)) & (start + F.col(f"__in_{name}") > F.col(limit)), F.lit(False)
        )
    located = located.withColumn("__undecided", crossed_inside)
    base = [c for c in ranged.columns if c != RANGE]
    inside = (
        Window.partitionBy(*PAIR, RANGE)
        .orderBy(*[F.col(c).desc() for c in ORDER])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = located.where("__undecided").select(
        *base,
        *[
            (F.sum(col).over(inside) + F.col(f"__before_{name}")).alias(name)
            for name, col in sums.items()
        ],
    )
    decided = located.where("not __undecided").select(
        *base,
        *[
            F.when(F.col(f"__before_{n}") > F.col(limits[n]), F.col(f"__before_{n}"))
            .otherwise(F.col(f"__before_{n}") + F.col(f"__in_{n}"))
            .alias(n)
            for n in sums
        ],
    )
    return ranked.unionByName(decided)


def _with_running(limited: DataFrame, rows_per_range: int) -> DataFrame:
    sums = {"__n": F.lit(1), "__size": F.length("semantic")}
    ranged, maybe_cut = with_ranges(limited, PAIR, ORDER, rows_per_range)
    if maybe_cut is None:
        newest_first = (
            Window.partitionBy(*PAIR)
            .orderBy(*[F.col(c).desc() for c in ORDER])
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        plain = [F.sum(col).over(newest_first).alias(name) for name, col in sums.items()]
        return ranged.drop(RANGE).select("*", *plain)
    limits = {"__n": "max_count", "__size": "max_bytes"}
    return _rank_only_the_undecided(ranged, sums, limits)


def classify(
    events: DataFrame,
    policies: Sequence[RetentionPolicy],
    now_ms: int,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """All events with their limits and ``drop_reason``: age, count, bytes or null.

    Each step works on what the one before left.  Going newest first, survivors
    of every step are a prefix of the pair, so ranks and running sizes over the
    survivors of the age step serve both later steps and one pass is enough.
    Pairs without a count or size limit are never ranked.
    """
    resolved = resolve_retention(events, policies)
    too_old = F.coalesce(
        F.col("ts_ms_utc") < F.lit(now_ms) - F.col("max_age_ms"), F.lit(False)
    )
    by_order = ~too_old & F.coalesce("max_count", "max_bytes").isNotNull()
    by_age = resolved.where(~by_order).withColumn("drop_reason", F.when(too_old, "age"))
    reason = F.when(F.col("__n") > F.col("max_count"), "count").when(
        F.col("__size") > F.col("max_bytes"), "bytes"
    )
    ranked = _with_running(resolved.where(by_order), rows_per_range)
    return by_age.unionByName(ranked.withColumn("drop_reason", reason).drop("__n", "__size"))


def drop_reasons(
    events: DataFrame,
    policies: Sequence[RetentionPolicy],
    now_ms: int,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Events a sweep removes, each with its reason."""
    return classify(events, policies, now_ms, rows_per_range).where("drop_reason is not null")


def survivors(
    events: DataFrame,
    policies: Sequence[RetentionPolicy],
    now_ms: int,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """The log after a sweep."""
    classified = classify(events, policies, now_ms, rows_per_range)
    return classified.where("drop_reason is null").select(*events.columns)


def _pair_report(event_drops: DataFrame, vector_drops: DataFrame | None) -> DataFrame:
    """Per-pair counts where something was dropped, with the pair's limits, which the inputs bring beside their ``n``."""
    zero = F.lit(0).cast("long")
    parts = event_drops.select(
        *PAIR, *LIMITS, F.col("n").alias("events_dropped"), zero.alias("vectors_dropped")
    )
    if vector_drops is not None:
        parts = parts.unionByName(
            vector_drops.select(
                *PAIR, *LIMITS, zero.alias("events_dropped"), F.col("n").alias("vectors_dropped")
            )
        )
    return (
        parts.groupBy(*PAIR, *LIMITS)
        .agg(
            F.sum("events_dropped").alias("events_dropped"),
            F.sum("vectors_dropped").alias("vectors_dropped"),
        )
        .where("events_dropped > 0 or vectors_dropped > 0")
        .select(*PAIR, "events_dropped", "vectors_dropped", *LIMITS)
    )


def _expired_vector_counts(
    vectors: DataFrame | None, policies: Sequence[RetentionPolicy], now_ms: int
) -> DataFrame | None:
    if vectors is None:
        return None
    resolved = resolve_retention(vectors.select(*PAIR, "ts_ms_utc"), policies)
    gone = resolved.where(F.col("ts_ms_utc") < F.lit(now_ms) - F.col("vector_max_age_ms"))
    return gone.groupBy(*PAIR, *LIMITS).agg(F.count("*").alias("n"))


def sweep_report(
    events: DataFrame,
    policies: Sequence[RetentionPolicy],
    now_ms: int,
    vectors: DataFrame | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """What a sweep removes from each pair (exact, each row counted once)."""
    drops = drop_reasons(events, policies, now_ms, rows_per_range)
    counted = drops.groupBy(*PAIR, *LIMITS).agg(F.count("*").alias("n"))
    return _pair_report(counted, _expired_vector_counts(vectors, policies, now_ms))


def dry_run_report(
    events: DataFrame,
    policies: Sequence[RetentionPolicy],
    now_ms: int,
    vectors: DataFrame | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Per-pair preview in which every step sees the untouched log.

    A row that several limits would remove counts several times, so totals can
    exceed those of `sweep_report`.
    """
    limits = ["max_age_ms", "max_count", "max_bytes"]
    resolved = resolve_retention(events, policies).where(F.coalesce(*limits).isNotNull())
    old = F.coalesce(F.col("ts_ms_utc") < F.lit(now_ms) - F.col("max_age_ms"), F.lit(False))
    # Age and count need only totals per pair; just size needs an order.
    per_pair = resolved.groupBy(*PAIR, *LIMITS).agg(
        F.count_if(old).alias("aged"), F.count("*").alias("rows")
    )
    excess = F.greatest(F.col("rows") - F.col("max_count"), F.lit(0))
    plain = per_pair.select(*PAIR, *LIMITS, (F.col("aged") + F.coalesce(excess, F.lit(0))).alias("n"))
    summed = _with_running(resolved.where("max_bytes is not null"), rows_per_range)
    sized = summed.where("__size > max_bytes").groupBy(*PAIR, *LIMITS).agg(F.count("*").alias("n"))
    return _pair_report(plain.unionByName(sized), _expired_vector_counts(vectors, policies, now_ms))


def sweep_warnings(
    events: DataFrame,
    policies: Sequence[RetentionPolicy],
    now_ms: int,
    dry_run: bool = False,
) -> DataFrame:
    """Pairs on which a count or size limit has many rows to go through.

    Each limit warns by the rows it meets: the count step those that age left,
    the size step those that the count step left; a dry run all rows.
    """
    resolved = resolve_retention(events, policies).where(
        F.coalesce("max_count", "max_bytes").isNotNull()
    )
    if not dry_run:
        resolved = resolved.where(
            F.coalesce(F.col("ts_ms_utc") >= F.lit(now_ms) - F.col("max_age_ms"), F.lit(True))
        )
    rows = resolved.groupBy(*PAIR, "max_count", "max_bytes").agg(F.count("*").alias("rows"))
    left = F.col("rows") if dry_run else F.least("rows", "max_count")
    steps = F.array(
        F.struct(
            F.lit("max_count").alias("limit"),
            F.when(F.col("max_count").isNotNull(), F.col("rows")).alias("rows"),
        ),
        F.struct(
            F.lit("max_bytes").alias("limit"),
            F.when(F.col("max_bytes").isNotNull(), left).alias("rows"),
        ),
    )
    return (
        rows.select(*PAIR, F.inline(steps))
        .where(F.col("rows") > COSTLY_SWEEP_ROWS)
        .select(*PAIR, "limit", "rows")
    )


def sweep_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.coalesce(F.sum("events_dropped"), F.lit(0)).alias("events_dropped"),
        F.coalesce(F.sum("vectors_dropped"), F.lit(0)).alias("vectors_dropped"),
    )
