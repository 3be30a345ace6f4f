"""Error digests and counters over the audit output of the ingest operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent_errors(error_log: DataFrame) -> DataFrame:
    """Per source: reason to count, and the time of the last error.

    ``error_log`` has source_id, reason, ts_ms and optionally ``n``, the number
    of errors a row stands for.  Sources without errors give no row.
    """
    n = F.col("n") if "n" in error_log.columns else F.lit(1)
    per_reason = (
        error_log.groupBy("source_id", "reason")
        .agg(F.sum(n).cast("long").alias("n"), F.max("ts_ms").alias("ts_ms"))
        .where("n > 0")
    )
    return per_reason.groupBy("source_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias(
            "counters"
        ),
        F.max("ts_ms").alias("last_error_ts_ms_utc"),
    )


def admission_errors(audit: DataFrame) -> DataFrame:
    """Error-log rows of an admission audit (one row per batch).

    The first failing event's source is charged once.  Rate refusals charge
    every event of the batch and come from `event_errors` instead.
    """
    return audit.where(F.col("source_id").isNotNull()).select(
        "source_id", "token_name", "reason", F.col("at_ms").alias("ts_ms")
    )


def event_errors(events: DataFrame, reason: str, ts_column: str) -> DataFrame:
    """Error-log rows for events that each count one error of a fixed reason."""
    return events.select(
        "source_id", F.lit(reason).alias("reason"), F.col(ts_column).alias("ts_ms")
    )


def ingest_counters(
    accepted: DataFrame, audit: DataFrame, routed: DataFrame | None = None
) -> DataFrame:
    """Long table ``(counter, label, n)`` of what ingest let through and shed.

    ``accepted`` are normalised events with token_name and schema_invalid,
    ``audit`` the batch verdicts of admission (reason, token_name,
    soft_oversize), ``routed`` routing outcomes with broker_id and outcome.
    Each input is read once and reduced to its few label combinations, which
    are then spread over the counters they belong to.
    """

    def entry(counter: str | Column, label: Column, n: Column) -> Column:
        name = F.lit(counter) if isinstance(counter, str) else counter
        return F.struct(
            name.alias("counter"), label.cast("string").alias("label"), n.cast("long").alias("n")
        )

    none, n, zero = F.lit(None), F.col("n"), F.lit(0)

    def labelled(counter: str, label: str, when: Column | None = None) -> Column:
        there = F.col(label).isNotNull() if when is None else when & F.col(label).isNotNull()
        return F.when(there, entry(counter, F.col(label), n))

    def spread(groups: DataFrame, *entries: Column) -> DataFrame:
        return groups.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))

    shed = F.col("reason").isNotNull()
    parts = [
        spread(
            accepted.groupBy("token_name", "schema_invalid").agg(F.count("*").alias("n")),
            entry("accepted", none, n),
            labelled("accepted_by_token", "token_name"),
            entry("schema_invalid", none, F.when(F.col("schema_invalid"), n).otherwise(zero)),
        ),
        spread(
            audit.groupBy("token_name", "reason").agg(
                F.count("*").alias("n"), F.sum("soft_oversize").alias("soft")
            ),
            labelled("shed_by_reason", "reason"),
            labelled("shed_by_token", "token_name", shed),
            entry("oversized_soft", none, F.col("soft")),
        ),
        # totals are reported even when there is nothing to count
        spread(
            accepted.sparkSession.range(1),
            *[entry(c, none, zero) for c in ("accepted", "schema_invalid", "oversized_soft")],
        ),
    ]
    if routed is not None:
        outcome = F.concat(F.lit("routed_"), "outcome")
        parts.append(
            spread(
                routed.groupBy("broker_id", "outcome").agg(F.count("*").alias("n")),
                entry(outcome, F.col("broker_id"), n),
            )
        )
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("counter", "label")
        .agg(F.sum("n").alias("n"))
    )


def sink_progress(commits: DataFrame) -> DataFrame:
    """Per sink: batches, rows, truncations, drops and failed batches.

    ``commits`` is the commit log that each streaming sink appends to.
    """
    return commits.groupBy("sink").agg(
        F.count_if(F.col("error").isNull()).alias("batches"),
        F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("rows"))), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("truncated"), F.lit(0)).alias("truncated"),
        F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col("ts_ms"))).alias("last_error"),
    )
