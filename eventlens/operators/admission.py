"""Which batches may enter: scope, size and rate."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.globs import PATTERN_SET, in_pattern_set, pattern_set
from eventlens.functions.scalars import semantic_size
from eventlens.model import HARD_CAP_BYTES, SOFT_CAP_BYTES, TokenScope
from eventlens.operators.lookup import config_table
from eventlens.operators.ordered import ROWS_PER_RANGE, running_totals

#: Stores a frame that is read several times under a name, and gives the stored one.
Keep = Callable[[DataFrame, str], DataFrame]


def as_is(frame: DataFrame, name: str) -> DataFrame:
    return frame


# Units of a rate and their length in nanoseconds.
_UNIT_NS = {"s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}


@dataclass(frozen=True)
class Admission:
    accepted: DataFrame
    rejected: DataFrame
    audit: DataFrame


def with_allowed(events: DataFrame, tokens: Sequence[TokenScope]) -> DataFrame:
    """Add ``allowed``: may the row's token write its source and kind?

    Both an allowed source and an allowed kind are needed; an empty list, like
    an unknown token, allows nothing.  Tokens are looked up in a table, and
    only the patterns of the row's own token are tested.
    """
    schema = f"token_name string, __sources struct<{PATTERN_SET}>, __kinds struct<{PATTERN_SET}>"
    first = {t.name: t for t in reversed(tokens)}
    rows = [
        {"token_name": n, "__sources": pattern_set(t.allow_sources), "__kinds": pattern_set(t.allow_kinds)}
        for n, t in first.items()
    ]
    table = config_table(events.sparkSession, rows, schema)
    scope = in_pattern_set(F.col("source_id"), F.col("__sources")) & in_pattern_set(F.col("kind"), F.col("__kinds"))
    found = events.join(table, "token_name", "left").withColumn("allowed", F.coalesce(scope, F.lit(False)))
    return found.select(*events.columns, "allowed")


def batch_verdicts(
    events: DataFrame,
    tokens: Sequence[TokenScope],
    hard_cap: int = HARD_CAP_BYTES,
    soft_cap: int = SOFT_CAP_BYTES,
) -> DataFrame:
    """One row per batch: reason of its first failing event (null if none).

    ``events`` has batch_id, ord, token_name and arrival time ``at_ms`` besides
    the event columns.  Events over the soft cap count only up to the first
    failing one, where checking stops.
    """
    scoped = with_allowed(
        events.select("batch_id", "ord", "token_name", "at_ms", "source_id", "kind", "semantic"), tokens
    )
    checked = scoped.select(
        "batch_id", "ord", "token_name", "at_ms", "source_id", "allowed",
        semantic_size(F.col("semantic")).alias("size"),
    ).select(
        "*",
        F.when(~F.col("allowed"), "unauthorized")
        .when(F.col("size") > hard_cap, "payload_too_large")
        .alias("event_reason"),
    )
    fail_ord = F.when(F.col("event_reason").isNotNull(), F.col("ord"))
    per_batch = checked.groupBy("batch_id").agg(
        F.first("token_name").alias("token_name"),
        F.min("at_ms").alias("at_ms"),
        F.count("*").alias("events"),
        F.min(fail_ord).alias("fail_ord"),
        F.min_by("event_reason", fail_ord).alias("reason"),
        F.min_by("source_id", fail_ord).alias("source_id"),
        F.count_if((F.col("size") > soft_cap) & F.col("event_reason").isNull()).alias("soft_all"),
    )
    # Soft-cap events behind the first failure are few; only they are looked at
    # a second time.
    late_soft = (
        checked.where((F.col("size") > soft_cap) & F.col("event_reason").isNull())
        .join(per_batch.where("reason is not null").select("batch_id", "fail_ord"), "batch_id")
        .where(F.col("ord") > F.col("fail_ord"))
        .groupBy("batch_id")
        .agg(F.count("*").alias("late"))
    )
    return per_batch.join(late_soft, "batch_id", "left").select(
        "batch_id", "token_name", "at_ms", "events", "reason",
        F.when(F.col("reason").isNotNull(), F.col("source_id")).alias("source_id"),
        (F.col("soft_all") - F.coalesce("late", F.lit(0))).alias("soft_oversize"),
    )


def parse_rate(text: str) -> tuple[int, int]:
    """``N/s``, ``N/m`` or ``N/h`` as (N, nanoseconds per permit)."""
    found = re.fullmatch(r"\s*(\d+)\s*/\s*([smh])\s*", text)
    if found is None or int(found[1]) == 0:
        raise ValueError(f"invalid rate {text!r}: expected N/s, N/m or N/h with N > 0")
    return int(found[1]), max(1, _UNIT_NS[found[2]] // int(found[1]))


def permits(due_ns: int, now_ns: int, wanted: int, burst: int, step_ns: int) -> tuple[int, int]:
    """Permits granted at one instant and the next due time (GCRA)."""
    base = max(due_ns, now_ns)
    granted = max(0, min(wanted, burst - -(-(base - now_ns) // step_ns)))
    return granted, base + granted * step_ns if granted else due_ns


def grants(batches: DataFrame, tokens: Sequence[TokenScope], due: DataFrame | None = None) -> DataFrame:
    """(token_name, at_ms, granted, due_ns): permits of each token and millisecond, and when the next one is due then.

    ``due`` (token_name, due_ns) is where tokens stand from an earlier run.
    """
    rates = {t.name: parse_rate(t.rate_limit) for t in tokens if t.rate_limit}
    per_ms = (
        batches.where(F.col("token_name").isin(list(rates)))
        .groupBy("token_name", "at_ms")
        .agg(F.count("*").alias("wanted"))
    )
    if due is None:
        started = per_ms.withColumn("since", F.lit(""))
    else:
        # as text, for a null among numbers would turn them into floats in pandas
        since = F.coalesce(F.col("due_ns").cast("string"), F.lit("")).alias("since")
        started = per_ms.join(due.select("token_name", "due_ns"), "token_name", "left").select(*per_ms.columns, since)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token, due = None, 0
        for frame in frames:
            granted, dues = [], []
            for name, at_ms, wanted, since in zip(frame.token_name, frame.at_ms, frame.wanted, frame.since):
                if name != token:
                    token, due = name, int(since) if since else at_ms * 1_000_000
                got, due = permits(due, at_ms * 1_000_000, wanted, *rates[name])
                granted.append(got)
                dues.append(due)
            yield frame[["token_name", "at_ms"]].assign(granted=granted, due_ns=dues)

    return (
        started.repartition("token_name")
        .sortWithinPartitions("token_name", "at_ms")
        .mapInPandas(walk, "token_name string, at_ms long, granted long, due_ns long")
    )


def rate_limit(
    batches: DataFrame,
    tokens: Sequence[TokenScope],
    rows_per_range: int = ROWS_PER_RANGE,
    due: DataFrame | None = None,
) -> DataFrame:
    """Add ``allowed``: does the batch get a permit of its token?

    ``batches`` has batch_id, token_name and at_ms.  The rule is sequential per
    token, so a task walks a token in time order, but only over its distinct
    milliseconds with their counts (a partial aggregate, however many batches
    share them) and with one number of state; no group is held in memory.
    Which batches of a millisecond win goes by batch_id.
    """
    limited = F.col("token_name").isin([t.name for t in tokens if t.rate_limit])
    granted = grants(batches, tokens, due).select("token_name", "at_ms", "granted")
    ranked = running_totals(
        batches.where(limited),
        ["token_name", "at_ms"],
        ["batch_id"],
        {"__n": F.lit(1)},
        rows_per_range=rows_per_range,
    )
    decided = ranked.join(granted, ["token_name", "at_ms"]).select(
        *batches.columns, (F.col("__n") <= F.col("granted")).alias("allowed")
    )
    free = batches.where(~limited | F.col("token_name").isNull())
    return decided.unionByName(free.withColumn("allowed", F.lit(True)))


def admit_batches(
    events: DataFrame,
    tokens: Sequence[TokenScope],
    hard_cap: int = HARD_CAP_BYTES,
    soft_cap: int = SOFT_CAP_BYTES,
    limit_rates: bool = False,
    due: DataFrame | None = None,
    keep: Keep = as_is,
) -> Admission:
    """Split events by their whole batch's verdict.

    ``due`` says where tokens' rates stand from an earlier run (`grants`); ``keep`` stores the verdicts, which
    otherwise are found anew for whatever reads them.
    Only refused batches travel to the events, as an anti and an inner join on
    batch_id, which adaptive execution splits when one batch is very large.
    """
    verdicts = keep(batch_verdicts(events, tokens, hard_cap, soft_cap), "verdicts")
    if limit_rates:
        passed = rate_limit(
            verdicts.where("reason is null").select("batch_id", "token_name", "at_ms"), tokens, due=due
        )
        slowed = passed.where("not allowed").select("batch_id", F.lit(True).alias("slowed"))
        verdicts = (
            verdicts.join(slowed, "batch_id", "left")
            .withColumn("reason", F.when(F.col("slowed"), "rate_limit").otherwise(F.col("reason")))
            .drop("slowed")
        )
        verdicts = keep(verdicts, "audit")
    refused = verdicts.where("reason is not null").select("batch_id", "reason")
    return Admission(
        accepted=events.join(refused, "batch_id", "left_anti"),
        rejected=events.join(refused, "batch_id"),
        audit=verdicts,
    )


def size_audit(
    events: DataFrame, hard_cap: int = HARD_CAP_BYTES, soft_cap: int = SOFT_CAP_BYTES
) -> DataFrame:
    """Per source: events, estimated and serialised bytes, events over each cap."""
    sized = events.select(
        "source_id",
        semantic_size(F.col("semantic")).alias("size"),
        F.octet_length("semantic").alias("stored"),
    )
    return sized.groupBy("source_id").agg(
        F.count("*").alias("events"),
        F.sum("size").alias("estimated_bytes"),
        F.sum("stored").alias("json_bytes"),
        F.count_if(F.col("size") > soft_cap).alias("over_soft"),
        F.count_if(F.col("size") > hard_cap).alias("over_hard"),
    )
