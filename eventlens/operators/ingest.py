"""The whole way in: request bodies to normalised events, and every error on it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.model import HARD_CAP_BYTES, SOFT_CAP_BYTES, TokenScope
from eventlens.operators.admission import Admission, Keep, admit_batches, as_is
from eventlens.operators.health import admission_errors, event_errors
from eventlens.operators.normalize import SchemaBook, normalize
from eventlens.sources.payloads import parse_payloads

#: Order of arrival: requests by time, a request's events as they are in its body.
ARRIVAL = ["at_ms", "batch_id", "ord"]


@dataclass(frozen=True)
class Ingested:
    """What one run lets in, sheds and finds wrong.

    ``errors`` are error-log rows for `health.recent_errors`: refusals by scope, size and rate and failed schema checks.
    """

    events: DataFrame
    admission: Admission
    refused_bodies: DataFrame
    errors: DataFrame


def parsed_events(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of ``bodies`` (batch_id, token_name, at_ms, body), and the bodies that are no payload."""
    parsed = parse_payloads(bodies.select("batch_id", "token_name", "at_ms", "body"))
    return parsed.events, parsed.rejected


def admission_log(admitted: Admission) -> DataFrame:
    """Error-log rows of an admission: the first failing event's source once, or every event of a batch over its rate."""
    slowed = admitted.rejected.where("reason = 'rate_limit'")
    by_batch = admission_errors(admitted.audit.where("reason <> 'rate_limit'"))
    rows = by_batch.select("source_id", "reason", "ts_ms").unionByName(event_errors(slowed, "rate_limit", "at_ms"))
    return rows.groupBy("source_id", "reason").agg(F.count("*").alias("n"), F.max("ts_ms").alias("ts_ms"))


def schema_log(events: DataFrame) -> DataFrame:
    rows = event_errors(events.where("schema_invalid"), "schema_invalid", "ingest_ts_ms_utc")
    return rows.groupBy("source_id", "reason").agg(F.count("*").alias("n"), F.max("ts_ms").alias("ts_ms"))


def ingest(
    bodies: DataFrame,
    tokens: Sequence[TokenScope],
    book: SchemaBook | None = None,
    hard_cap: int = HARD_CAP_BYTES,
    soft_cap: int = SOFT_CAP_BYTES,
) -> Ingested:
    """Parse, admit by scope, size and rate, number, fill and check; one request body is one batch.

    The steps after parsing read its events several times: give this bodies that are stored, and store the
    events where parsing them again costs too much (`streaming.jobs.ingest_sink` does).
    """
    events, refused = parsed_events(bodies)
    return ingest_events(events, refused, tokens, book, hard_cap, soft_cap)


def ingest_events(
    events: DataFrame,
    refused: DataFrame,
    tokens: Sequence[TokenScope],
    book: SchemaBook | None = None,
    hard_cap: int = HARD_CAP_BYTES,
    soft_cap: int = SOFT_CAP_BYTES,
    due: DataFrame | None = None,
    keep: Keep = as_is,
) -> Ingested:
    """`ingest` from events already parsed; ``due`` is where tokens stand from an earlier run.

    ``keep`` stores what several of the later steps read: verdicts, the audit and the normalised events.
    """
    admitted = admit_batches(events, tokens, hard_cap, soft_cap, limit_rates=True, due=due, keep=keep)
    accepted = admitted.accepted.withColumn("ingest_ts_ms_utc", F.col("at_ms"))
    normal = keep(normalize(accepted, ARRIVAL, None, book), "normal")
    return Ingested(normal, admitted, refused, admission_log(admitted).unionByName(schema_log(normal)))
