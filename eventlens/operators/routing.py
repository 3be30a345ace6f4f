"""Messages on topics to producer events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.scalars import parse_marked, strict_value
from eventlens.functions.topics import (
    FORMATS,
    encode_payload,
    payload_text,
    string_at,
    template_pieces,
)
from eventlens.model import Subscription
from eventlens.operators.lookup import config_table


@dataclass(frozen=True)
class Routed:
    events: DataFrame
    failed: DataFrame


def _shape(topic_filter: str) -> tuple[int, tuple[int, ...], bool, str]:
    """Levels before a tail, places of ``+``, whether there is a tail; and the filter up to it."""
    levels = topic_filter.split("/")
    tail = "#" in levels
    if tail:
        levels = levels[: levels.index("#")]
    pluses = tuple(i for i, level in enumerate(levels) if level == "+")
    return len(levels), pluses, tail, "/".join(levels)


def _with_subscription(messages: DataFrame, subs: Sequence[Subscription]) -> DataFrame:
    """Add ``subscription``, the first one whose filter matches the topic.

    A topic matches a filter if it equals the filter once the filter's ``+`` places are ``+`` in it
    too and its tail is cut.  So filters of one shape are a table, looked up by the topic in that
    shape; there are as many joins as shapes, however many subscriptions.
    """
    shapes: dict[tuple, dict[str, int]] = {}
    for i, sub in enumerate(subs):
        *shape, text = _shape(sub.topic_filter)
        shapes.setdefault(tuple(shape), {}).setdefault(text, i)
    columns = messages.columns
    rows = messages.withColumn("__levels", F.split("topic", "/", -1))
    level, found = F.col("__levels"), []
    for n, ((size, pluses, tail), texts) in enumerate(shapes.items()):
        parts = [F.lit("+") if i in pluses else F.get(level, F.lit(i)) for i in range(size)]
        fits = F.size(level) >= size if tail else F.size(level) == size
        key, at = f"__key{n}", f"__at{n}"
        listed = [{key: text, at: i} for text, i in texts.items()]
        table = config_table(messages.sparkSession, listed, f"{key} string, {at} int")
        rows = rows.withColumn(key, F.when(fits, F.concat_ws("/", *parts))).join(table, key, "left").drop(key)
        found.append(F.col(at))
    none = F.lit(None).cast("int")
    return rows.select(*columns, "__levels", F.least(none, none, *found).alias("subscription"))


def _described(sub: Subscription, index: int) -> dict:
    """A subscription's template (literals, level numbers, -1 for the tail) and rules."""
    size, pluses, _, _ = _shape(sub.topic_filter)
    pieces = template_pieces(sub.topic_filter, sub.source_template)
    named = [
        {"text": p, "level": None} if isinstance(p, str) else {"text": None, "level": pluses[p - 1] if p else -1}
        for p in pieces or []
    ]
    return {
        "subscription": index,
        "__pieces": None if pieces is None else named,
        "__size": size,
        "__format": sub.payload,
        "__kind": sub.kind,
        "__path": sub.kind_field if sub.kind is None else None,
    }


def route_outcomes(messages: DataFrame, subs: Sequence[Subscription]) -> DataFrame:
    """Every message with its subscription, event fields and outcome.

    The first subscription whose filter matches is final: when its template,
    decoder or kind rule then fails the message is ``decode_failed``, and no
    later subscription is tried.  What a subscription says comes as columns of a table; only
    payload formats and distinct kind paths are choices in the plan.
    """
    payload, level, form = F.col("payload"), F.col("__levels"), F.col("__format")
    unknown = {sub.payload for sub in subs} - {"json", *FORMATS}
    if unknown:
        raise ValueError(f"unknown payload format {min(unknown)!r}")
    schema = (
        "subscription int, __pieces array<struct<text: string, level: int>>, __size int, "
        "__format string, __kind string, __path string"
    )
    table = config_table(messages.sparkSession, [_described(s, i) for i, s in enumerate(subs)], schema)
    tail = F.array_join(F.slice(level, F.col("__size") + 1, F.size(level)), "/")
    source = F.array_join(
        F.transform(
            "__pieces",
            lambda p: F.when(p["level"].isNull(), p["text"]).when(p["level"] < 0, tail).otherwise(F.get(level, p["level"])),
        ),
        "",
    )
    semantic = F.when(form == "json", F.to_json(F.col("__value")))
    for fmt in FORMATS:
        semantic = semantic.when(form == fmt, encode_payload(fmt, payload))
    node = F.when(form == "json", F.col("__value")).otherwise(F.try_parse_json("semantic"))
    kind = F.when(F.col("__kind").isNotNull(), F.col("__kind"))
    for path in sorted({s.kind_field for s in subs if s.kind is None and s.kind_field is not None}):
        kind = kind.when(F.col("__path") == path, string_at(F.col("__node"), path))
    complete = (
        F.col("source_id").isNotNull() & F.col("semantic").isNotNull() & F.col("kind").isNotNull()
    )
    index = F.col("subscription")
    outcome = F.when(index.isNull(), "unmatched").when(complete, "ok").otherwise("decode_failed")
    return (
        _with_subscription(messages, subs)
        .join(table, "subscription", "left")
        .withColumn("__marked", F.when(form == "json", parse_marked(payload_text(payload))))
        .withColumn("__value", strict_value(F.col("__marked")))
        .withColumns({"source_id": source, "semantic": semantic})
        .withColumn("__node", F.when(F.col("__path").isNotNull(), node))
        .withColumn("kind", kind)
        .withColumn("outcome", outcome)
        .select(*messages.columns, "subscription", "source_id", "semantic", "kind", "outcome")
    )


def _rows_where(rows: DataFrame, cond: Column, columns: dict[str, Column]) -> DataFrame:
    """``rows.where(cond).select(columns)``, with nothing computed twice.

    A filter would be pushed below the projections it looks at, and with it a
    second copy of the decoding; a generator is not.
    """
    fields = F.struct(*[col.alias(name) for name, col in columns.items()])
    return rows.select(F.inline(F.when(cond, F.array(fields))))


def route_messages(messages: DataFrame, subs: Sequence[Subscription]) -> Routed:
    """Split the outcomes into events and messages that gave none.

    Routed events go straight to normalisation: scope, size and rate checks
    belong to producers' requests.
    """
    outcomes = route_outcomes(messages, subs)
    ok = F.col("outcome") == "ok"
    extra = [c for c in messages.columns if c not in ("topic", "payload", "ts_ms")]
    event = {
        "source_id": F.col("source_id"),
        "kind": F.col("kind"),
        "ts_ms_utc": F.col("ts_ms"),
        "semantic": F.col("semantic"),
        **{c: F.col(c) for c in extra},
    }
    failed = {c: F.col(c) for c in [*messages.columns, "subscription", "outcome"]}
    return Routed(_rows_where(outcomes, ok, event), _rows_where(outcomes, ~ok, failed))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("broker_id", "outcome").agg(F.count("*").alias("n"))
