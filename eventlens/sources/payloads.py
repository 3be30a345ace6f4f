"""Producer payloads in, one event per row out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.functions.scalars import parse_marked, strict_value
from eventlens.functions.variants import is_type, keys, member
from eventlens.model import LINK

# The fields a producer's event may have.
REQUIRED_FIELDS = ["source_id", "kind", "ts_ms_utc", "semantic"]
OPTIONAL_FIELDS = ["event_id", "links", "trace_id", "producer_id"]
LINK_FIELDS = ["rel", "uri", "mime", "bytes", "sha256"]

_ID = "^[0-7][0-9A-HJKMNP-TV-Z]{25}$"


@dataclass(frozen=True)
class Parsed:
    events: DataFrame
    rejected: DataFrame


def read_payloads(
    spark: SparkSession,
    fmt: str,
    path: str | None = None,
    *,
    streaming: bool = False,
    body: str | None = None,
    schema: str | None = None,
    **options: str,
) -> DataFrame:
    """Payload texts from files or a message queue, as a batch or a stream.

    ``text`` gives one payload per line (``wholetext`` per file), ``kafka`` the
    message value; for other formats ``body`` names the column.  The columns of
    the source stay next to ``body``.
    """
    reader = (spark.readStream if streaming else spark.read).format(fmt).options(**options)
    if schema:
        reader = reader.schema(schema)
    rows = reader.load(path) if path else reader.load()
    column = body or "value"
    return rows.withColumn("body", F.col(column).cast("string"))


def _text(node: Column, name: str) -> Column:
    field = member(node, name)
    return F.when(is_type(field, "string"), F.try_variant_get(field, "$", "string"))


def _optional(node: Column, name: str, kind: str) -> Column:
    """Absent, JSON null or of the given type."""
    field = member(node, name)
    return field.isNull() | is_type(field, "null") | is_type(field, kind)


def _link_ok(link: Column) -> Column:
    size = F.try_variant_get(member(link, "bytes"), "$", "long")
    return (
        is_type(link, "object")
        & _text(link, "rel").isNotNull()
        & _text(link, "uri").isNotNull()
        & _optional(link, "mime", "string")
        & _optional(link, "sha256", "string")
        & _optional(link, "bytes", "integer")
        & F.coalesce(size >= 0, F.lit(True))
    )


def _event_ok(node: Column) -> Column:
    allowed = F.array(*[F.lit(f) for f in REQUIRED_FIELDS + OPTIONAL_FIELDS])
    links = F.try_variant_get(member(node, "links"), "$", "array<variant>")
    ok = (
        is_type(node, "object")
        & (F.size(F.array_except(keys(node), allowed)) == 0)
        & _text(node, "source_id").isNotNull()
        & _text(node, "kind").isNotNull()
        & is_type(member(node, "ts_ms_utc"), "integer")
        & member(node, "semantic").isNotNull()
        & _optional(node, "trace_id", "string")
        & _optional(node, "producer_id", "string")
        & _optional(node, "event_id", "string")
        & F.coalesce(F.upper(_text(node, "event_id")).rlike(_ID), F.lit(True))
        & _optional(node, "links", "array")
        & F.coalesce(F.forall(links, _link_ok), F.lit(True))
    )
    return F.coalesce(ok, F.lit(False))


def _links(node: Column) -> Column:
    listed = F.try_variant_get(node, "$.links", "array<variant>")
    return F.transform(
        listed,
        lambda link: F.struct(
            *[_text(link, f).alias(f) for f in ("rel", "uri", "mime")],
            F.try_variant_get(link, "$.bytes", "long").alias("bytes"),
            _text(link, "sha256").alias("sha256"),
        ),
    ).cast(f"array<{LINK.simpleString()}>")


def parse_payloads(payloads: DataFrame) -> Parsed:
    """Events of each payload text in column ``body``.

    A payload is an object with ``events``, a bare array or a single event,
    tried in that order.  One unacceptable event, an unknown event field or an
    empty list refuses the whole payload; refused payloads come back with the
    reason.  Other columns are repeated on each event; ``ord`` counts from zero.
    """
    extra = [c for c in payloads.columns if c != "body"]
    node = F.col("__node")
    wrapped = F.try_variant_get(node, "$.events", "array<variant>")
    bare = F.try_variant_get(node, "$", "array<variant>")
    parsed = (
        payloads.withColumn("__marked", parse_marked(F.col("body")))
        .withColumn("__node", strict_value(F.col("__marked")))
        .withColumn(
            "__list",
            F.when(is_type(node, "object") & member(node, "events").isNotNull(), wrapped)
            .when(is_type(node, "array"), bare)
            .when(is_type(node, "object"), F.array(node)),
        )
    )
    items = F.col("__list")
    verdict = parsed.withColumn(
        "reason",
        F.when(node.isNull(), "invalid JSON")
        .when(items.isNull(), "not an event or a list of events")
        .when(F.size(items) == 0, "no events in payload")
        .when(~F.forall(items, _event_ok), "invalid event"),
    )
    # Generators instead of filters: a filter on the verdict would be pushed
    # down together with a second copy of parsing and checking.
    fine = F.col("reason").isNull()
    item = F.col("__item")
    events = verdict.select(
        *extra, F.posexplode(F.when(fine, items)).alias("ord", "__item")
    ).select(
        *extra,
        "ord",
        F.upper(_text(item, "event_id")).alias("event_id"),
        _text(item, "source_id").alias("source_id"),
        _text(item, "kind").alias("kind"),
        F.try_variant_get(item, "$.ts_ms_utc", "long").alias("ts_ms_utc"),
        F.to_json(F.try_variant_get(item, "$.semantic", "variant")).alias("semantic"),
        _links(item).alias("links"),
        _text(item, "trace_id").alias("trace_id"),
        _text(item, "producer_id").alias("producer_id"),
    )
    refused = F.struct(*extra, "body", "reason")
    rejected = verdict.select(F.inline(F.when(~fine, F.array(refused))))
    return Parsed(events, rejected)
