"""Schemas of the tables and the small request objects.

An event's ``arrival`` column holds the order in which events reached the
system as data, because a DataFrame has no row order of its own.  ``semantic``
is stored as compact JSON text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

LINK = T.StructType(
    [
        T.StructField("rel", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("mime", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("sha256", T.StringType()),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("source_id", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("ts_ms_utc", T.LongType(), False),
        T.StructField("semantic", T.StringType(), False),
        T.StructField("links", T.ArrayType(LINK)),
        T.StructField("trace_id", T.StringType()),
        T.StructField("ingest_ts_ms_utc", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("producer_id", T.StringType()),
        T.StructField("schema_invalid", T.BooleanType()),
    ]
)

EVENT_COLUMNS = EVENT.fieldNames()

VECTOR = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("source_id", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("ts_ms_utc", T.LongType(), False),
        T.StructField("truncated", T.BooleanType(), False),
        T.StructField("model_id", T.StringType(), False),
        T.StructField("vector", T.ArrayType(T.FloatType()), False),
    ]
)

SOURCE = T.StructType(
    [
        T.StructField("source_id", T.StringType(), False),
        T.StructField("kinds", T.ArrayType(T.StringType()), False),
        T.StructField("description", T.StringType()),
        T.StructField("usage", T.StringType()),
        T.StructField("caveats", T.StringType()),
        T.StructField("semantic_schema", T.StringType()),
        T.StructField("units", T.StringType()),
        T.StructField("sampling_hint_ms", T.LongType()),
        T.StructField("freshness_ttl_ms", T.LongType()),
        T.StructField("location", T.StringType()),
        T.StructField("embed", T.BooleanType()),
        T.StructField("ord", T.IntegerType(), False),
    ]
)

KIND = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("version", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("usage", T.StringType()),
        T.StructField("caveats", T.StringType()),
        T.StructField("semantic_schema", T.StringType()),
        T.StructField("units", T.StringType()),
        T.StructField("embed", T.BooleanType()),
        T.StructField("ord", T.IntegerType(), False),
    ]
)

# Caps and defaults of the four read questions and of ingest.
MAX_WINDOW_LIMIT = 10_000
DEFAULT_SEARCH_LIMIT = 10
HARD_CAP_BYTES = 64 * 1024
SOFT_CAP_BYTES = 16 * 1024
RING_MAX_EVENTS = 256
RING_MAX_AGE_MS = 60_000
EMBED_DIM = 64
COSTLY_SWEEP_ROWS = 1_000


@dataclass(frozen=True)
class Anchor:
    """Last row of a page; the next page starts after it."""

    ts_ms_utc: int
    event_id: str


@dataclass(frozen=True)
class WindowFilter:
    start_ms: int
    end_ms: int
    sources: tuple[str, ...] | None = None
    kinds: tuple[str, ...] | None = None
    limit: int | None = None

    @property
    def page_size(self) -> int:
        """Rows of one page, which are brought to the caller; scans without pages have no cap."""
        if self.limit is None:
            return MAX_WINDOW_LIMIT
        return min(self.limit, MAX_WINDOW_LIMIT)


@dataclass(frozen=True)
class VectorFilter:
    start_ms: int | None = None
    end_ms: int | None = None
    sources: tuple[str, ...] | None = None
    kinds: tuple[str, ...] | None = None


@dataclass(frozen=True)
class TokenScope:
    """What one producer token may write, and how often."""

    name: str
    allow_sources: tuple[str, ...] = ()
    allow_kinds: tuple[str, ...] = ()
    rate_limit: str | None = None


@dataclass(frozen=True)
class RetentionPolicy:
    match_source_id: str | None = None
    match_kind: str | None = None
    max_age_ms: int | None = None
    max_count: int | None = None
    max_bytes: int | None = None
    vector_max_age_ms: int | None = None


@dataclass(frozen=True)
class Subscription:
    topic_filter: str
    source_template: str
    kind: str | None = None
    kind_field: str | None = None
    payload: str = "json"


@dataclass(frozen=True)
class Peer:
    """Another site's published result table; ``wait_ms`` is how long to wait for it, if not as long as for others."""

    peer_id: str
    path: str
    fmt: str = "parquet"
    options: dict = field(default_factory=dict)
    wait_ms: int | None = None
