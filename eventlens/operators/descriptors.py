"""Which sources exist and how healthy they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.globs import glob_filter
from eventlens.model import RetentionPolicy
from eventlens.operators.retention import resolve_retention


def _text(source: Column, kind: Column) -> Column:
    """The source's text unless it is empty, else the kind's, else empty."""
    return F.coalesce(F.nullif(source, F.lit("")), kind, F.lit(""))


def resolve_descriptors(sources: DataFrame, kinds: DataFrame) -> DataFrame:
    """One merged row per source and kind it lists.

    The first declared kind of that exact name counts; a kind nobody declared
    becomes an empty ``v1``.
    """
    columns = [c for c in kinds.columns if c != "name"]
    first = kinds.groupBy(F.col("name").alias("kind")).agg(
        F.min_by(F.struct(*columns), "ord").alias("k")
    )
    listed = sources.select(
        "*", F.posexplode("kinds").alias("kind_ord", "kind")
    ).join(first, "kind", "left")
    return listed.select(
        "source_id",
        "kind",
        F.coalesce("k.version", F.lit("v1")).alias("kind_version"),
        _text(F.col("description"), F.col("k.description")).alias("description"),
        _text(F.col("usage"), F.col("k.usage")).alias("usage"),
        _text(F.col("caveats"), F.col("k.caveats")).alias("caveats"),
        F.coalesce("semantic_schema", "k.semantic_schema").alias("semantic_schema"),
        F.coalesce("units", "k.units").alias("units"),
        "sampling_hint_ms",
        "freshness_ttl_ms",
        "location",
    )


def describe_sources(
    descriptors: DataFrame,
    errors: DataFrame,
    policies: Sequence[RetentionPolicy],
    sources: Sequence[str] | None = None,
    kinds: Sequence[str] | None = None,
) -> DataFrame:
    """Descriptors with the source's error digest and the pair's retention.

    ``errors`` is the output of `health.recent_errors`.
    """
    wanted = descriptors.where(
        glob_filter(F.col("source_id"), sources) & glob_filter(F.col("kind"), kinds)
    )
    limits = ["max_age_ms", "max_count", "max_bytes", "vector_max_age_ms"]
    resolved = resolve_retention(wanted, policies)
    return resolved.join(errors, "source_id", "left").select(
        *descriptors.columns,
        F.when(
            F.col("counters").isNotNull(), F.struct("counters", "last_error_ts_ms_utc")
        ).alias("recent_errors"),
        F.when(F.coalesce(*limits).isNotNull(), F.struct(*limits)).alias("effective_retention"),
        F.lit(None).cast("string").alias("peer_id"),
    )
