"""The stored event log: Parquet files by day, first write wins.

The live files are those that the newest version lists (`sources.versions`), so an append or a sweep is there
as a whole or not at all, and neither loses what another one adds meanwhile.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions.scalars import day_of
from eventlens.model import EVENT, RetentionPolicy
from eventlens.operators.retention import PAIR, classify
from eventlens.session import run_folder
from eventlens.sources import versions

LOG_SCHEMA = T.StructType([*EVENT.fields, T.StructField("day", T.DateType())])
STORED = LOG_SCHEMA.fieldNames()


def read_log(spark: SparkSession, path: str, days: Sequence[str] | None = None) -> DataFrame:
    """The log, or an empty one where nothing has been written yet; with ``days`` the files of these alone."""
    base = versions.snapshot(spark, path)
    if base.version:
        return versions.read_files(spark, path, base.of_rows(days), LOG_SCHEMA)
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


def first_writes(events: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """One row per event_id, the first to arrive.

    Ranked per input partition before the shuffle, so that an id with very many
    copies sends one row per partition.
    """
    rank = F.row_number().over(
        Window.partitionBy("event_id").orderBy(*[F.col(c).asc() for c in arrival])
    )
    return events.withColumn("__n", rank).where("__n = 1").drop("__n")


def new_events(events: DataFrame, log: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Rows an append adds: first writes whose id is not stored yet.

    The stored side is first reduced to the ids at hand; for a micro-batch that
    is a scan of one column with the small side broadcast by its size.
    """
    fresh = first_writes(events, arrival)
    seen = log.select("event_id").join(events.select("event_id"), "event_id", "left_semi")
    return fresh.join(seen, "event_id", "left_anti")


def append_events(
    events: DataFrame, path: str, arrival: Sequence[str] = ("ingest_ts_ms_utc", "event_id")
) -> int:
    """Append events not stored yet; how many were added.  Running it again changes nothing.

    Stored ids are looked up in the id files of the batch's own slots.  If
    another writer commits first, the batch is looked up again.
    """
    spark = events.sparkSession
    while True:
        base = versions.adopt(spark, path, LOG_SCHEMA)
        fresh = first_writes(events, arrival)
        if base.version:
            fresh = fresh.join(versions.stored_ids(spark, path, base, events), "event_id", "left_anti")
        ready = (
            fresh.withColumn("ingest_ts_ms_utc", F.coalesce("ingest_ts_ms_utc", "ts_ms_utc"))
            .withColumn("day", day_of(F.col("ts_ms_utc")))
            .select(*STORED)
        )
        rows = versions.stage_rows(versions.ordered(ready), path, LOG_SCHEMA)
        if not rows:
            return 0
        added = versions.read_files(spark, path, rows, LOG_SCHEMA).select("event_id", "day")
        ids = versions.stage_ids(added, path)
        try:
            versions.commit(spark, path, base, [*rows, *ids])
            return sum(f.rows for f in rows)
        except versions.Conflict:
            versions.discard(spark, path, [*rows, *ids])


def lookup(spark: SparkSession, path: str, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Stored events with the given ids.

    The ids' own slots say on which days they are; only files of those days are read.
    """
    if not isinstance(ids, DataFrame):
        ids = spark.createDataFrame([(i,) for i in ids], "event_id string")
    base = versions.snapshot(spark, path)
    if not base.version:
        return get_by_id(read_log(spark, path), ids)
    wanted = ids.select("event_id").distinct()
    held = versions.stored_ids(spark, path, base, wanted)
    days = [r[0] for r in held.select(F.col("day").cast("string")).distinct().collect()]
    log = versions.read_files(spark, path, base.of_rows(days), LOG_SCHEMA)
    return log.join(wanted, "event_id", "left_semi")


def get_by_id(log: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Events with the given ids: a pushed-down filter, or a join for a table."""
    if isinstance(ids, DataFrame):
        return log.join(ids.select("event_id").distinct(), "event_id", "left_semi")
    return log.where(F.col("event_id").isin(list(ids)))


def count_events(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("n"))


def count_pair(log: DataFrame, source_id: str, kind: str) -> DataFrame:
    wanted = (F.col("source_id") == source_id) & (F.col("kind") == kind)
    return log.where(wanted).agg(F.count("*").alias("n"))


def distinct_pairs(log: DataFrame) -> DataFrame:
    return log.select(*PAIR).distinct().orderBy(*PAIR)


def sweep_log(
    spark: SparkSession, path: str, policies: Sequence[RetentionPolicy], now_ms: int
) -> DataFrame:
    """Remove expired events from the stored log; returns counts per day.

    Files without a drop stay, files that expire as a whole are not read again, the others are written anew
    without the dropped rows, and one new version makes the switch.  Days that every
    policy lets expire are dropped without looking at their rows.  What is appended meanwhile stays; if another
    sweep was first, this one starts over.  The counts are per calendar day, hence a small table.
    """
    while True:
        base = versions.adopt(spark, path, LOG_SCHEMA)
        expired = _expired_days(base, policies, now_ms)
        kept_days = [f for f in base.of_rows() if f.first_day not in expired]
        log = versions.read_files(spark, path, kept_days, LOG_SCHEMA)
        located = log.select("*", F.col(versions.FILE).alias("file")) if kept_days else log.withColumn("file", F.lit(""))
        dropped = classify(located, policies, now_ms).where("drop_reason is not null")
        gone_path = run_folder(spark, "sweep")
        dropped.select("event_id", "day", "file").write.parquet(gone_path)
        gone = spark.read.parquet(gone_path)
        per_file = versions.by_file(kept_days, gone.groupBy("file").count())
        counts: dict[str, list[int]] = {}
        for f in base.of_rows():
            day = counts.setdefault(f.first_day, [0, 0])
            day[0] += f.rows
            day[1] += f.rows if f.first_day in expired else per_file[f.path]
        told = [(day, n, lost) for day, (n, lost) in sorted(counts.items()) if lost]
        if told:
            change = versions.without(spark, path, base, LOG_SCHEMA, gone, per_file, sorted(expired))
            try:
                versions.commit(spark, path, base, change.added, change.removed, rebase=True)
            except versions.Conflict:
                versions.discard(spark, path, change.added)
                continue
            versions.discard(spark, path, change.removed)
        rows = spark.createDataFrame(told, "day string, events long, dropped long")
        return rows.withColumn("day", F.col("day").cast("date"))


def _expired_days(base: versions.Snapshot, policies: Sequence[RetentionPolicy], now_ms: int) -> set[str]:
    """Days of which every row is too old whatever its pair: a policy for all pairs sets an age, and the day
    ends before the cutoff of the policy that keeps events longest."""
    ages = [p.max_age_ms for p in policies if p.max_age_ms is not None]
    if not any(p.max_age_ms is not None and p.match_source_id is None and p.match_kind is None for p in policies):
        return set()
    cutoff = now_ms - max(ages)
    days = sorted({f.first_day for f in base.of_rows()})
    return {d for d in days if (date.fromisoformat(d) - date(1970, 1, 1)).days * 86_400_000 + 86_400_000 <= cutoff}
