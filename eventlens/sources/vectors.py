"""The stored vector index: Parquet files by day, last write wins.

The live files are those that the newest version lists (`sources.versions`); it also says of which model and
width all its vectors are, so that loading need not look at them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions.scalars import day_of
from eventlens.model import VECTOR, RetentionPolicy
from eventlens.operators.retention import expired_vectors
from eventlens.session import run_folder
from eventlens.sources import versions

STORED = T.StructType([*VECTOR.fields, T.StructField("day", T.DateType())])


class IndexMismatch(ValueError):
    """The stored vectors come from another model or have another width."""


def _read(spark: SparkSession, path: str) -> DataFrame:
    base = versions.snapshot(spark, path)
    if base.version:
        return versions.read_files(spark, path, base.of_rows(), STORED)
    try:
        return spark.read.schema(STORED).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)


def check_vectors(vectors: DataFrame, model_id: str, dim: int) -> None:
    """Refuse vectors of another model or width, looking at every row."""
    width = F.size("vector")
    odd = vectors.where((F.col("model_id") != model_id) | (width != dim))
    found = odd.select("model_id", width.alias("dim")).limit(1).collect()
    if found:
        raise IndexMismatch(
            f"expected {model_id} with {dim} values, "
            f"found {found[0]['model_id']} with {found[0]['dim']}"
        )


def load_vectors(spark: SparkSession, path: str, model_id: str, dim: int) -> DataFrame:
    """The stored vectors; refused if they are of another model or width."""
    base = versions.snapshot(spark, path)
    if "model_id" in base.facts:
        _check_facts(base, model_id, dim)
        return versions.read_files(spark, path, base.of_rows(), STORED).select(*VECTOR.fieldNames())
    vectors = _read(spark, path)
    check_vectors(vectors, model_id, dim)
    return vectors.select(*VECTOR.fieldNames())


def _check_facts(base: versions.Snapshot, model_id: str, dim: int) -> None:
    if (base.facts["model_id"], base.facts["dim"]) != (model_id, dim):
        raise IndexMismatch(
            f"expected {model_id} with {dim} values, "
            f"found {base.facts['model_id']} with {base.facts['dim']}"
        )


def last_writes(vectors: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """One row per event_id, the last to arrive."""
    rank = F.row_number().over(
        Window.partitionBy("event_id").orderBy(*[F.col(c).desc() for c in arrival])
    )
    return vectors.withColumn("__n", rank).where("__n = 1").drop("__n")


def upsert(stored: DataFrame, added: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """The index after writing ``added``: new rows replace stored ones."""
    latest = last_writes(added, arrival)
    kept = stored.join(latest.select("event_id"), "event_id", "left_anti")
    return kept.unionByName(latest.select(*stored.columns))


def append_vectors(
    vectors: DataFrame, path: str, model_id: str, dim: int, arrival: Sequence[str]
) -> None:
    """Upsert by event_id.

    Stored ids are looked up in the id files of the batch's own slots.  Only files that hold a replaced vector
    are written anew, without it, and one new version shows the old ones gone and all new vectors there.
    """
    spark = vectors.sparkSession
    check_vectors(vectors, model_id, dim)
    facts = {"model_id": model_id, "dim": dim}
    columns = STORED.fieldNames()
    while True:
        base = _adopted(spark, path, model_id, dim)
        added = last_writes(vectors, arrival).withColumn("day", day_of(F.col("ts_ms_utc")))
        rows = versions.stage_rows(versions.ordered(added.select(*columns)), path, STORED)
        if not rows:
            return
        fresh = versions.read_files(spark, path, rows, STORED).select("event_id", "day")
        change = versions.Change([], [])
        if base.version:
            replaced = versions.stored_ids(spark, path, base, fresh)
            days = [r[0] for r in replaced.select(F.col("day").cast("string")).distinct().collect()]
            if days:
                change = _without(spark, path, base, replaced, base.of_rows(days))
        ids = versions.stage_ids(fresh, path)
        try:
            versions.commit(spark, path, base, [*rows, *ids, *change.added], change.removed, facts)
        except versions.Conflict:
            versions.discard(spark, path, [*rows, *ids, *change.added])
            continue
        versions.discard(spark, path, change.removed)
        return


def _adopted(spark: SparkSession, path: str, model_id: str, dim: int) -> versions.Snapshot:
    base = versions.snapshot(spark, path)
    if not base.version:
        check_vectors(_read(spark, path), model_id, dim)
        base = versions.adopt(spark, path, STORED, {"model_id": model_id, "dim": dim})
    if base.version:
        _check_facts(base, model_id, dim)
    return base


def _without(
    spark: SparkSession, path: str, base: versions.Snapshot, gone: DataFrame, files: Sequence[versions.DataFile]
) -> versions.Change:
    """Files without the vectors ``gone``, which are in some of ``files``."""
    located = versions.read_files(spark, path, files, STORED).select("event_id", F.col(versions.FILE).alias("file"))
    hit = located.join(gone.select("event_id"), "event_id", "left_semi").groupBy("file").count()
    return versions.without(spark, path, base, STORED, gone, versions.by_file(files, hit))


def sweep_vectors(
    spark: SparkSession, path: str, policies: Sequence[RetentionPolicy], now_ms: int
) -> int:
    """Remove expired vectors; returns how many.  Vectors written meanwhile stay."""
    while True:
        base = versions.adopt(spark, path, STORED)
        if not base.version:
            return 0
        stored = versions.read_files(spark, path, base.of_rows(), STORED).drop("vector")
        gone_path = run_folder(spark, "sweep")
        expired_vectors(stored, policies, now_ms).select("event_id", "day").write.parquet(gone_path)
        gone = spark.read.parquet(gone_path)
        per_day = {r["day"]: r["count"] for r in gone.groupBy(F.col("day").cast("string").alias("day")).count().collect()}
        if not per_day:
            return 0
        change = _without(spark, path, base, gone, base.of_rows(per_day))
        try:
            versions.commit(spark, path, base, change.added, change.removed, rebase=True)
        except versions.Conflict:
            versions.discard(spark, path, change.added)
            continue
        versions.discard(spark, path, change.removed)
        return sum(per_day.values())
