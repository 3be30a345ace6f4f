"""Tables of Parquet files of which numbered versions list the live ones.

A writer stages its files where no version names them, then creates the next version, which succeeds for one
writer only; until then readers see the table as it was, and a writer that fails leaves it
so. A version holds what was added and removed, every 32nd the whole list. Files are never changed: rows are
removed by writing the rest of their files anew.

Beside its rows a table keeps where each event_id is: small files of (event_id, day), dealt by the day that an
id's time digits name and by hash (`id_slot`). A batch reads the id files of its own slots only.

The driver handles lists of files, never of rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions.scalars import day_of, id_time_ms

IDS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("id_day", T.DateType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)
#: Id files of one day, by hash.
BUCKETS = 16
#: Every so many versions list all live files.
WHOLE_EVERY = 32
FILE = "_metadata.file_path"


class Conflict(RuntimeError):
    """Another writer was first and the change does not fit what it left."""


@dataclass(frozen=True)
class DataFile:
    """A live file; ``slot`` is the (day, bucket) of an id file and null for rows."""

    path: str
    rows: int
    first_day: str
    last_day: str
    slot: str | None = None


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    files: dict[str, DataFile] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)

    def of_rows(self, days: Iterable[str] | None = None) -> list[DataFile]:
        wanted = None if days is None else set(days)
        rows = [f for f in self.files.values() if f.slot is None]
        return [f for f in rows if wanted is None or f.first_day in wanted]

    def of_ids(self) -> list[DataFile]:
        return [f for f in self.files.values() if f.slot is not None]


# --- the store's files ---------------------------------------------------------


def _place(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _whole_name(spark: SparkSession, path: str) -> str:
    """The path as listings give it, with its scheme."""
    target, fs = _place(spark, path)
    return target.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


def _names(spark: SparkSession, folder: str) -> list[str]:
    target, fs = _place(spark, folder)
    if not fs.exists(target):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(target))


def _read_json(spark: SparkSession, path: str) -> dict:
    target, fs = _place(spark, path)
    stream = fs.open(target)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, value: dict) -> bool:
    """Write a file that nobody else has written; false if somebody has.

    The text goes to a name of its own first; the rename without overwriting is what decides.
    """
    draft = f"{path}.{uuid.uuid4().hex}"
    source, fs = _place(spark, draft)
    stream = fs.create(source, False)
    try:
        stream.write(bytearray(json.dumps(value).encode()))
    finally:
        stream.close()
    target, _ = _place(spark, path)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(source, target, no_options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        fs.delete(source, False)
        return False
    return True


# --- versions -------------------------------------------------------------------


def is_versioned(spark: SparkSession, path: str) -> bool:
    return bool(_versions(spark, path))


def _versions(spark: SparkSession, path: str) -> list[str]:
    return [name for name in _names(spark, f"{path}/_versions") if name.endswith(".json")]


def snapshot(spark: SparkSession, path: str, at: int | None = None) -> Snapshot:
    """The table as its newest version lists it, or the version ``at``; version 0 where nothing has been written."""
    names = _versions(spark, path) if at is None else []
    newest = int(names[-1].removesuffix(".json")) if names else at or 0
    if not newest:
        return Snapshot()
    whole = newest - newest % WHOLE_EVERY
    files: dict[str, DataFile] = {}
    facts: dict = {}
    for number in range(max(1, whole), newest + 1):
        told = _read_json(spark, f"{path}/_versions/{number:020d}.json")
        if number == whole:
            files = {}
        for name in told["removed"]:
            files.pop(name, None)
        files |= {f["path"]: DataFile(**f) for f in told["added"]}
        facts |= told["facts"]
    return Snapshot(newest, files, facts)


def commit(
    spark: SparkSession,
    path: str,
    base: Snapshot,
    added: Sequence[DataFile],
    removed: Sequence[DataFile] = (),
    facts: dict | None = None,
    rebase: bool = False,
) -> Snapshot:
    """Create the version after ``base``.

    If another writer was first: with ``rebase`` the change is put on top of that version, unless a file to be
    removed is no longer live; else it is a conflict, and the caller starts over.
    """
    while True:
        if any(f.path not in base.files for f in removed):
            raise Conflict(f"files to be replaced in {path} have been replaced by another writer")
        files = {p: f for p, f in base.files.items() if p not in {r.path for r in removed}}
        files |= {f.path: f for f in added}
        number, known = base.version + 1, base.facts | (facts or {})
        full = number % WHOLE_EVERY == 0
        told = {
            "added": [asdict(f) for f in (files.values() if full else added)],
            "removed": [] if full else [f.path for f in removed],
            "facts": known if full else facts or {},
        }
        if _create(spark, f"{path}/_versions/{number:020d}.json", told):
            return Snapshot(number, files, known)
        if not rebase:
            raise Conflict(f"version {number} of {path} was created by another writer")
        base = snapshot(spark, path)


# --- files ----------------------------------------------------------------------


def read_files(spark: SparkSession, path: str, files: Sequence[DataFile], schema: T.StructType) -> DataFrame:
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{f.path}" for f in files])


def read_ids(spark: SparkSession, path: str, files: Sequence[DataFile]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], IDS)
    return spark.read.schema(IDS).option("basePath", f"{path}/_ids").parquet(*[f"{path}/{f.path}" for f in files])


def stage(frame: DataFrame, path: str, below: str, by: Sequence[str]) -> list[str]:
    """Write files that no version names yet; their places below ``path``."""
    spark, token = frame.sparkSession, uuid.uuid4().hex
    staged = f"{path}/_staged/{token}"
    writer = frame.write.partitionBy(*by)
    if below:
        writer = writer.option("parquet.bloom.filter.enabled#event_id", "true")
    writer.parquet(staged)
    root, fs = _place(spark, staged)
    start = len(_whole_name(spark, staged)) + 1
    listing, names = fs.listFiles(root, True), []
    while listing.hasNext():
        name = listing.next().getPath().toString()[start:]
        if name.endswith(".parquet"):
            folder, _, file = name.rpartition("/")
            names.append((name, f"{below}{folder}/{token[:8]}-{file}"))
    for folder in {new.rpartition("/")[0] for _, new in names}:
        fs.mkdirs(_place(spark, f"{path}/{folder}")[0])
    for name, new in names:
        if not fs.rename(_place(spark, f"{staged}/{name}")[0], _place(spark, f"{path}/{new}")[0]):
            raise OSError(f"{staged}/{name} could not be moved to {path}/{new}")
    fs.delete(root, True)
    return [new for _, new in names]


def short(file: str) -> str:
    """A file's name with its folder, which names it within a table's rows or ids of one slot's day."""
    return "/".join(file.split("/")[-3:]) if "/bucket=" in file else "/".join(file.split("/")[-2:])


def _sizes(frame: DataFrame, *more: Column) -> dict[str, tuple]:
    """Per file its rows and further aggregates."""
    rows = frame.groupBy(F.col(FILE).alias("file")).agg(F.count("*"), *more).collect()
    return {short(r["file"]): tuple(r)[1:] for r in rows}


def by_file(files: Sequence[DataFile], counted: DataFrame) -> dict[str, int]:
    """Numbers per file name (``file``, ``count``) as numbers per listed file."""
    found = {short(r["file"]): r["count"] for r in counted.collect()}
    return {f.path: found.get(short(f.path), 0) for f in files}


def stage_rows(frame: DataFrame, path: str, schema: T.StructType) -> list[DataFile]:
    """Files of rows by ``day``, not yet live."""
    spark = frame.sparkSession
    names = stage(frame, path, "", ["day"])
    if not names:
        return []
    draft = [DataFile(n, 0, "", "") for n in names]
    sizes = _sizes(read_files(spark, path, draft, schema))
    days = {n: n.split("/")[0].removeprefix("day=") for n in names}
    return [DataFile(n, sizes.get(short(n), (0,))[0], days[n], days[n]) for n in names]


def id_slot(event_id: Column) -> tuple[Column, Column]:
    """The day that the id's time digits name, null if there are none, and its bucket of that day."""
    return day_of(id_time_ms(event_id)), F.pmod(F.xxhash64(event_id), F.lit(BUCKETS)).cast("int")


def stage_ids(rows: DataFrame, path: str) -> list[DataFile]:
    """Files of (event_id, day) by slot, not yet live."""
    day, bucket = id_slot(F.col("event_id"))
    keyed = rows.select("event_id", "day", day.alias("id_day"), bucket.alias("bucket"))
    sorted_rows = keyed.repartition("id_day", "bucket").sortWithinPartitions("id_day", "bucket", "event_id")
    names = stage(sorted_rows, path, "_ids/", ["id_day", "bucket"])
    if not names:
        return []
    draft = [DataFile(n, 0, "", "", "") for n in names]
    sizes = _sizes(read_ids(rows.sparkSession, path, draft), F.min("day").cast("string"), F.max("day").cast("string"))
    files = []
    for name in names:
        n, first, last = sizes.get(short(name), (0, None, None))
        slot = "/".join(part.rpartition("=")[2] for part in name.split("/")[1:-1])
        files.append(DataFile(name, n, str(first or ""), str(last or ""), slot))
    return files


def discard(spark: SparkSession, path: str, files: Iterable[DataFile | str]) -> None:
    """Delete files that are in no version any more, and folders that are empty then."""
    folders = set()
    for name in (f if isinstance(f, str) else f.path for f in files):
        target, fs = _place(spark, f"{path}/{name}")
        fs.delete(target, False)
        folders.add(name.rpartition("/")[0])
    for folder in folders:
        target, fs = _place(spark, f"{path}/{folder}")
        if fs.exists(target) and not fs.listStatus(target):
            fs.delete(target, False)


# --- ids ------------------------------------------------------------------------


def id_files(spark: SparkSession, base: Snapshot, ids: DataFrame) -> list[DataFile]:
    """The live id files that can hold any of the ids; their slots come to the driver, not the ids."""
    day, bucket = id_slot(F.col("event_id"))
    files = base.of_ids()
    if not files:
        return []
    told = F.concat_ws("/", F.coalesce(day.cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")), bucket.cast("string"))
    slots = {r[0] for r in ids.select(told.alias("slot")).distinct().collect()}
    return [f for f in files if f.slot in slots]


def stored_ids(spark: SparkSession, path: str, base: Snapshot, ids: DataFrame) -> DataFrame:
    """(event_id, day) of those of ``ids`` that are stored."""
    wanted = ids.select("event_id")
    held = read_ids(spark, path, id_files(spark, base, wanted)).select("event_id", "day")
    return held.join(wanted, "event_id", "left_semi")


def adopt(spark: SparkSession, path: str, schema: T.StructType, facts: dict | None = None) -> Snapshot:
    """The newest version; a plain folder by day becomes version 1, its files staying where they are."""
    base = snapshot(spark, path)
    if base.version or not any(name.startswith("day=") for name in _names(spark, path)):
        return base
    plain = spark.read.schema(schema).parquet(path)
    found = plain.groupBy(F.col(FILE).alias("file")).agg(F.count("*").alias("n")).collect()
    files = []
    for row in found:
        name = short(row["file"])
        day = name.split("/")[0].removeprefix("day=")
        files.append(DataFile(name, row["n"], day, day))
    ids = stage_ids(plain.select("event_id", "day"), path)
    try:
        return commit(spark, path, base, [*files, *ids], facts=facts)
    except Conflict:
        discard(spark, path, ids)
        return snapshot(spark, path)


# --- removing rows ----------------------------------------------------------------


@dataclass(frozen=True)
class Change:
    added: list[DataFile]
    removed: list[DataFile]


def without(
    spark: SparkSession,
    path: str,
    base: Snapshot,
    schema: T.StructType,
    gone: DataFrame,
    per_file: dict[str, int],
    whole_days: Sequence[str] = (),
) -> Change:
    """Files to add and to remove so that the rows ``gone`` (event_id, day) are no longer there.

    ``per_file`` has the number of such rows by file. Files that lose all rows, and those of ``whole_days``, are
    not read. Of the ids only the files of the slots concerned are written anew.
    """
    days = set(whole_days)
    rows = base.of_rows()
    whole = [f for f in rows if f.first_day in days or per_file.get(f.path, 0) == f.rows]
    partly = [f for f in rows if f not in whole and per_file.get(f.path, 0)]
    added: list[DataFile] = []
    if partly:
        kept = read_files(spark, path, partly, schema).join(gone.select("event_id"), "event_id", "left_anti")
        added = stage_rows(ordered(kept.select(*schema.fieldNames())), path, schema)
    touched = {f.path: f for f in id_files(spark, base, gone.select("event_id"))} if whole or partly else {}
    touched |= {f.path: f for f in base.of_ids() if any(f.first_day <= d <= f.last_day for d in days)}
    if touched:
        ids = read_ids(spark, path, list(touched.values())).join(gone.select("event_id"), "event_id", "left_anti")
        if days:
            ids = ids.where(~F.col("day").cast("string").isin(sorted(days)))
        added += stage_ids(ids.select("event_id", "day"), path)
    return Change(added, [*whole, *partly, *touched.values()])


def ordered(rows: DataFrame) -> DataFrame:
    """Rows as files should hold them: narrow, sorted time ranges, a busy day spread over several tasks."""
    return rows.repartitionByRange("ts_ms_utc", "event_id").sortWithinPartitions("day", "ts_ms_utc", "event_id")
