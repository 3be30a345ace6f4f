"""Continuous jobs: one query per sink over one stream of events.

Sinks are independent queries with their own checkpoints, so a slow one holds
up none of the others and nothing is dropped between them.  Every sink is
idempotent per micro-batch, which makes a replay after a failure harmless.
Late events are accepted like any others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.internal import InternalFunction
from pyspark.sql.streaming import StreamingQuery

from eventlens.functions.embedding import Embedder, hash_embedder
from eventlens.model import EVENT_COLUMNS, HARD_CAP_BYTES, RING_MAX_AGE_MS, RING_MAX_EVENTS, SOFT_CAP_BYTES, TokenScope
from eventlens.operators.admission import grants, parse_rate
from eventlens.operators.federation import forward_events
from eventlens.operators.ingest import ARRIVAL as INGEST_ARRIVAL
from eventlens.operators.ingest import ingest_events, parsed_events
from eventlens.operators.normalize import SchemaBook, as_events, normalize
from eventlens.operators.search import embed_events, select_for_embedding
from eventlens.session import ROCKSDB_PROVIDER
from eventlens.sources import versions
from eventlens.sources.events_log import append_events
from eventlens.sources.vectors import append_vectors
from eventlens.streaming.processors import RateProcessor

PAIR = ["source_id", "kind"]
ARRIVAL = ("ingest_ts_ms_utc", "event_id")
COMMIT_SCHEMA = (
    "sink string, batch_id long, rows long, truncated long, dropped long, "
    "error string, ts_ms long"
)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def start(
    stream: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    output_mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Run ``sink`` on each micro-batch; without ``every``, on what is there now."""
    writer = (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(sink)
    )
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def logged(
    name: str, commits: str, sink: Callable[[DataFrame, int], dict | None]
) -> Callable[[DataFrame, int], None]:
    """A sink that notes every micro-batch in the commit log.

    A finished batch has one note, which a replay replaces; a failed attempt
    leaves a note of its own and fails the query, to be started again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        try:
            counts = sink(batch, batch_id) or {}
        except Exception as error:
            attempt = f"{name}-{batch_id}-failed-{uuid.uuid4().hex}"
            text = str(error).splitlines()[0][:500] or type(error).__name__
            _note(batch, f"{commits}/part={attempt}", name, batch_id, error=text)
            raise
        _note(batch, f"{commits}/part={name}-{batch_id}", name, batch_id, **counts)

    return write


def _note(batch: DataFrame, path: str, sink: str, batch_id: int, **values) -> None:
    counts = [
        F.lit(values.get(c, 0)).cast("long").alias(c) for c in ("rows", "truncated", "dropped")
    ]
    row = batch.sparkSession.range(1).select(
        F.lit(sink).alias("sink"),
        F.lit(batch_id).cast("long").alias("batch_id"),
        *counts,
        F.lit(values.get("error")).cast("string").alias("error"),
        F.unix_millis(F.current_timestamp()).alias("ts_ms"),
    )
    row.coalesce(1).write.mode("overwrite").parquet(path)


def read_commits(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.schema(f"{COMMIT_SCHEMA}, part string").parquet(log_path).drop("part")


# --- log, vectors, hub -------------------------------------------------------


def _counted(batch: DataFrame) -> tuple[DataFrame, Observation]:
    """The batch, and its number of rows as measured by the first job that reads it."""
    seen = Observation()
    return batch.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def log_sink(path: str) -> Callable[[DataFrame, int], dict]:
    """Append each micro-batch to the event log, first write per id."""

    def write(batch: DataFrame, batch_id: int) -> dict:
        rows, seen = _counted(batch)
        append_events(rows, path)
        return {"rows": seen.get["rows"]}

    return write


def embed_sink(
    path: str,
    sources: DataFrame,
    kinds: DataFrame,
    embedder: Embedder | None = None,
    max_bytes: int | None = None,
) -> Callable[[DataFrame, int], dict]:
    """Embed the selected events of each micro-batch; of an id the last to arrive stays.

    The batch is embedded once: into a table of its own for this batch, from
    which the index is then updated.
    """
    model = embedder or hash_embedder()

    def write(batch: DataFrame, batch_id: int) -> dict:
        chosen = select_for_embedding(batch, sources, kinds)
        staged = f"{path}-staged/batch={batch_id}"
        rows = embed_events(chosen, model, max_bytes, keep=["ingest_ts_ms_utc"])
        rows.write.mode("overwrite").parquet(staged)
        embedded = batch.sparkSession.read.parquet(staged)
        append_vectors(embedded, path, model.model_id, model.dim, ["ingest_ts_ms_utc", "ts_ms_utc"])
        seen = embedded.agg(F.count("*"), F.count_if("truncated")).first()
        return {"rows": seen[0], "truncated": seen[1]}

    return write


def forward_sink(path: str, peer_id: str) -> Callable[[DataFrame, int], dict]:
    """Write each micro-batch for the hub, one directory per batch.

    A replayed batch replaces its directory; the hub drops ids it has already.
    """

    def write(batch: DataFrame, batch_id: int) -> dict:
        rows, seen = _counted(batch)
        forward_events(rows, peer_id).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}"
        )
        return {"rows": seen.get["rows"]}

    return write


# --- normalisation -----------------------------------------------------------


def _bucket() -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(versions.BUCKETS * 4)).cast("int")


#: Numbers by key that only grow: a source's last sequence number, when a token's next permit is due.
_COUNTERS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)
#: Files of a bucket of counters that are read together before one takes their place.
_MERGE_AT = 16


@dataclass(frozen=True)
class _Counters:
    """Numbers by key, as they were before a micro-batch, for the buckets that it touches."""

    base: versions.Snapshot
    files: list[versions.DataFile]
    last: DataFrame


def _counters(spark: SparkSession, folder: str, batch_id: int, keys: DataFrame) -> _Counters:
    """The numbers of ``keys`` (key) and their bucket-mates.

    Taking lost counters for empty ones would number every source from one again, so only the first batch
    may find none. A replayed batch finds what it found the first time."""
    base = versions.snapshot(spark, folder)
    if base.facts.get("batch", -1) >= batch_id:
        base = versions.snapshot(spark, folder, base.facts["before"])
    if base.facts.get("batch", -1) != batch_id - 1:
        raise RuntimeError(f"the counters before batch {batch_id} are gone from {folder}")
    touched = {str(r[0]) for r in keys.select(_bucket()).distinct().collect()}
    files = [f for f in base.files.values() if f.slot in touched]
    rows = versions.read_files(spark, folder, files, _COUNTERS)
    return _Counters(base, files, rows.groupBy("key").agg(F.max("value").alias("value")))


def _advance(spark: SparkSession, folder: str, batch_id: int, before: _Counters, added: DataFrame) -> None:
    """Note the new numbers (key, value) of the batch's own keys; a bucket of many files is merged on the way."""
    newest = versions.snapshot(spark, folder)
    if newest.facts.get("batch", -1) >= batch_id:
        return  # a replay: the numbers are there
    slots = [f.slot for f in before.files]
    full = [f for f in before.files if slots.count(f.slot) >= _MERGE_AT]
    rows = added.select("key", "value", _bucket().alias("bucket"))
    if full:
        old = versions.read_files(spark, folder, full, _COUNTERS)
        rows = rows.unionByName(old).groupBy("key", "bucket").agg(F.max("value").alias("value"))
    names = versions.stage(rows.select(*_COUNTERS.fieldNames()).repartition("bucket"), folder, "", ["bucket"])
    files = [versions.DataFile(n, 0, "", "", n.split("/")[0].removeprefix("bucket=")) for n in names]
    # files that were merged stay until the next batch, for a replay of this one
    facts = {"batch": batch_id, "before": newest.version, "merged": [f.path for f in full]}
    versions.commit(spark, folder, newest, files, full, facts)
    versions.discard(spark, folder, newest.facts.get("merged", []))


def normalize_sink(
    log_path: str,
    counters_path: str,
    arrival: Sequence[str] = ARRIVAL,
    book: SchemaBook | None = None,
    now_ms: Callable[[], int] | None = None,
    **options: int,
) -> Callable[[DataFrame, int], None]:
    """Normalise each micro-batch and append it to the log.

    Sequence numbers continue from the sources' counters, of which a batch reads the buckets of its own
    sources and writes its own sources only.  A replay finds the counters as they were before the batch and gives
    the same numbers.  Within the batch, numbering is the range-wise one of `normalize`, so one busy source is
    shared by many tasks.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            _normalized(spark, batch, batch_id)
        finally:
            batch.unpersist()

    def _normalized(spark: SparkSession, batch: DataFrame, batch_id: int) -> None:
        ready = _numbered(spark, counters_path, batch_id, batch, lambda: normalize(
            batch, arrival, now_ms() if now_ms else None, book, **options
        ))
        append_events(ready, log_path, arrival)

    return write


def _numbered(
    spark: SparkSession, folder: str, batch_id: int, batch: DataFrame, numbered: Callable[[], DataFrame]
) -> DataFrame:
    """Events of a batch numbered from one per source, with numbers that go on from the batches before."""
    before = _counters(spark, folder, batch_id, batch.select(F.col("source_id").alias("key")))
    last = before.last.select(F.col("key").alias("source_id"), F.col("value").alias("last_seq"))
    counts = batch.groupBy("source_id").agg(F.count("*").alias("n")).join(last, "source_id", "left")
    added = counts.select(F.col("source_id").alias("key"), (F.col("n") + F.coalesce("last_seq", F.lit(0))).alias("value"))
    _advance(spark, folder, batch_id, before, added)
    rows = numbered().join(last, "source_id", "left")
    return rows.withColumn("seq", F.col("seq") + F.coalesce("last_seq", F.lit(0))).drop("last_seq")


def ingest_sink(
    log_path: str,
    state_path: str,
    errors_path: str,
    tokens: Sequence[TokenScope],
    book: SchemaBook | None = None,
    hard_cap: int = HARD_CAP_BYTES,
    soft_cap: int = SOFT_CAP_BYTES,
) -> Callable[[DataFrame, int], None]:
    """The whole way in for each micro-batch of request bodies (batch_id, token_name, at_ms, body).

    Bodies are parsed once, into a table of the micro-batch's own; verdicts, the audit and the normalised events, which
    several steps read, are found once as well. Rates and sequence numbers go on from the
    batches before; errors are written under the batch's number. A replay gives the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = f"{state_path}/parsed/batch={batch_id}"
        bodies = batch.persist()
        try:
            events, refused = parsed_events(bodies)
            events.write.mode("overwrite").parquet(f"{staged}/events")
            refused.write.mode("overwrite").parquet(f"{staged}/refused")
        finally:
            bodies.unpersist()
        events = spark.read.parquet(f"{staged}/events")
        refused = spark.read.parquet(f"{staged}/refused")
        before = _counters(spark, f"{state_path}/rates", batch_id, events.select(F.col("token_name").alias("key")))
        due = before.last.select(F.col("key").alias("token_name"), F.col("value").alias("due_ns"))

        def keep(frame: DataFrame, name: str) -> DataFrame:
            frame.write.mode("overwrite").parquet(f"{staged}/{name}")
            return spark.read.schema(frame.schema).parquet(f"{staged}/{name}")

        # what was let in is decided once; the audit and the events then agree whatever is read again
        found = ingest_events(events, refused, tokens, book, hard_cap, soft_cap, due, keep)
        passed = found.admission.audit.where("reason is null or reason = 'rate_limit'")
        dues = grants(passed.select("batch_id", "token_name", "at_ms"), tokens, due)
        moved = dues.groupBy(F.col("token_name").alias("key")).agg(F.max("due_ns").alias("value"))
        _advance(spark, f"{state_path}/rates", batch_id, before, moved)
        found.errors.write.mode("overwrite").parquet(f"{errors_path}/batch={batch_id}")
        ready = _numbered(spark, f"{state_path}/seq", batch_id, found.admission.accepted, lambda: found.events)
        append_events(as_events(ready).select(*EVENT_COLUMNS, "at_ms", "batch_id", "ord"), log_path, INGEST_ARRIVAL)

    return write


def dedupe_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeated ids that arrive within ``delay`` of each other.

    The watermark follows the time of the micro-batch, not of the event, so that
    an event however late is never taken for expired.  Repeats further apart are
    caught by the log's append.
    """
    use_rocksdb(events.sparkSession)
    return (
        events.withColumn("__seen", F.current_timestamp())
        .withWatermark("__seen", delay)
        .dropDuplicatesWithinWatermark(["event_id"])
        .drop("__seen")
    )


# --- what is true now --------------------------------------------------------


def latest_stream(events: DataFrame, arrival: Sequence[str] = ARRIVAL) -> DataFrame:
    """Continuous `latest_by_event_time`, one changed row per pair and batch.

    A built-in aggregation: state is one row per pair and a busy pair is reduced
    on every task before rows move.
    """
    order = F.struct((-F.col("ts_ms_utc")).alias("t"), *arrival)
    best = F.min_by(F.struct(*events.columns), order)
    use_rocksdb(events.sparkSession)
    return events.groupBy(*PAIR).agg(best.alias("__e")).select("__e.*")


def ring_stream(
    events: DataFrame,
    max_events: int = RING_MAX_EVENTS,
    max_age_ms: int = RING_MAX_AGE_MS,
    arrival: Sequence[str] = ARRIVAL,
) -> DataFrame:
    """Continuous `hot_window`: the whole ring of each pair that changed.

    Of a micro-batch only the newest ``max_events`` of a pair in each input partition reach the state, however busy the pair is.
    A built-in aggregation: state is a pair's newest ``max_events``, merged without a call for each pair; as in
    `hot_window`, what has expired beside the newest is left out from the oldest on. Columns have to be of
    types that can be ordered.
    """
    use_rocksdb(events.sparkSession)
    event = F.struct(F.struct(*arrival).alias("at"), F.struct(*events.columns).alias("e"))
    rings = newest_rows(events, max_events, arrival).groupBy(*PAIR).agg(newest_of(event, max_events).alias("__ring"))

    def pushed(entry: Column) -> Column:
        return F.coalesce(entry["e"]["ingest_ts_ms_utc"], entry["e"]["ts_ms_utc"])

    ring = F.col("__ring")
    young = F.transform(ring, lambda entry, i: F.when(pushed(entry) >= pushed(ring[0]) - max_age_ms, i + 1))
    live = F.slice(ring, F.lit(1), F.array_max(young))
    return rings.select(F.explode(live).alias("__event")).select("__event.e.*")


def newest_of(order: Column, most: int) -> Column:
    """Aggregate: the greatest ``most`` values in falling order; Spark has no public name for it yet."""
    return InternalFunction.collect_top_k(order, most, False)


def newest_rows(
    events: DataFrame, max_events: int, arrival: Sequence[str] = ARRIVAL, held: int = 100_000
) -> DataFrame:
    """The newest events of each pair in each input partition, by arrival.

    Older ones can be in no ring. A task holds about ``held`` rows and passes on what it has when
    more than that are still wanted, as with very many pairs.
    """
    columns = [*PAIR, *arrival]

    def cut(rows: pa.Table) -> pa.Table:
        codes = np.zeros(rows.num_rows, np.int64)
        for name in PAIR:
            column = rows.column(name).combine_chunks().dictionary_encode()
            codes = codes * (len(column.dictionary) + 1) + column.indices.to_numpy(zero_copy_only=False)
        keys = pa.table([pa.array(codes), *(rows.column(c) for c in arrival)], names=["__pair", *arrival])
        order = pc.sort_indices(keys, [("__pair", "ascending"), *((c, "descending") for c in arrival)], null_placement="at_end")
        pairs = codes[order.to_numpy()]
        place = np.arange(len(pairs)) - np.searchsorted(pairs, pairs, "left")
        return rows.take(pa.array(np.sort(order.to_numpy()[place < max_events])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            kept = rows if kept is None else pa.concat_tables([kept, rows])
            if kept.num_rows > held:
                kept = cut(kept)
                if kept.num_rows > held // 2:
                    yield from kept.to_batches()
                    kept = None
        if kept is not None:
            yield from cut(kept).combine_chunks().to_batches()

    assert set(columns) <= set(events.columns)
    return events.mapInArrow(run, events.schema)


def rate_limit_stream(batches: DataFrame, tokens: Sequence[TokenScope]) -> DataFrame:
    """Continuous `rate_limit`: (batch_id, token_name, at_ms, allowed) of each batch once.

    Each task first brings the batches of one token and millisecond together, so that distinct milliseconds
    enter the state, which is one number per token; tokens without a rate do not enter it at all. Time goes on
    from where the token's state is; what arrives late is judged when it arrives.
    """
    use_rocksdb(batches.sparkSession)
    rates = {t.name: parse_rate(t.rate_limit) for t in tokens if t.rate_limit}
    rows = batches.select("batch_id", "token_name", "at_ms")
    id_type = rows.schema["batch_id"].dataType.simpleString()

    def together(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            grouped = pa.Table.from_batches([part]).group_by(["token_name", "at_ms"]).aggregate([("batch_id", "list")])
            yield from grouped.rename_columns(["token_name", "at_ms", "batch_ids"]).to_batches()

    limited = F.col("token_name").isin(list(rates))
    judged = (
        rows.where(limited)
        .mapInArrow(together, f"token_name string, at_ms long, batch_ids array<{id_type}>")
        .groupBy("token_name")
        .transformWithState(RateProcessor(rates), f"batch_id {id_type}, token_name string, at_ms long, allowed boolean", "update", "none")
    )
    free = rows.where(~limited | F.col("token_name").isNull()).withColumn("allowed", F.lit(True))
    return judged.unionByName(free)


def changes_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Keep each batch's changed rows under the batch's number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of every pair from a changes directory."""
    changes = spark.read.parquet(path)
    newest = F.max("batch").over(Window.partitionBy(*PAIR))
    return changes.withColumn("__newest", newest).where("batch = __newest").drop(
        "batch", "__newest"
    )


def fan_out(
    events: Callable[[], DataFrame],
    sinks: dict[str, Callable[[DataFrame, int], None]],
    checkpoints: str,
    every: str | None = "500 milliseconds",
) -> dict[str, StreamingQuery]:
    """One independent query per sink over the same normalised table."""
    begin = partial(start, every=every)
    return {
        name: begin(events(), sink, f"{checkpoints}/{name}") for name, sink in sinks.items()
    }
