"""Embedding of events and exact filtered nearest-vector search."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from eventlens.functions.embedding import Embedder, hash_embedder
from eventlens.functions.globs import glob_filter, time_between
from eventlens.functions.scalars import bare_kind, utf8_cut, was_cut
from eventlens.model import DEFAULT_SEARCH_LIMIT, VECTOR, VectorFilter
from eventlens.session import run_folder

#: Vectors of a block, and spread numbers by which blocks of vectors and of queries are joined.
BLOCK, SPREAD = 2048, 64
HIT_COLUMNS = ["event_id", "source_id", "kind", "ts_ms_utc", "truncated"]
_HITS = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in VECTOR if f.name in HIT_COLUMNS)


def select_for_embedding(
    events: DataFrame, sources: DataFrame, kinds: DataFrame, default: bool = False
) -> DataFrame:
    """Events to embed: the source's flag, else the bare kind's, else default.

    ``sources`` and ``kinds`` are descriptor tables with ``embed`` flags; whether
    they are broadcast is left to Spark, which knows their size when the join runs.
    """
    by_source = sources.where("embed is not null").select(
        "source_id", F.col("embed").alias("__source_flag")
    )
    by_kind = (
        kinds.where("embed is not null")
        .groupBy(F.col("name").alias("__bare"))
        .agg(F.max_by("embed", "ord").alias("__kind_flag"))
    )
    flagged = (
        events.withColumn("__bare", bare_kind(F.col("kind")))
        .join(by_source, "source_id", "left")
        .join(by_kind, "__bare", "left")
    )
    wanted = F.coalesce("__source_flag", "__kind_flag", F.lit(default))
    return flagged.where(wanted).select(*events.columns)


def embed_events(
    events: DataFrame,
    embedder: Embedder | None = None,
    max_bytes: int | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Vector rows of events: compact JSON, embedded whole.

    ``max_bytes`` cuts longer texts between characters, which ``truncated`` then says;
    ``keep`` names further columns of the events to take along.
    """
    embedder = embedder or hash_embedder()
    text = F.col("semantic")
    cut = max_bytes is not None
    return events.select(
        "event_id",
        "source_id",
        "kind",
        "ts_ms_utc",
        (was_cut(text, max_bytes) if cut else F.lit(False)).alias("truncated"),
        F.lit(embedder.model_id).alias("model_id"),
        embedder.embed(utf8_cut(text, max_bytes) if cut else text).alias("vector"),
        *keep,
    )


def filter_vectors(vectors: DataFrame, flt: VectorFilter | None) -> DataFrame:
    if flt is None:
        return vectors
    if flt.start_ms is not None and flt.end_ms is not None and flt.end_ms <= flt.start_ms:
        raise ValueError(f"empty time range: end {flt.end_ms} <= start {flt.start_ms}")
    return vectors.where(
        time_between(F.col("ts_ms_utc"), flt.start_ms, flt.end_ms)
        & glob_filter(F.col("source_id"), flt.sources)
        & glob_filter(F.col("kind"), flt.kinds)
    )


def top_k(limit: int | None) -> int:
    """How many hits to give; any number from 1 on."""
    k = DEFAULT_SEARCH_LIMIT if limit is None else limit
    if k < 1:
        raise ValueError(f"limit {k} < 1")
    return k


def search_vector(
    vectors: DataFrame,
    query: Sequence[float],
    limit: int | None = None,
    flt: VectorFilter | None = None,
) -> DataFrame:
    """Best hits by dot product, filtered before scoring; ties by event_id."""
    wanted = filter_vectors(vectors, flt).select(*HIT_COLUMNS, "vector")
    k = top_k(limit)
    matrix = np.array([query], dtype=np.float64)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Best(matrix, k)
        for batch in batches:
            found.offer(_rows(batch), _matrix(batch))
        yield from found.batches(None)

    return wanted.mapInArrow(best, f"{_HITS}, score double").orderBy(F.col("score").desc(), "event_id").limit(k)


def search(
    vectors: DataFrame,
    query: str,
    limit: int | None = None,
    flt: VectorFilter | None = None,
    embedder: Embedder | None = None,
) -> DataFrame:
    """`search_vector` for a text, which is embedded whole."""
    if not query.strip():
        raise ValueError("query string is empty")
    embedder = embedder or hash_embedder()
    return search_vector(vectors, embedder.embed_text(query), limit, flt)


def hydrate(hits: DataFrame, events: DataFrame) -> DataFrame:
    """Hits with their full event; hits whose event is gone disappear.

    ``hits`` is the result of `search` or `search_many`, of any size; columns that
    events lack, such as the query's id and the rank, are kept.  Spark
    broadcasts the hits if they are few.
    """
    own = [c for c in hits.columns if c not in events.columns]
    found = events.join(hits.select("event_id", *own), "event_id")
    return found.select(*events.columns, *own).orderBy(F.col("score").desc(), "event_id")


def embed_queries(queries: DataFrame, text: Column, embedder: Embedder | None = None) -> DataFrame:
    embedder = embedder or hash_embedder()
    return queries.select("query_id", embedder.embed(text).alias("query"))


def search_many(
    vectors: DataFrame,
    queries: DataFrame,
    limit: int | None = None,
    flt: VectorFilter | None = None,
    block_size: int = 1024,
) -> DataFrame:
    """Best hits for every row of ``queries(query_id, query)``; exact.

    Vectors are packed into blocks where they are read, queries into blocks of about ``block_size``, both are
    rows, and an equi-join by block and spread number brings them together: the vectors are scanned once,
    whatever the number of queries, and no query is on the driver.  A task multiplies block with block and keeps
    its best k per query; a last ranking per query runs over those.
    """
    k = top_k(limit)
    spark = vectors.sparkSession
    wanted = filter_vectors(vectors, flt).select(*HIT_COLUMNS, "vector")
    blocks = max(1, math.ceil(queries.count() / block_size))
    id_type = queries.schema["query_id"].dataType
    folder = run_folder(spark, "queries")
    (
        queries.where("query_id is not null")
        .groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
        .agg(F.collect_list(F.struct("query_id", F.col("query").cast("array<double>").alias("query"))).alias("asked"))
        .write.parquet(folder)
    )
    asked = spark.read.schema(
        f"block long, asked array<struct<query_id: {id_type.simpleString()}, query: array<double>>>"
    ).parquet(folder)
    numbers = asked.select("block", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("spread"))
    packed = wanted.mapInArrow(_pack, f"spread int, hits array<struct<{_HITS}>>, dim int, matrix binary")
    pairs = packed.join(numbers, "spread").join(asked, "block").select("block", "asked", "hits", "dim", "matrix")
    arrow_id = to_arrow_type(id_type)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[pa.Array, _Best]] = {}
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                if block not in found:
                    own = batch.column("asked")[i].values
                    vectors_ = own.field("query")
                    matrix = vectors_.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors_), -1)
                    found[block] = pa.array(own.field("query_id").to_pylist(), arrow_id), _Best(matrix, k)
                raw = np.frombuffer(batch.column("matrix")[i].as_buffer(), "<f4")
                stored = raw.reshape(-1, batch.column("dim")[i].as_py()).astype(np.float64)
                found[block][1].offer(batch.column("hits")[i].values, stored)
        for ids, kept in found.values():
            yield from kept.batches(ids)

    hits = pairs.mapInArrow(best, f"query_id {id_type.simpleString()}, {_HITS}, score double")
    rank = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.col("score").desc(), "event_id")
    )
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def _rows(batch: pa.RecordBatch) -> pa.StructArray:
    return pa.StructArray.from_arrays([batch.column(c) for c in HIT_COLUMNS], HIT_COLUMNS)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1).astype(np.float64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as blocks: their descriptions, and all values of the block as one piece."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId()
    for whole in batches:
        for begin in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(begin, BLOCK)
            rows = _rows(batch)
            values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype("<f4")
            if len(values) % batch.num_rows:
                raise ValueError("vectors of different widths")
            number += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number % SPREAD], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                    pa.array([len(values) // batch.num_rows], pa.int32()),
                    pa.array([values.tobytes()], pa.binary()),
                ],
                names=["spread", "hits", "dim", "matrix"],
            )


class _Best:
    """The best k rows for each query of a block, among those that were offered."""

    def __init__(self, matrix: np.ndarray, k: int):
        self.matrix, self.k = matrix, k
        self.query = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.rows: pa.StructArray | None = None

    def offer(self, rows: pa.StructArray, stored: np.ndarray) -> None:
        if not len(rows):
            return
        scores = self.matrix @ stored.T
        if len(rows) > self.k:
            least = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
        else:
            least = np.full(len(scores), -np.inf)
        query, at = np.nonzero(scores >= least[:, None])  # ties of the last place included
        found, score = rows.take(pa.array(at)), scores[query, at]
        if self.rows is not None:
            query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
            found = pa.concat_arrays([self.rows, found])
        names = np.array(found.field("event_id").to_pylist())
        order = np.lexsort((names, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, "left")
        kept = order[place < self.k]
        self.query, self.score, self.rows = query[place < self.k], score[kept], found.take(pa.array(kept))

    def batches(self, ids: pa.Array | None) -> Iterator[pa.RecordBatch]:
        if self.rows is not None:
            named = [] if ids is None else [ids.take(pa.array(self.query))]
            names = [] if ids is None else ["query_id"]
            yield pa.RecordBatch.from_arrays([*named, *self.rows.flatten(), pa.array(self.score)], names=[*names, *HIT_COLUMNS, "score"])
