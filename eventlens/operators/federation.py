"""Rows of several sites side by side, and forwarding to a hub."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass
from time import monotonic

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.functions.globs import glob_filter
from eventlens.model import Peer
from eventlens.session import run_folder

_TOLERANT = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}


@dataclass(frozen=True)
class Federated:
    rows: DataFrame
    status: DataFrame


def merge_peer(
    rows: DataFrame,
    remote: DataFrame,
    peer_id: str,
    sources: Sequence[str] | None = None,
    kinds: Sequence[str] | None = None,
) -> DataFrame:
    """Append one peer's matching rows under its id; nothing is deduplicated."""
    wanted = remote.where(
        glob_filter(F.col("source_id"), sources) & glob_filter(F.col("kind"), kinds)
    )
    return rows.unionByName(
        wanted.withColumn("peer_id", F.lit(peer_id)), allowMissingColumns=True
    )


def open_peer(spark: SparkSession, peer: Peer) -> DataFrame:
    return spark.read.format(peer.fmt).options(**{**_TOLERANT, **peer.options}).load(peer.path)


def federate_within(
    local: DataFrame,
    peers: Sequence[Peer],
    wait_ms: int,
    sources: Sequence[str] | None = None,
    kinds: Sequence[str] | None = None,
    reader: Callable[[SparkSession, Peer], DataFrame] = open_peer,
    at_once: int = 8,
) -> Federated:
    """`federate` that waits for each peer no longer than ``wait_ms``, or than the peer's own ``wait_ms``.

    Each peer's matching rows are copied by a job of its own, several at a time, into the shared folder; a job that is
    not done in its time is cancelled by its tag, and the peer's status is ``timeout``.  What the result reads
    are the copies, so a peer that fails later on costs nothing either.
    """
    spark = local.sparkSession
    folder = run_folder(spark, "peers")
    rows = local.withColumn("peer_id", F.lit(None).cast("string"))
    status: list[tuple[str, str, str | None]] = []

    def copy(peer: Peer, tag: str, path: str) -> float:
        spark.sparkContext.addJobTag(tag)
        try:
            wanted = reader(spark, peer).where(
                glob_filter(F.col("source_id"), sources) & glob_filter(F.col("kind"), kinds)
            )
            wanted.write.parquet(path)
            return monotonic()
        finally:
            spark.sparkContext.removeJobTag(tag)

    pool = ThreadPoolExecutor(at_once, "peer")
    begun: list[tuple[Peer, str, str, Future, float]] = []
    for number, peer in enumerate(peers):
        tag, path = f"peer-{uuid.uuid4().hex}", f"{folder}/{number}"
        most = wait_ms if peer.wait_ms is None else peer.wait_ms
        begun.append((peer, tag, path, pool.submit(copy, peer, tag, path), monotonic() + most / 1000))
    for peer, tag, path, job, until in sorted(begun, key=lambda b: b[4]):
        try:
            if job.result(max(0.0, until - monotonic())) > until:
                raise Late
            rows = rows.unionByName(
                spark.read.parquet(path).withColumn("peer_id", F.lit(peer.peer_id)), allowMissingColumns=True
            )
            status.append((peer.peer_id, "ok", None))
        except Late:
            job.cancel()
            spark.sparkContext.cancelJobsWithTag(tag)
            status.append((peer.peer_id, "timeout", None))
        except Exception as error:  # whatever a peer's storage raises is that peer's affair
            status.append((peer.peer_id, "error", (str(error).splitlines() or [type(error).__name__])[0]))
    pool.shutdown(wait=False, cancel_futures=True)
    return Federated(
        rows, spark.createDataFrame(status, "peer_id string, status string, detail string")
    )


def federate(
    local: DataFrame,
    peers: Sequence[Peer],
    sources: Sequence[str] | None = None,
    kinds: Sequence[str] | None = None,
) -> Federated:
    """Append the peers' published rows to the local ones.

    Local rows carry a null ``peer_id``; a peer's rows carry its id, which
    replaces any id they came with.  Nothing is deduplicated.  A peer whose
    table cannot be opened contributes a status and no rows; a file of a peer that
    turns out damaged or gone while rows are read costs its own rows, never the
    query.  Rows are read when the result is; `federate_within` waits for peers beforehand.
    """
    spark = local.sparkSession
    rows = local.withColumn("peer_id", F.lit(None).cast("string"))
    status: list[tuple[str, str, str | None]] = []
    for peer in peers:
        try:
            rows = merge_peer(rows, open_peer(spark, peer), peer.peer_id, sources, kinds)
            status.append((peer.peer_id, "ok", None))
        except (AnalysisException, PySparkException) as error:
            status.append((peer.peer_id, "error", str(error).splitlines()[0]))
    return Federated(
        rows, spark.createDataFrame(status, "peer_id string, status string, detail string")
    )


def forward_events(events: DataFrame, peer_id: str) -> DataFrame:
    """Events as a producer at the hub would send them.

    Ids, kind, times, payload, trace and producer stay; the source gets the
    site's prefix; links, ingest time, sequence and the invalid flag are left
    for the hub to set.
    """
    return events.select(
        "event_id",
        F.concat(F.lit(f"{peer_id}."), "source_id").alias("source_id"),
        "kind",
        "ts_ms_utc",
        "semantic",
        "trace_id",
        "producer_id",
    )
