"""One query per operator over the sample tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.functions.embedding import hash_embedder
from eventlens.functions.globs import glob_filter
from eventlens.functions.scalars import day_of, kind_name, kind_version, utf8_cut, was_cut
from eventlens.functions.topics import decode_payload
from eventlens.model import Anchor, Peer, RetentionPolicy, TokenScope
from eventlens.operators import (
    admission,
    descriptors,
    federation,
    health,
    ingest,
    normalize,
    retention,
    routing,
    search,
    state,
    window,
)
from eventlens.plans import settings as S
from eventlens.session import run_folder
from eventlens.sources import events_log, payloads, tables
from eventlens.sources import vectors as vector_store
from eventlens.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PAIR = ["source_id", "kind"]
ARRIVAL = ["ingest_ts_ms_utc", "event_id"]
MODEL = "sample-64"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- what happened -----------------------------------------------------------


@query
def window_scan(spark, d):
    rows = tables.events(spark, d, S.WEEK.start_ms, S.WEEK.end_ms)
    return window.window_scan(rows, S.WEEK)


@query
def window_glob(spark, d):
    rows = tables.events(spark, d, S.GLOBBED.start_ms, S.GLOBBED.end_ms)
    return window.window_scan(rows, S.GLOBBED)


@query
def window_page2(spark, d):
    """The second page, found with the first page's token."""
    rows = tables.events(spark, d, S.WEEK.start_ms, S.WEEK.end_ms)
    first = window.get_page(rows, S.WEEK)
    if first.next_token is None:
        return rows.limit(0)
    anchor: Anchor = window.read_token(first.next_token, S.WEEK)
    return window.window_scan(rows, S.WEEK, anchor)


@query
def window_pages(spark, d):
    """A window followed from page to page to its end; pages are brought to the caller, as to any reader of them."""
    rows = tables.events(spark, d, S.GLOBBED.start_ms, S.GLOBBED.end_ms)
    asked = replace(S.GLOBBED, limit=200)
    told = [
        (number, place, row["event_id"], row["ts_ms_utc"])
        for number, page in enumerate(window.iter_pages(rows, asked))
        for place, row in enumerate(page.rows)
    ]
    return spark.createDataFrame(told, "page long, place long, event_id string, ts_ms_utc long")


@query
def window_all(spark, d):
    return window.window_all(tables.events(spark, d), S.GLOBBED)


@query
def count_events(spark, d):
    return events_log.count_events(tables.events(spark, d))


@query
def count_pair(spark, d):
    return events_log.count_pair(tables.events(spark, d), "user.7", "click")


@query
def distinct_pairs(spark, d):
    return events_log.distinct_pairs(tables.events(spark, d))


@query
def get_by_id(spark, d):
    """The events that the stored vectors belong to."""
    ids = tables.vectors(spark, d, MODEL)
    return events_log.get_by_id(tables.events(spark, d), ids)


@query
def kind_refs(spark, d):
    kind = F.col("kind")
    return (
        tables.events(spark, d)
        .select(kind, kind_name(kind).alias("name"), kind_version(kind).alias("version"))
        .groupBy("kind", "name", "version")
        .agg(F.count("*").alias("n"))
    )


@query
def daily_partition(spark, d):
    rows = tables.events(spark, d).select(day_of(F.col("ts_ms_utc")).alias("day"))
    return rows.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


# --- what is true now --------------------------------------------------------


@query
def latest_event_time(spark, d):
    return state.latest_by_event_time(tables.events(spark, d))


@query
def hot_latest(spark, d):
    return state.hot_latest(tables.events(spark, d))


def _ring(spark, d):
    return state.hot_window(tables.events(spark, d), S.RING_EVENTS, S.RING_AGE_MS)


@query
def hot_window(spark, d):
    return _ring(spark, d)


@query
def hot_snapshot_counts(spark, d):
    events = F.col("events")
    return state.hot_snapshot(_ring(spark, d)).select(
        *PAIR,
        F.size(events).cast("long").alias("n"),
        F.element_at(events, 1)["event_id"].alias("oldest"),
        F.element_at(events, -1)["event_id"].alias("newest"),
    )


@query
def hot_keys(spark, d):
    return state.hot_keys(_ring(spark, d))


def _current(spark, d):
    rows = tables.events(spark, d)
    declared = descriptors.resolve_descriptors(
        tables.sources(spark, d), tables.kinds(spark, d)
    )
    return state.current_state_of(declared, rows, S.RECENT_MS, tables.NOW_MS)


@query
def current_state(spark, d):
    return _current(spark, d).select(
        *PAIR, "event_id", "ts_ms_utc", "age_ms", "stale", "from_cold",
        F.col("descriptor.description").alias("description"), "peer_id",
    )


@query
def stale_sources(spark, d):
    return (
        _current(spark, d)
        .where("stale")
        .groupBy("source_id")
        .agg(F.count("*").alias("stale_kinds"), F.max("age_ms").alias("oldest_ms"))
    )


# --- which sources exist -----------------------------------------------------


@query
def resolve_descriptors(spark, d):
    return descriptors.resolve_descriptors(tables.sources(spark, d), tables.kinds(spark, d))


@query
def describe_sources(spark, d):
    """Descriptors with schema errors of the sample events and their retention."""
    asked = ("user.*",)
    rows = tables.events(spark, d).where(glob_filter(F.col("source_id"), asked))
    checked = normalize.validate_semantic(rows.select(*PAIR, "ts_ms_utc", "semantic"), S.SCHEMAS)
    errors = health.recent_errors(
        health.event_errors(checked.where("schema_invalid"), "schema_invalid", "ts_ms_utc")
    )
    declared = descriptors.resolve_descriptors(
        tables.sources(spark, d), tables.kinds(spark, d)
    )
    described = descriptors.describe_sources(declared, errors, S.POLICIES, asked, None)
    return described.select(
        *PAIR, "kind_version", "description",
        F.element_at("recent_errors.counters", "schema_invalid").alias("schema_errors"),
        F.col("recent_errors.last_error_ts_ms_utc").alias("last_error"),
        F.col("effective_retention.max_age_ms").alias("max_age_ms"),
        F.col("effective_retention.max_count").alias("max_count"),
        F.col("effective_retention.max_bytes").alias("max_bytes"),
        F.col("effective_retention.vector_max_age_ms").alias("vector_max_age_ms"),
        "peer_id",
    )


# --- ingest ------------------------------------------------------------------


@query
def parse_payloads(spark, d):
    return payloads.parse_payloads(tables.chat_payloads(spark, d)).events.select(
        "conv_id", "turn", F.col("ord").cast("long").alias("ord"),
        "source_id", "kind", "ts_ms_utc", "semantic",
    )


@query
def parse_rejects(spark, d):
    rejected = payloads.parse_payloads(tables.chat_payloads(spark, d)).rejected
    return rejected.groupBy("reason").agg(F.count("*").alias("n"))


def _admitted(spark, d):
    return admission.admit_batches(
        tables.chat_events(spark, d), S.TOKENS, S.HARD_CAP, S.SOFT_CAP
    )


@query
def admit_batches(spark, d):
    return _admitted(spark, d).accepted.select("batch_id", "ord", "event_id", "source_id")


@query
def rejected_events(spark, d):
    return _admitted(spark, d).rejected.select("batch_id", "ord", "event_id", "reason")


@query
def batch_shed_summary(spark, d):
    return (
        _admitted(spark, d)
        .audit.groupBy("token_name", "reason")
        .agg(
            F.count("*").alias("batches"),
            F.sum("events").alias("events"),
            F.sum("soft_oversize").alias("soft_oversize"),
        )
    )


@query
def recent_errors(spark, d):
    log = health.admission_errors(_admitted(spark, d).audit)
    return health.recent_errors(log).select(
        "source_id", F.explode("counters").alias("reason", "n"), "last_error_ts_ms_utc"
    )


@query
def ingest_counters(spark, d):
    admitted = _admitted(spark, d)
    accepted = admitted.accepted.withColumn("schema_invalid", F.lit(None).cast("boolean"))
    routed = routing.route_outcomes(tables.messages(spark, d), S.SUBSCRIPTIONS)
    return health.ingest_counters(accepted, admitted.audit, routed)


@query
def admit_many_tokens(spark, d):
    """A token of its own for each of 5000 users, of which every third may write nothing."""
    tokens = [
        TokenScope(f"user.{u}", (f"user.{u}",) if u % 2 else (f"user.{u}*", "[x]?"), ("v*", "{nothing}") if u % 3 else ())
        for u in range(5000)
    ]
    rows = tables.events(spark, d).withColumn("token_name", F.col("source_id"))
    allowed = admission.with_allowed(rows, tokens).where("allowed")
    return allowed.select("event_id", "source_id", "kind")


def _turns(spark, d):
    """Every turn of a conversation is a batch; two turns share a millisecond."""
    return tables.table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("batch_id"),
        F.concat(F.lit("edge"), (F.col("conv_id") % 3).cast("string")).alias("token_name"),
        (F.lit(tables.NOW_MS) + F.col("conv_id") * 400 + F.floor(F.col("turn") / 2) * 50).cast("long").alias("at_ms"),
    )


@query
def rate_limit_turns(spark, d):
    return admission.rate_limit(_turns(spark, d), S.TOKENS)


@query
def rate_limit(spark, d):
    audit = _admitted(spark, d).audit
    passed = audit.where("reason is null").select("batch_id", "token_name", "at_ms")
    return admission.rate_limit(passed, S.TOKENS)


def _bodies(spark, d):
    """Request bodies with their tokens and times; one body is one batch."""
    return tables.chat_payloads(spark, d).select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("batch_id"),
        F.concat(F.lit("edge"), (F.col("conv_id") % 3).cast("string")).alias("token_name"),
        (F.lit(tables.NOW_MS) + F.col("conv_id") * 400 + F.floor(F.col("turn") / 2) * 50).cast("long").alias("at_ms"),
        "body",
    )


INGESTED = ["batch_id", "ord", "source_id", "kind", "ts_ms_utc", "semantic", "ingest_ts_ms_utc", "seq", "schema_invalid"]


@query
def ingest_chain(spark, d):
    """Bodies parsed, admitted by scope, size and rate, numbered and checked."""
    found = ingest.ingest(_bodies(spark, d), S.TOKENS, S.MESSAGES, S.HARD_CAP, S.SOFT_CAP)
    return found.events.withColumn("ord", F.col("ord").cast("long")).select(*INGESTED)


@query
def describe_errors(spark, d):
    """Each source's errors of all four reasons and the time of the last one."""
    found = ingest.ingest(_bodies(spark, d), S.TOKENS, S.MESSAGES, S.HARD_CAP, S.SOFT_CAP)
    return health.recent_errors(found.errors).select(
        "source_id", F.explode("counters").alias("reason", "n"), "last_error_ts_ms_utc"
    )


@query
def read_payload_files(spark, d):
    """Bodies written as files, one to a line, and read back by the payload source."""
    folder = run_folder(spark, "payloads")
    tables.chat_payloads(spark, d).select(F.col("body").alias("value")).write.text(folder)
    parsed = payloads.parse_payloads(payloads.read_payloads(spark, "text", folder)).events
    return parsed.select("source_id", "kind", "ts_ms_utc", "semantic")


@query
def size_audit(spark, d):
    return admission.size_audit(tables.chat_events(spark, d), S.HARD_CAP, S.SOFT_CAP)


@query
def normalize_seq(spark, d):
    rows = normalize.normalize(tables.events(spark, d), ARRIVAL)
    return rows.select("event_id", "source_id", "ingest_ts_ms_utc", "seq")


@query
def normalize_seq_ranges(spark, d):
    """One source has all events: its numbering is cut into many ranges."""
    rows = tables.events(spark, d).withColumn("source_id", F.lit("user.all"))
    numbered = normalize.normalize(rows, ARRIVAL, rows_per_range=1000)
    return numbered.select("event_id", "source_id", "ingest_ts_ms_utc", "seq")


@query
def generated_ids(spark, d):
    """Ids given to chat events that come without one."""
    rows = tables.chat_events(spark, d).drop("event_id")
    filled = normalize.normalize(rows, ["batch_id", "ord"], now_ms=tables.NOW_MS)
    return filled.select("batch_id", "ord", "source_id", "seq", "event_id", "trace_id")


@query
def validate_semantic(spark, d):
    rows = tables.events(spark, d)
    return normalize.validate_semantic(rows, S.SCHEMAS).select(
        "event_id", "source_id", "kind", "schema_invalid"
    )


@query
def validate_declared(spark, d):
    """Payloads checked by what the descriptors declare, and 5000 sources of which each declares a schema of its own."""
    rows = tables.events(spark, d)
    book = normalize.declared_schemas(tables.sources(spark, d), tables.kinds(spark, d))
    many = {f"user.{u}": {"title": f"of {u}", "properties": {"k": {"minimum": u % 60}}, "required": ["k"]} for u in range(5000) if u % 3}
    checked = normalize.validate_semantic(rows, normalize.SchemaBook({**book.sources, **many}, book.kinds))
    return checked.select("event_id", "source_id", "kind", "schema_invalid")


@query
def latest_kind_version(spark, d):
    return normalize.latest_versions(tables.kinds(spark, d))


@query
def dedupe_first(spark, d):
    """What an append keeps of a stream with repeated ids, nothing being stored."""
    return events_log.first_writes(tables.with_copies(tables.events(spark, d)), ARRIVAL)


@query
def append_new(spark, d):
    """What an append adds when the first weeks are stored already."""
    rows = tables.events(spark, d)
    stored = rows.where(F.col("ts_ms_utc") < S.WEEK.end_ms)
    return events_log.new_events(tables.with_copies(rows), stored, ARRIVAL)


@query
def upsert_last(spark, d):
    """Vector rows after a second, later write of some ids."""
    stored = tables.vectors(spark, d, MODEL)
    changed = stored.where(F.right("event_id", F.lit(1)).isin("0", "5")).withColumns(
        {"truncated": F.lit(True), "turn": F.lit(1)}
    )
    again = changed.withColumns({"kind": F.lit("rewritten"), "turn": F.lit(2)})
    after = vector_store.upsert(stored, changed.unionByName(again), ["turn"])
    return after.select("event_id", *PAIR, "truncated", F.size("vector").alias("width"))


# --- stored tables -----------------------------------------------------------


def _stored_log(spark, d) -> str:
    """The sample events as a stored log, written in three batches that repeat ids."""
    path = f"{run_folder(spark, 'log')}/log"
    rows = tables.with_copies(tables.events(spark, d))
    arrived = F.col("ingest_ts_ms_utc")
    cuts = [tables.NOW_MS - days * tables.DAY_MS for days in (20, 10)]
    for batch in (arrived < cuts[0], arrived < cuts[1], arrived >= cuts[0]):
        events_log.append_events(normalize.as_events(rows.where(batch)), path)
    return path


@query
def append_bucketed(spark, d):
    """What is stored after three batches, of which two bring ids again, some with other content."""
    log = events_log.read_log(spark, _stored_log(spark, d))
    return log.select("event_id", *PAIR, "ts_ms_utc", "semantic", "ingest_ts_ms_utc", F.col("day").cast("string").alias("day"))


@query
def lookup_stored(spark, d):
    """The events of the stored vectors, looked up by the ids' slots and days."""
    found = events_log.lookup(spark, _stored_log(spark, d), tables.vectors(spark, d, MODEL))
    return found.select("event_id", *PAIR, "ts_ms_utc", "semantic", "ingest_ts_ms_utc")


@query
def sweep_execute(spark, d):
    """What a sweep leaves of the stored log."""
    path = _stored_log(spark, d)
    events_log.sweep_log(spark, path, S.POLICIES, tables.NOW_MS)
    return events_log.read_log(spark, path).select("event_id", *PAIR, F.col("day").cast("string").alias("day"))


@query
def sweep_execute_counts(spark, d):
    """Per day, how many events there were and how many a sweep removed."""
    counts = events_log.sweep_log(spark, _stored_log(spark, d), S.POLICIES, tables.NOW_MS)
    return counts.withColumn("day", F.col("day").cast("string"))


def _stored_vectors(spark, d) -> str:
    """The sample vectors stored, some of them then written again twice."""
    path = f"{run_folder(spark, 'vectors')}/vectors"
    stored = tables.vectors(spark, d, MODEL)
    width = stored.select(F.size("vector")).first()[0]
    changed = stored.where(F.right("event_id", F.lit(1)).isin("0", "5"))
    for turn, rows in enumerate([
        stored,
        changed.withColumn("truncated", F.lit(True)),
        changed.withColumns({"truncated": F.lit(True), "kind": F.lit("rewritten")}),
    ]):
        vector_store.append_vectors(rows.withColumn("turn", F.lit(turn)), path, MODEL, width, ["turn"])
    return path


@query
def upsert_repeated(spark, d):
    """Stored vectors after two later writes of some ids."""
    width = tables.vectors(spark, d, MODEL).select(F.size("vector")).first()[0]
    after = vector_store.load_vectors(spark, _stored_vectors(spark, d), MODEL, width)
    return after.select("event_id", *PAIR, "truncated", F.size("vector").alias("width"))


@query
def sweep_vectors_execute(spark, d):
    """What a sweep leaves of the stored vectors."""
    path = _stored_vectors(spark, d)
    vector_store.sweep_vectors(spark, path, S.POLICIES, tables.NOW_MS)
    width = tables.vectors(spark, d, MODEL).select(F.size("vector")).first()[0]
    return vector_store.load_vectors(spark, path, MODEL, width).select("event_id", *PAIR)


# --- routing -----------------------------------------------------------------


@query
def route_messages(spark, d):
    return routing.route_messages(tables.messages(spark, d), S.SUBSCRIPTIONS).events


@query
def route_outcomes(spark, d):
    outcomes = routing.route_outcomes(tables.messages(spark, d), S.SUBSCRIPTIONS)
    return routing.outcome_counts(outcomes)


def _decoded(spark, d, fmt):
    rows = tables.messages(spark, d)
    return rows.select("message_no", decode_payload(fmt, F.col("payload")).alias("semantic"))


@query
def decode_hex(spark, d):
    return _decoded(spark, d, "hex")


@query
def decode_raw(spark, d):
    return _decoded(spark, d, "raw")


@query
def decode_csv(spark, d):
    return _decoded(spark, d, "csv")


@query
def decode_json(spark, d):
    return _decoded(spark, d, "json")


# --- retention ---------------------------------------------------------------


@query
def effective_retention_many(spark, d):
    """One policy or two for each of 5000 users; most name users that never wrote."""
    policies = [RetentionPolicy(match_source_id=f"user.{u}", max_count=u % 7 + 1) for u in range(5000)]
    policies += [
        RetentionPolicy(match_source_id=f"user.{u}", match_kind="view", max_age_ms=u + 1) for u in range(0, 5000, 2)
    ]
    policies.append(RetentionPolicy(match_kind="click", max_bytes=9))
    return retention.effective_retention(tables.events(spark, d), policies)


@query
def effective_retention(spark, d):
    return retention.effective_retention(tables.events(spark, d), S.POLICIES)


@query
def sweep_age(spark, d):
    return retention.expired_by_age(tables.events(spark, d), S.POLICIES, tables.NOW_MS)


@query
def sweep_count(spark, d):
    return retention.expired_by_count(tables.events(spark, d), S.POLICIES)


@query
def sweep_bytes(spark, d):
    return retention.expired_by_bytes(tables.events(spark, d), S.POLICIES)


@query
def sweep_reasons(spark, d):
    drops = retention.drop_reasons(tables.events(spark, d), S.POLICIES, tables.NOW_MS)
    return drops.select("event_id", *PAIR, "drop_reason")


@query
def sweep_reasons_ranges(spark, d):
    """One source has all events: only ranges in which a limit falls are ranked."""
    rows = tables.events(spark, d).withColumn("source_id", F.lit("user.all"))
    drops = retention.drop_reasons(rows, S.HOT_POLICIES, tables.NOW_MS, rows_per_range=500)
    return drops.select("event_id", *PAIR, "drop_reason")


@query
def sweep_survivors(spark, d):
    left = retention.survivors(tables.events(spark, d), S.POLICIES, tables.NOW_MS)
    return left.groupBy(*PAIR).agg(F.count("*").alias("n"))


@query
def sweep_report(spark, d):
    return retention.sweep_report(
        tables.events(spark, d), S.POLICIES, tables.NOW_MS, tables.vectors(spark, d, MODEL)
    )


@query
def sweep_dry_run(spark, d):
    return retention.dry_run_report(
        tables.events(spark, d), S.POLICIES, tables.NOW_MS, tables.vectors(spark, d, MODEL)
    )


@query
def sweep_warnings(spark, d):
    """Costly limits when all events of a kind are one source's."""
    rows = tables.events(spark, d).withColumn("source_id", F.lit("user.all"))
    return retention.sweep_warnings(rows, S.POLICIES, tables.NOW_MS, dry_run=True)


@query
def sweep_vectors(spark, d):
    rows = tables.vectors(spark, d, MODEL)
    return retention.expired_vectors(rows, S.POLICIES, tables.NOW_MS).select("event_id", *PAIR)


@query
def orphan_vectors(spark, d):
    left = retention.survivors(tables.events(spark, d), S.POLICIES, tables.NOW_MS)
    rows = tables.vectors(spark, d, MODEL)
    return retention.orphan_vectors(rows, left).select("event_id", *PAIR)


# --- search ------------------------------------------------------------------


@query
def select_embed(spark, d):
    rows = tables.events(spark, d)
    return search.select_for_embedding(
        rows, tables.sources(spark, d), tables.kinds(spark, d)
    ).select("event_id", *PAIR)


@query
def truncate_text(spark, d):
    text = F.col("text")
    return tables.documents(spark, d).select(
        "doc_id", utf8_cut(text, 2048).alias("text"), was_cut(text, 2048).alias("truncated")
    )


@query
def hash_embed(spark, d):
    embedded = tables.documents(spark, d).select(
        "doc_id", hash_embedder().embed(F.col("text")).alias("vector")
    )
    return embedded.select("doc_id", F.posexplode_outer("vector").alias("idx", "value")).select(
        "doc_id", "idx", F.round(F.col("value").cast("double"), 5).alias("value")
    )


@query
def embed_events(spark, d):
    rows = search.embed_events(tables.chat_events(spark, d))
    return rows.select(
        "event_id", "truncated", "model_id",
        F.posexplode_outer("vector").alias("idx", "value"),
    ).select(
        "event_id", "truncated", "model_id", "idx",
        F.round(F.col("value").cast("double"), 5).alias("value"),
    )


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 5))


@query
def search_topk(spark, d):
    return _rounded(search.search(tables.vectors(spark, d, MODEL), S.QUERY_TEXT, 20))


@query
def search_top200(spark, d):
    return _rounded(search.search(tables.vectors(spark, d, MODEL), S.QUERY_TEXT, 200))


@query
def search_filtered(spark, d):
    return _rounded(search.search(tables.vectors(spark, d, MODEL), S.QUERY_TEXT, 50, S.NEARBY))


@query
def search_hydrated(spark, d):
    """Hits among all vectors whose event outlived the retention sweep."""
    hits = search.search(tables.vectors(spark, d, MODEL), S.QUERY_TEXT, 50)
    left = retention.survivors(tables.events(spark, d), S.POLICIES, tables.NOW_MS)
    return _rounded(search.hydrate(hits, left))


@query
def search_many(spark, d):
    """Documents closest to each benchmark text."""
    indexed = search.embed_events(
        tables.documents(spark, d).select(
            F.lpad(F.col("doc_id").cast("string"), 26, "0").alias("event_id"),
            F.concat(F.lit("doc."), "source").alias("source_id"),
            F.col("lang").alias("kind"),
            F.col("doc_id").alias("ts_ms_utc"),
            F.col("text").alias("semantic"),
        ),
    )
    asked = search.embed_queries(
        tables.table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id"),
        F.col("text"),
    )
    hits = search.search_many(indexed, asked, 3)
    return _rounded(hits).select("query_id", "rank", "event_id", "kind", "score")


# --- streams -----------------------------------------------------------------


def _in_two_runs(spark, rows, early, attach) -> str:
    """Stream a frame in two slices, restarting in between.

    ``attach(stream, folder)`` starts the queries; each run takes what is there
    and stops, and the second goes on from the first one's checkpoints.
    """
    folder = run_folder(spark, "stream")
    for part in (early, ~early):
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        for running in attach(stream, folder):
            running.awaitTermination()
    return folder


def _stream_events(spark, d, attach) -> str:
    early = F.col("ingest_ts_ms_utc") < tables.NOW_MS - 15 * tables.DAY_MS
    return _in_two_runs(spark, tables.events(spark, d), early, attach)


@query
def stream_seq(spark, d):
    """Numbers per source that go on after a restart, each batch cut into ranges."""

    def attach(stream, folder):
        sink = jobs.normalize_sink(f"{folder}/log", f"{folder}/counters", rows_per_range=20)
        return [jobs.start(stream, sink, f"{folder}/ck")]

    folder = _stream_events(spark, d, attach)
    return events_log.read_log(spark, f"{folder}/log").select(
        "event_id", "source_id", "ingest_ts_ms_utc", "seq"
    )


@query
def stream_rate_limit(spark, d):
    """Rates that go on from where each token stood before a restart."""

    def attach(stream, folder):
        judged = jobs.rate_limit_stream(stream, S.TOKENS)
        return [jobs.start(judged, jobs.changes_sink(f"{folder}/out"), f"{folder}/ck", "update")]

    turns = _turns(spark, d)
    middle = turns.agg(F.percentile_approx("at_ms", 0.5)).first()[0]
    folder = _in_two_runs(spark, turns, F.col("at_ms") < middle, attach)
    return spark.read.parquet(f"{folder}/out").select("batch_id", "token_name", "at_ms", "allowed")


@query
def stream_ingest_chain(spark, d):
    """The whole way in on a stream: rates and numbers go on after a restart."""

    def attach(stream, folder):
        sink = jobs.ingest_sink(
            f"{folder}/log", f"{folder}/state", f"{folder}/errors", S.TOKENS, S.MESSAGES, S.HARD_CAP, S.SOFT_CAP
        )
        return [jobs.start(stream, sink, f"{folder}/ck")]

    bodies = _bodies(spark, d)
    middle = bodies.agg(F.percentile_approx("at_ms", 0.5)).first()[0]
    folder = _in_two_runs(spark, bodies, F.col("at_ms") < middle, attach)
    return events_log.read_log(spark, f"{folder}/log").select(*INGESTED[2:])


@query
def stream_normalize(spark, d):
    """Request bodies parsed on the stream, normalised and stored."""
    arrival = ["conv_id", "turn", "ord"]

    def attach(stream, folder):
        parsed = payloads.parse_payloads(stream).events
        sink = jobs.normalize_sink(
            f"{folder}/log", f"{folder}/counters", arrival, now_ms=lambda: tables.NOW_MS
        )
        return [jobs.start(parsed, sink, f"{folder}/ck")]

    bodies = tables.chat_payloads(spark, d)
    middle = tables.table(spark, d, "conversations").agg(F.max("conv_id") / 2).scalar()
    folder = _in_two_runs(spark, bodies, F.col("conv_id") < middle, attach)
    return events_log.read_log(spark, f"{folder}/log").select(
        "source_id", "ts_ms_utc", "semantic", "ingest_ts_ms_utc", "seq"
    )


@query
def stream_append(spark, d):
    """The log after a stream in which ids repeat later with other content."""

    def attach(stream, folder):
        copied = tables.with_copies(normalize.as_events(stream))
        return [jobs.start(copied, jobs.log_sink(f"{folder}/log"), f"{folder}/ck")]

    folder = _stream_events(spark, d, attach)
    log = events_log.read_log(spark, f"{folder}/log")
    return log.select(
        "event_id", *PAIR, "ts_ms_utc", "semantic", "ingest_ts_ms_utc",
        F.col("day").cast("string").alias("day"),
    )


@query
def stream_dedupe(spark, d):
    """Ids of a stream in which many repeat soon after."""

    def attach(stream, folder):
        once = jobs.dedupe_stream(tables.with_copies(stream)).select("event_id", *PAIR)
        return [jobs.start(once, jobs.changes_sink(f"{folder}/out"), f"{folder}/ck")]

    folder = _stream_events(spark, d, attach)
    return spark.read.parquet(f"{folder}/out").select("event_id", *PAIR)


@query
def stream_latest(spark, d):
    def attach(stream, folder):
        latest = jobs.latest_stream(stream)
        sink = jobs.changes_sink(f"{folder}/out")
        return [jobs.start(latest, sink, f"{folder}/ck", "update")]

    return jobs.read_changes(spark, f"{_stream_events(spark, d, attach)}/out")


@query
def stream_ring(spark, d):
    def attach(stream, folder):
        ring = jobs.ring_stream(stream, S.RING_EVENTS, S.RING_AGE_MS)
        sink = jobs.changes_sink(f"{folder}/out")
        return [jobs.start(ring, sink, f"{folder}/ck", "update")]

    return jobs.read_changes(spark, f"{_stream_events(spark, d, attach)}/out")


@query
def stream_embed(spark, d):
    model = hash_embedder()

    def attach(stream, folder):
        sink = jobs.embed_sink(
            f"{folder}/vectors", tables.sources(spark, d), tables.kinds(spark, d), model
        )
        return [jobs.start(stream, sink, f"{folder}/ck")]

    folder = _stream_events(spark, d, attach)
    stored = vector_store.load_vectors(spark, f"{folder}/vectors", model.model_id, model.dim)
    return stored.select("event_id", *PAIR, "truncated", F.size("vector").alias("width"))


def _fanned_out(spark, d) -> str:
    def attach(stream, folder):
        sinks = {
            "log": jobs.log_sink(f"{folder}/log"),
            "forward": jobs.forward_sink(f"{folder}/hub", "kitchen"),
        }
        sinks = {n: jobs.logged(n, f"{folder}/commits", s) for n, s in sinks.items()}
        rows = normalize.as_events(stream)
        return jobs.fan_out(lambda: rows, sinks, f"{folder}/ck", every=None).values()

    return _stream_events(spark, d, attach)


@query
def stream_forward(spark, d):
    """What a hub receives while the log is written by a query of its own."""
    return spark.read.parquet(f"{_fanned_out(spark, d)}/hub").select(
        "event_id", "source_id", "kind", "ts_ms_utc", "semantic"
    )


@query
def stream_progress(spark, d):
    commits = jobs.read_commits(spark, f"{_fanned_out(spark, d)}/commits")
    return health.sink_progress(commits).select("sink", "batches", "rows", "errors")


# --- several sites -----------------------------------------------------------


@query
def federated_state(spark, d):
    """Latest rows here and at a hub that received them with this site's prefix."""
    here = state.latest_by_event_time(tables.events(spark, d)).select(
        *PAIR, "event_id", "ts_ms_utc"
    )
    hub = here.withColumn("source_id", F.concat(F.lit("site."), "source_id"))
    return federation.merge_peer(
        here.withColumn("peer_id", F.lit(None).cast("string")), hub, "hub", ("site.user.1*",)
    )


def _federated(spark, d) -> federation.Federated:
    """Peers as stored tables: a hub, one that is not there and one whose files are no tables."""
    folder = run_folder(spark, "peers")
    here = state.latest_by_event_time(tables.events(spark, d)).select(*PAIR, "event_id", "ts_ms_utc")
    hub = here.withColumn("source_id", F.concat(F.lit("site."), "source_id"))
    hub.write.parquet(f"{folder}/hub")
    here.select("event_id").write.text(f"{folder}/torn")
    peers = [Peer(name, f"{folder}/{name}") for name in ("hub", "gone", "torn")]
    return federation.federate(here, peers, ("site.user.1*",))


@query
def federated_paths(spark, d):
    return _federated(spark, d).rows


@query
def federated_status(spark, d):
    return _federated(spark, d).status.select("peer_id", "status")


def _described_everywhere(spark, d) -> federation.Federated:
    """Descriptions here and at a hub; one peer is not there and one is given no time."""
    folder = run_folder(spark, "peers")
    declared = descriptors.resolve_descriptors(tables.sources(spark, d), tables.kinds(spark, d))
    columns = [*PAIR, "kind_version", "description", "freshness_ttl_ms"]
    here = declared.where(F.col("source_id").startswith("user.1")).select(*columns)
    there = declared.withColumn("source_id", F.concat(F.lit("site."), "source_id")).select(*columns)
    there.write.parquet(f"{folder}/hub")
    peers = [Peer("hub", f"{folder}/hub"), Peer("gone", f"{folder}/gone"), Peer("late", f"{folder}/hub", wait_ms=0)]
    return federation.federate_within(here, peers, 600_000, ("site.user.2*",))


@query
def federated_describe(spark, d):
    return _described_everywhere(spark, d).rows


@query
def federated_describe_status(spark, d):
    return _described_everywhere(spark, d).status.select("peer_id", "status")


@query
def forward_projection(spark, d):
    rows = normalize.normalize(tables.events(spark, d), ARRIVAL)
    return federation.forward_events(rows, "kitchen").select(
        "event_id", "source_id", "kind", "ts_ms_utc", "semantic"
    )
