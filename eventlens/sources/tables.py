"""The sample tables seen as events, payloads, messages and vectors.

The sample data has no event envelope, so these views give it one.  They are
plain projections (one equi-join for vectors) and keep Spark's pruning.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW_MS = 1_706_659_200_000  # 2024-01-31, just after the last sample event
DAY_MS = 86_400_000
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ntz(ms: int):
    moment = datetime.fromtimestamp(ms // 1000, UTC) + timedelta(milliseconds=ms % 1000)
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def _utc_millis(ntz: Column) -> Column:
    """Epoch milliseconds of a zoneless time taken as UTC, whatever the session's zone is."""
    return F.unix_millis(F.from_utc_timestamp(ntz.cast("timestamp"), F.current_timezone()))


def events_from(raw: DataFrame) -> DataFrame:
    """The sample ``events`` table, batch or stream, in the canonical columns."""
    number = F.col("event_id")
    ts_ms = _utc_millis(F.col("ts"))
    version = F.when(number % 10 == 0, "@v2").otherwise("")
    return raw.select(
        F.lpad(number.cast("string"), 26, "0").alias("event_id"),
        F.concat(F.lit("user."), F.col("user_id").cast("string")).alias("source_id"),
        F.concat("event_type", version).alias("kind"),
        ts_ms.alias("ts_ms_utc"),
        F.col("props").alias("semantic"),
        (ts_ms + (number % 7) * 1000).alias("ingest_ts_ms_utc"),
    )


def events(
    spark: SparkSession, sf_dir: str, start_ms: int | None = None, end_ms: int | None = None
) -> DataFrame:
    """Sample events; a known time range is also given to the Parquet scan."""
    raw = table(spark, sf_dir, "events")
    if start_ms is not None:
        raw = raw.where(F.col("ts") >= _ntz(start_ms))
    if end_ms is not None:
        raw = raw.where(F.col("ts") < _ntz(end_ms))
    return events_from(raw)


def with_copies(rows: DataFrame) -> DataFrame:
    """Every row, and a later changed copy of those whose id ends in 0 or 5."""
    copies = rows.where(F.right("event_id", F.lit(1)).isin("0", "5")).withColumns(
        {
            "ingest_ts_ms_utc": F.col("ingest_ts_ms_utc") + 60_000,
            "semantic": F.lit('{"copy":true}'),
        }
    )
    return rows.unionByName(copies)


def vectors(spark: SparkSession, sf_dir: str, model_id: str) -> DataFrame:
    """``embeddings`` as vectors of events spread over the whole table."""
    rows = table(spark, sf_dir, "events").agg(F.count("*")).scalar()
    number = F.col("vec_id") * 7919 % rows
    stored = table(spark, sf_dir, "embeddings").select(
        F.lpad(number.cast("string"), 26, "0").alias("event_id"),
        F.col("embedding").alias("vector"),
    )
    described = events(spark, sf_dir).select("event_id", "source_id", "kind", "ts_ms_utc")
    return stored.join(described, "event_id").select(
        "event_id", "source_id", "kind", "ts_ms_utc",
        F.lit(False).alias("truncated"), F.lit(model_id).alias("model_id"), "vector",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as producer batches: one batch per conversation."""
    turn = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("batch_id"),
        turn.alias("ord"),
        F.concat(F.lit("edge"), (F.col("conv_id") % 3).cast("string")).alias("token_name"),
        (F.lit(NOW_MS) + F.col("conv_id") * 400).alias("at_ms"),
        F.concat(
            F.lpad(F.col("conv_id").cast("string"), 20, "0"),
            F.lpad(turn.cast("string"), 6, "0"),
        ).alias("event_id"),
        F.concat(F.lit("chat."), "role").alias("source_id"),
        F.lit("message").alias("kind"),
        (F.lit(NOW_MS) + F.col("conv_id") * 400 + turn).alias("ts_ms_utc"),
        F.to_json(F.struct("text")).alias("semantic"),
    )


def chat_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as request bodies of the three accepted shapes.

    Every turn is one body: wrapped, bare or single by turn; some carry an
    unknown field, an empty list or broken text.
    """
    rows = table(spark, sf_dir, "conversations")
    event = F.struct(
        F.concat(F.lit("chat."), "role").alias("source_id"),
        F.lit("message").alias("kind"),
        (F.lit(NOW_MS) + F.col("conv_id") * 400 + F.col("turn")).alias("ts_ms_utc"),
        F.struct("text").alias("semantic"),
    )
    odd = F.struct(event["source_id"].alias("source_id"), F.lit(1).alias("surplus"))
    shape = (F.col("conv_id") + F.col("turn")) % 7
    body = (
        F.when(shape == 0, F.to_json(F.struct(F.array(event, event).alias("events"))))
        .when(shape == 1, F.to_json(F.array(event)))
        .when(shape == 2, F.to_json(F.struct(F.array(odd).alias("events"))))
        .when(shape == 3, F.lit('{"events":[]}'))
        .when(shape == 4, F.concat(F.to_json(event), F.lit("}")))
        .otherwise(F.to_json(event))
    )
    return rows.select("conv_id", "turn", body.alias("body"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as messages on topics, with payloads in all four formats."""
    number, kind = F.col("event_id"), F.col("event_type")
    user = F.col("user_id").cast("string")
    tail = F.when(number % 7 == 0, "/extra").otherwise("")
    typed = F.when(number % 3 == 0, F.lit('{"type":42}')).otherwise(F.lit('{"type":"buy"}'))
    body = (
        F.when(kind == "view", F.concat(user, F.lit(',"a""b",'), "props"))
        .when(kind == "purchase", typed)
        .otherwise(F.col("props"))
    )
    return table(spark, sf_dir, "events").select(
        number.alias("message_no"),
        F.concat(F.lit("broker"), (number % 2).cast("string")).alias("broker_id"),
        F.concat(F.lit("site/"), kind, F.lit("/user/"), user, tail).alias("topic"),
        F.encode(body, "UTF-8").alias("payload"),
        _utc_millis(F.col("ts")).alias("ts_ms"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One declared source per user, with varying kinds, texts and freshness."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    user = F.col("user_id")
    few = F.array(F.lit("click"), F.lit("view"), F.lit("unheard"))
    every = F.array(*[F.lit(k) for k in EVENT_TYPES])
    return users.select(
        F.concat(F.lit("user."), user.cast("string")).alias("source_id"),
        F.when(user % 3 == 0, few).otherwise(every).alias("kinds"),
        F.when(user % 2 == 0, F.concat(F.lit("User "), user.cast("string")))
        .otherwise("")
        .alias("description"),
        F.lit("").alias("usage"),
        F.lit(None).cast("string").alias("caveats"),
        F.when(user % 5 == 0, F.lit('{"type":"object"}')).alias("semantic_schema"),
        F.when(user % 4 == 0, F.lit("count")).alias("units"),
        F.lit(1000).cast("long").alias("sampling_hint_ms"),
        F.when(user % 2 == 0, (user % 10 + 1) * (DAY_MS // 2)).alias("freshness_ttl_ms"),
        F.lit(None).cast("string").alias("location"),
        F.when(user % 7 == 0, user % 2 == 0).alias("embed"),
        user.cast("int").alias("ord"),
    )


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared kinds: every event type once, and ``click`` in two more versions."""
    types = table(spark, sf_dir, "events").select("event_type").distinct()
    version = F.explode(
        F.when(
            F.col("event_type") == "click", F.array(F.lit("v1"), F.lit("v2"), F.lit("v10"))
        ).otherwise(F.array(F.lit(None).cast("string")))
    )
    name = F.col("name")
    return types.select(F.col("event_type").alias("name"), version.alias("version")).select(
        name,
        "version",
        F.concat(F.lit("Kind "), name).alias("description"),
        F.lit("read only").alias("usage"),
        F.when(name == "error", "noisy").alias("caveats"),
        F.when(name == "view", F.lit('{"required":["k"]}')).alias("semantic_schema"),
        F.when(name == "purchase", "EUR").alias("units"),
        F.when(name.isin("click", "view"), True).when(name == "error", False).alias("embed"),
        F.coalesce(F.substring("version", 2, 3).cast("int"), F.lit(1)).alias("ord"),
    )
