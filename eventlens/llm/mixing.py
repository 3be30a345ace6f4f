"""Mixing sources to target weights by weighted fair queueing.

Each document of a source follows the source's others in a shuffled, reproducible order, up to
`max_copies` times over. A copy's virtual finish time is the source's words up to and with it,
divided by the source's target; all copies are put in order of finish time over all sources and taken while
their words fit the total budget. Sources therefore advance in step, and each ends within
one document of its target.

Targets: the budget is shared by weight; a source that would get more than `max_copies` times
its words stops there and its excess is shared among the others by weight, until none is above.

Nulls: a null text has no words and is taken 0 times; a null source is a source of its own, the last;
rows without doc_id are ordered by their text. Ties of the shuffle go by doc_id and text,
so reruns agree; equal rows are told apart only by their place. Other columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.llm.common import levels, running_sum, stored, table, word_count

MAX_COPIES = 3
SEED = "mix"
#: Bits of the shuffle key and of the fraction of a virtual time.
KEY_BITS, TIME_BITS = 60, 40


def shuffle_key(*columns: Column) -> Column:
    text = F.concat_ws(":", F.lit(SEED), *(F.coalesce(c.cast("string"), F.lit("-")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def cycle_weights(rank: Column) -> Column:
    """1, 2, 3, 1, 2, 3, ... over the sources in order."""
    return (rank - 1) % 3 + 1


def targets(sizes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """Per source (`source`, `source_size`): its rank, weight and target.

    A source stays at its cap if the level, words per weight, that the sources with
    smaller caps per weight leave to the rest is above its own cap per weight.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rows = sizes.withColumn("rank", F.row_number().over(ordered)).withColumn(
        "weight", cycle_weights(F.col("rank")).cast("long")
    )
    cap = F.col("source_size") * max_copies
    by_cap = Window.orderBy(cap / F.col("weight"), "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_cap.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(
        from_here
    )
    rows = rows.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") > cap)
    open_level = F.min(F.when(~F.col("capped"), F.struct(cap / F.col("weight"), "rank", "level"))).over(whole)["level"]
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("weight") * open_level)
    return rows.select("source", "source_size", "rank", target.alias("target"))


def mix(docs: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """`doc_id`, `source`, `key`, `size`, `source_size`, `target`, `taken` (words) per document.

    `docs` has `doc_id`, `source`, `text`; counting words is the only work on texts.
    """
    spark = docs.sparkSession
    by_text = F.when(F.col("doc_id").isNull(), F.md5("text"))
    sized = stored(
        docs.select(
            "doc_id",
            "source",
            shuffle_key(F.col("doc_id"), by_text).alias("key"),
            F.coalesce(word_count(F.col("text")), F.lit(0)).cast("long").alias("size"),
            F.md5("text").alias("digest"),
        ),
        "mix-sizes",
    )
    rows = max(sized.count(), 1)
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stored(targets(sums, max_copies), "mix-targets")  # one row per source
    placed = sized.join(goals, sized["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    placed = running_sum(placed, ["rank"], "key", "size", "before", levels(rows, KEY_BITS), ["doc_id", "digest"])
    placed = stored(placed, "mix-places")

    # A copy that starts at or after its source's target lies behind copies that fill the budget.
    start = F.col("copy") * F.col("source_size") + F.col("before")
    copies = (
        placed.filter(F.col("size") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_copies - 1))))
        .filter(start < F.col("target"))
        .withColumn("finish", (start + F.col("size")) / F.col("target"))
        .withColumn("time", F.floor(F.least("finish", F.lit(float(1 << 20))) * (1 << TIME_BITS)).cast("long"))
    )
    shifts = levels(max_copies * rows, TIME_BITS)
    queue = running_sum(
        copies.select("rank", "before", "copy", "finish", "time", "size"),
        [],
        "time",
        "size",
        "queued",
        [*shifts, TIME_BITS + 8, 63],
        ["finish", "rank", "copy", "before"],
    )
    budget = goals.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("budget"))
    total = budget.first()["budget"]
    taken = (
        queue.filter(F.col("queued") + F.col("size") <= total)
        .groupBy("rank", "before")
        .agg(F.sum("size").alias("words"))
    )
    # Only documents with words move `before` on, so (rank, before) names one of those.
    named = placed.withColumn("slot", F.when(F.col("size") > 0, F.col("before")))
    taken = taken.select(F.col("rank").alias("r"), F.col("before").alias("b"), "words")
    found = named.join(taken, (F.col("rank") == F.col("r")) & (F.col("slot") == F.col("b")), "left")
    return found.select(
        "doc_id",
        "source",
        "digest",
        "size",
        "source_size",
        "target",
        F.coalesce("words", F.lit(0)).cast("long").alias("taken"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def row_key() -> Column:
    """One value for equal rows; never null."""
    parts = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("doc_id", "source", "digest"))
    return F.md5(F.concat_ws(chr(1), *parts))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it does not take go.

    Equal rows share out the copies that the mix takes of them.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    copies = (
        mix(docs)
        .filter(F.col("taken") > 0)
        .groupBy(row_key().alias("row_key"))
        .agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("times"))
    )
    equal = Window.partitionBy("row_key")
    rows = (
        docs.select(*columns, F.md5("text").alias("digest"))
        .withColumn("row_key", row_key())
        .withColumn("place", F.row_number().over(equal.orderBy("lang", "n_chars")))
        .withColumn("rows", F.count("*").over(equal))
        .join(copies, "row_key")
    )
    times = F.floor((F.col("times") + F.col("rows") - F.col("place")) / F.col("rows")).cast("int")
    return (
        rows.withColumn("times", times)
        .filter(F.col("times") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select(*columns)
    )


ORACLE = r"""
WITH sized AS (
  SELECT row_number() OVER () AS r, doc_id, source, md5(text) AS digest,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' ||
      CASE WHEN doc_id IS NULL THEN coalesce(md5(text), '-') ELSE '-' END), 1, 15) AS BIGINT) AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") AS rank FROM sums
), weighed AS (
  SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM ranked
), levelled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, rank)
), goals AS (
  SELECT source, source_size, rank, CASE WHEN level * weight > cap THEN CAST(cap AS DOUBLE)
    ELSE weight * first(level ORDER BY level * weight > cap, cap / weight, rank) OVER () END AS target
  FROM levelled
), placed AS (
  SELECT sized.*, source_size, rank, target,
    sum(size) OVER (PARTITION BY rank ORDER BY key, doc_id, digest ROWS UNBOUNDED PRECEDING) - size AS before
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source
), copies AS (
  SELECT *, (copy * source_size + before + size) / target AS finish
  FROM placed, (VALUES (0), (1), (2)) c(copy) WHERE size > 0 AND copy * source_size + before < target
), queued AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, copy, before ROWS UNBOUNDED PRECEDING) AS upto FROM copies
), taken AS (
  SELECT r, sum(size) AS words FROM queued WHERE upto <= (SELECT sum(source_size) FROM goals) GROUP BY r
)
SELECT doc_id, size, source_size, target, CAST(coalesce(words, 0) AS BIGINT) AS taken
FROM placed LEFT JOIN taken USING (r)
"""
