"""Sharding by balanced label propagation: linked documents gather in shards of even size.

Documents are linked if their texts are equal. Every document starts in a shard that its hash chooses. Each group of
linked documents takes over the shard that holds most of them, whole, as far as the shard's quota reaches, in which all that
leave are counted as gone; large groups choose first. Groups that found the quota full move on to shards with room until none
is left that fits anywhere. Documents without links follow: they fill the shards up. So only groups larger than what is
left of every shard are cut; those follow each other through the gaps.

The law is `rows`: the shards' numbers of documents differ by one at most. Slots number the documents of a shard
without gaps: linked ones by group, then those that fill up. No task sees a whole shard or group (`running_sum`).

Sizes are the text's UTF-8 bytes plus 1. Nulls: a null text has no bytes, is linked to empty
ones, and rows without doc_id take part by their text. Repeated rows are told apart only by their slot. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import levels, running_sum, stored, table

SHARDS = 16
#: Groups above a shard's goal divided by this are placed one by one; there are SHARDS * LARGE at most.
LARGE = 64
#: Bits of the group and document hashes.
BITS = 60


def hash_bits(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITS)


def nodes(docs: DataFrame) -> DataFrame:
    """One narrow row per document: sizes, checksum, its group and its own hash, and whether it is linked."""
    text = F.coalesce("text", F.lit(""))
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            hash_bits(text).alias("grp"),
        ).withColumn("doc", hash_bits(F.coalesce("doc_id", F.lit(-1)), F.col("grp"), F.lit("shard"))),
        "shard-nodes",
    )
    linked = rows.groupBy("grp").count().filter("count > 1").select("grp", F.lit(True).alias("linked"))
    return rows.join(linked, "grp", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def propagate(linked: DataFrame, goals: list[int], rows: int) -> tuple[DataFrame, list[int]]:
    """(grp, label) of the groups of `linked` (`grp`, `doc`) that are placed whole, and what they leave of `goals`.

    `rows` is the number of all documents. A group that is not placed is larger than what is left of any shard.
    """
    shards = len(goals)
    blocks = linked.groupBy("grp", F.pmod("doc", F.lit(shards)).cast("int").alias("label")).agg(F.count("*").alias("n"))
    most = F.struct("n", F.xxhash64("grp", "label").alias("tie"), "label")  # ties must not favour a shard
    groups = stored(blocks.groupBy("grp").agg(F.sum("n").alias("n"), F.max(most)["label"].alias("to")), "shard-groups")
    rooms = list(goals)
    placed: list[DataFrame] = []

    def one_by_one(some: DataFrame) -> None:
        """Places a bounded number of groups, the largest first: in their own shard, or else where least is left over."""
        found = []
        for row in sorted(some.collect(), key=lambda r: (-r["n"], r["grp"])):
            fits = [(j != row["to"], rooms[j], j) for j in range(shards) if rooms[j] >= row["n"]]
            if fits:
                at = min(fits)[-1]
                rooms[at] -= row["n"]
                found.append((row["grp"], at))
        if found:
            placed.append(linked.sparkSession.createDataFrame(found, "grp long, label int"))

    def settled(some: DataFrame, fits: Column) -> DataFrame:
        """Takes the groups for which `fits` holds to shard `to`; the others."""
        tried = stored(some.withColumn("fits", fits), "shard-tried")
        done = tried.filter("fits")
        for row in done.groupBy("to").agg(F.sum("n").alias("n")).collect():
            rooms[row["to"]] -= row["n"]
        placed.append(done.select("grp", F.col("to").alias("label")))
        return tried.filter("NOT fits").select("grp", "n", "to")

    # A shard has room for LARGE groups of this size at most, so they are few. Those above a shard are never whole.
    large = max(1, max(goals) // LARGE)
    one_by_one(groups.filter((F.col("n") > large) & (F.col("n") <= max(goals))))
    # Large ones first. The upper bits of the order are the size's, so levels are finer by as many.
    order = F.shiftleft(63 - F.floor(F.log2("n")).cast("long"), BITS - 6) + F.shiftright("grp", 6)
    small = groups.filter(F.col("n") <= large).withColumn("order", order)
    small = running_sum(small, ["to"], "order", "n", "before", levels(rows << 6, BITS), ["grp"])
    waiting = settled(small, F.col("before") + F.col("n") <= F.get(F.lit(rooms), F.col("to")))
    # The others in a row along what is left of the shards: all but those across a border fit.
    waiting = running_sum(waiting.filter(F.col("n") <= max(rooms)).withColumn("order", order), [], "order", "n", "before", levels(rows << 6, BITS), ["grp"])
    ends = [sum(rooms[: j + 1]) for j in range(shards)]
    waiting = waiting.withColumn("to", F.size(F.filter(F.lit(ends), lambda end: end <= F.col("before"))))
    one_by_one(settled(waiting, F.col("before") + F.col("n") <= F.get(F.lit(ends), F.col("to"))))  # fewer than shards
    return reduce(DataFrame.unionByName, placed), rooms


def numbered(frame: DataFrame, keys: list[str], into: str, by_rows: list[int]) -> DataFrame:
    """`frame` with its rows numbered from 0 for the same `keys`: by group, and by hash in a group."""
    within = running_sum(frame.withColumn("one", F.lit(1).cast("long")), [*keys, "grp"], "doc", "one", "within", by_rows, ["doc_id"])
    blocks = frame.groupBy(*keys, "grp").agg(F.count("*").alias("n"))
    blocks = running_sum(blocks, keys, "grp", "n", "before", by_rows).select(*keys, "grp", "before")
    rows = within.join(blocks, [*keys, "grp"]).withColumn(into, F.col("before") + F.col("within"))
    return rows.drop("before", "within", "one")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """`doc_id`, `size`, `text_crc32`, `grp`, `shard`, `slot` for each row of `docs` (`doc_id`, `text`)."""
    every = stored(nodes(docs), "shard-linked")
    rows = every.count()
    goals = [rows * (j + 1) // shards - rows * j // shards for j in range(shards)]
    by_rows = levels(rows, BITS)
    linked = every.filter("linked").drop("linked")
    labels, rooms = propagate(linked, goals, rows)
    state = stored(linked.join(labels, "grp", "left"), "shard-labels")
    whole = numbered(state.filter(F.col("label").isNotNull()), ["label"], "slot", by_rows)

    # What is left of the goals is filled up with the groups that found no room, one after the other, then with the others.
    cut = stored(numbered(state.filter(F.col("label").isNull()).drop("label"), [], "place", by_rows), "shard-cut")
    rest = every.filter(~F.col("linked")).drop("linked").withColumn("one", F.lit(1).cast("long"))
    rest = running_sum(rest, [], "doc", "one", "place", by_rows, ["doc_id"]).drop("one")
    rest = cut.unionByName(rest.withColumn("place", F.col("place") + cut.count()))
    ends = [sum(rooms[: j + 1]) for j in range(shards)]
    starts = [goal - end for goal, end in zip(goals, ends, strict=True)]
    rest = rest.withColumn("shard", F.size(F.filter(F.lit(ends), lambda end: end <= F.col("place"))))
    # of a shard's slots, the last ones are left
    rest = rest.withColumn("slot", F.col("place") + F.get(F.lit(starts), F.col("shard")))
    out = ["doc_id", "size", "text_crc32", "grp", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot")]
    return whole.withColumn("shard", F.col("label")).select(*out).unionByName(rest.select(*out))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
