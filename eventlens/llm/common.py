"""What several operators share: tables, words, let-bindings, shared storage, numbering."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows that one group of the finest level of `running_sum` holds on average.
GROUP_ROWS = 64
#: Each further level of `running_sum` merges so many groups, as a power of two.
LEVEL_BITS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is evaluated once however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def shared_path(spark: SparkSession, label: str) -> str:
    """An unused path below the folder that `spark.checkpoint.dir` names.

    Where that is unset (tests), the folder is one in the warehouse, which all executors share too.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, label: str) -> DataFrame:
    """`frame` written once to the shared folder and read back, so that its lineage ends."""
    spark = frame.sparkSession
    path = shared_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def levels(rows: int, width: int) -> list[int]:
    """Shifts that group keys of `width` bits, from about GROUP_ROWS rows a group up to one group."""
    fine = max(0, math.ceil(math.log2(max(rows, 1) / GROUP_ROWS)))
    shifts = [max(0, width - fine)]
    while shifts[-1] < width:
        shifts.append(min(width, shifts[-1] + LEVEL_BITS))
    return shifts


def running_sum(
    frame: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    into: str,
    shifts: Sequence[int],
    ties: Sequence[str] = (),
) -> DataFrame:
    """Sum of `value` over the rows of the same `keys` that come before each row.

    `order` is a long that is never negative; rows of equal `order` follow each other by
    `ties`. No task sees a whole key: the rows of a key are summed in groups of equal
    `order >> shifts[0]`, the groups in groups of equal `order >> shifts[1]`, and so on;
    the sum before a row is that within its group plus those before its groups. Rows that
    agree in `order` and `ties` get different sums if their values are not 0. `keys` have
    to be without nulls. Rows of any other column come through unchanged.
    """
    names = [f"_g{i}" for i in range(len(shifts))]
    keys = list(keys)
    rows = frame.withColumn(names[0], F.shiftright(F.col(order), shifts[0]))
    inner = Window.partitionBy(*keys, names[0]).orderBy(order, *ties)
    rows = rows.withColumn(
        into, F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    )
    sums = frame.groupBy(*keys, F.shiftright(F.col(order), shifts[0]).alias(names[0])).agg(
        F.sum(value).alias("_sum")
    )
    before: DataFrame | None = None
    chain = []
    for level in range(1, len(shifts)):
        lower, upper = names[level - 1], names[level]
        grouped = sums.withColumn(upper, F.shiftright(F.col(lower), shifts[level] - shifts[level - 1]))
        window = Window.partitionBy(*keys, upper).orderBy(lower).rowsBetween(Window.unboundedPreceding, 0)
        chain.append(grouped.withColumn("_off", F.sum("_sum").over(window) - F.col("_sum")))
        sums = grouped.groupBy(*keys, upper).agg(F.sum("_sum").alias("_sum"))
    for level in range(len(chain), 0, -1):
        step = chain[level - 1].select(*keys, names[level - 1], names[level], "_off")
        if before is not None:
            step = step.join(before.withColumnRenamed("_off", "_more"), [*keys, names[level]]).withColumn(
                "_off", F.col("_off") + F.col("_more")
            )
        before = step.select(*keys, names[level - 1], "_off")
    if before is not None:
        rows = rows.join(before, [*keys, names[0]]).withColumn(into, F.col(into) + F.col("_off")).drop("_off")
    return rows.drop(names[0])
