"""Configuration as small tables, so that its size never becomes the size of a plan."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def config_table(spark: SparkSession, rows: Sequence[dict], schema: str) -> DataFrame:
    """Rows of the configuration as a local relation.

    Spark knows its size and broadcasts it or not by its own threshold.
    """
    fields = T._parse_datatype_string(schema)
    return spark.createDataFrame(pa.Table.from_pylist(list(rows), to_arrow_schema(fields)), fields)
