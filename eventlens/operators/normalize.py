"""Producer events to canonical events, and the soft schema check."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.rules import RULES, NotRules, holds, rules_of
from eventlens.functions.scalars import generated_id, kind_name, kind_version
from eventlens.functions.schemas import valid_variant
from eventlens.model import EVENT, EVENT_COLUMNS
from eventlens.operators.lookup import config_table
from eventlens.operators.ordered import ROWS_PER_RANGE, running_totals


@dataclass(frozen=True)
class KindSchema:
    """A declared kind version; ``schema`` may be missing."""

    name: str
    version: str = "v1"
    schema: dict | bool | None = None


@dataclass(frozen=True)
class SchemaBook:
    """Schemas of the configuration.

    ``sources`` maps source ids to schemas that replace those of any kind.
    """

    sources: dict[str, dict | bool]
    kinds: Sequence[KindSchema]


def declared_schemas(sources: DataFrame, kinds: DataFrame) -> SchemaBook:
    """The schemas that descriptors declare in ``semantic_schema``; descriptors are configuration, a row each."""
    own = sources.where("semantic_schema is not null").select("source_id", "semantic_schema").collect()
    listed = kinds.select("name", F.coalesce("version", F.lit("v1")).alias("version"), "semantic_schema").collect()
    return SchemaBook(
        sources={r["source_id"]: json.loads(r["semantic_schema"]) for r in own},
        kinds=[
            KindSchema(r["name"], r["version"], json.loads(r["semantic_schema"]) if r["semantic_schema"] else None)
            for r in listed
        ],
    )


def latest_versions(kinds: DataFrame) -> DataFrame:
    """Greatest version per kind by text order (``v10`` is below ``v2``).

    Kinds without a schema count: a schemaless newest version turns the check
    off for events that pin none.
    """
    return kinds.groupBy("name").agg(
        F.max(F.coalesce("version", F.lit("v1"))).alias("version")
    )


def validate_semantic(events: DataFrame, book: SchemaBook) -> DataFrame:
    """Add ``schema_invalid``: true where a schema applies and fails, else null.

    Lookup joins with tables made of the configuration, which Spark broadcasts by their size, pick a schema
    number and the schema's rules, so plans do not grow with the number of schemas. Only schemas that
    rules cannot express (`functions.rules`) are compiled, each distinct one once.
    """
    spark = events.sparkSession
    texts: dict[str, int] = {}

    def number(schema: dict | bool) -> int:
        return texts.setdefault(json.dumps(schema, sort_keys=True), len(texts))

    by_source = [(source, number(schema)) for source, schema in book.sources.items()]
    newest: dict[str, str] = {}
    declared: dict[tuple[str, str], int] = {}
    for kind in book.kinds:
        newest[kind.name] = max(newest.get(kind.name, kind.version), kind.version)
        if kind.schema is not None:
            declared[kind.name, kind.version] = number(kind.schema)
    # A missing version stands for "the newest", resolved here once.
    by_kind = [(n, v, i) for (n, v), i in declared.items()]
    by_kind += [(n, "", declared[n, v]) for n, v in newest.items() if (n, v) in declared]

    source_table = config_table(
        spark, [{"source_id": s, "__by_source": i} for s, i in by_source], "source_id string, __by_source int"
    )
    kind_table = config_table(
        spark,
        [{"__name": n, "__version": v, "__by_kind": i} for n, v, i in by_kind],
        "__name string, __version string, __by_kind int",
    )
    rules, compiled = [], {}
    for text, i in texts.items():
        try:
            rules.append({"__schema": i, "__rules": rules_of(json.loads(text))})
        except NotRules:
            compiled[text] = i
    rule_table = config_table(spark, rules, f"__schema int, __rules {RULES}")
    picked = (
        events.withColumn("__name", kind_name(F.col("kind")))
        .withColumn("__version", F.coalesce(kind_version(F.col("kind")), F.lit("")))
        .join(source_table, "source_id", "left")
        .join(kind_table, ["__name", "__version"], "left")
        .withColumn("__schema", F.coalesce("__by_source", "__by_kind"))
        .join(rule_table, "__schema", "left")
        # a column of its own, parsed once and only where a schema applies
        .withColumn("__node", F.when(F.col("__schema").isNotNull(), F.try_parse_json("semantic")))
    )
    node = F.col("__node")
    ruled = F.col("__rules").isNotNull()
    broken = node.isNull() | ~holds(node, F.col("__rules"))
    invalid: Column = F.when(ruled, F.when(broken, True))
    for text, i in compiled.items():
        bad = F.when(~valid_variant(node, json.loads(text)), True)
        invalid = invalid.when(F.col("__schema") == i, bad)
    kept = [c for c in events.columns if c != "schema_invalid"]
    return picked.select(*kept, invalid.alias("schema_invalid"))


def normalize(
    events: DataFrame,
    arrival: Sequence[str],
    now_ms: int | None = None,
    book: SchemaBook | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Number events per source and fill what producers may leave out.

    ``arrival`` names non-null columns that order the rows of a source without
    ties.  ``now_ms`` is the ingest time; without it an existing
    ``ingest_ts_ms_utc`` is kept.  Generated ids derive from the row, so running
    the job again gives the same ids.  Extra columns are carried along.
    """
    if "schema_invalid" not in events.columns:
        events = events.withColumn("schema_invalid", F.lit(None).cast("boolean"))
    if now_ms is not None:
        events = events.withColumn("ingest_ts_ms_utc", F.lit(now_ms).cast("long"))
    numbered = running_totals(
        events.drop("seq"), ["source_id"], arrival, {"seq": F.lit(1)},
        rows_per_range=rows_per_range,
    )
    if book is not None:
        numbered = validate_semantic(numbered, book)
    identity = [F.col(c) for c in ("source_id", "ts_ms_utc", "semantic", *arrival)]
    ids = {
        column: F.coalesce(
            F.col(column) if column in events.columns else F.lit(None).cast("string"),
            generated_id(F.col("ingest_ts_ms_utc"), F.lit(column), *identity),
        )
        for column in ("event_id", "trace_id")
    }
    filled = numbered.withColumns({**ids, "seq": F.col("seq").cast("long")})
    return as_events(filled)


def as_events(rows: DataFrame) -> DataFrame:
    """Add the event columns a frame lacks as nulls; other columns come last."""
    missing = {
        f.name: F.lit(None).cast(f.dataType) for f in EVENT if f.name not in rows.columns
    }
    extra = [c for c in rows.columns if c not in EVENT_COLUMNS]
    return rows.withColumns(missing).select(*EVENT_COLUMNS, *extra)
