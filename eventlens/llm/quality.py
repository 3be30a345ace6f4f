"""Quality rules: fixed rules on a document's own words, and lines that many documents share.

A line is normalised (lower case, digits as 0, white space as single blanks) and hashed. For each
host the distinct documents that hold the line are counted, copies of one text as one
document. A line in more than `max_docs` documents of a host is removed from every document of
that host but the first (smallest doc_id); a document that loses more than `max_removed` of
its words is rejected. `source` stands for the host where documents have no address.

Nulls: a null text has no words (and fails for that); a null host is a host of its own; a row
without doc_id is never the first. Repeated rows get equal results. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import WORD, let, table, word_count, words_of

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_DOCS = 10
MAX_REMOVED = 0.5
_KEY = ["_id", "_host", "_text"]


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more.

    Windows are compared by 64-bit hashes. Texts without a repeated window, the most, need no sort.
    """
    count = F.size(words)
    windows = F.when(
        count >= 3,
        F.transform(
            F.sequence(F.lit(0), count - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        at = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(pairs: Column) -> Column:
            same = F.filter(
                pairs,
                lambda p, k: (F.coalesce(F.get(pairs, k - 1)["h"] == p["h"], F.lit(False)))
                | (F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False))),
            )
            return F.sort_array(F.transform(same, lambda p: p["i"]))

        first = F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last"))
        total = F.aggregate(
            let(at, starts),
            first,
            lambda s, i: F.struct((s["sum"] + F.least(F.lit(3), i - s["last"])).alias("sum"), i.alias("last")),
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(total["sum"])

    return let(windows, covered)


def measures(text: Column) -> Column:
    """The fixed rules' figures for a text without nulls, as one struct."""

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    return let(words_of(text), of)


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " ")), r"[0-9]", "0")


def frequent_lines(
    docs: DataFrame, host: str = "source", id_col: str = "doc_id", max_docs: int = MAX_DOCS
) -> DataFrame:
    """Per document and line above the limit (not in the line's first document): its hash and words.

    Columns: `_id`, `_host`, `_text` (hash of the whole text), `row` (tells repeated rows apart), `hash`, `words`.
    """
    lines = docs.withColumn("row", F.monotonically_increasing_id()).select(
        F.col(id_col).alias("_id"),
        F.col(host).cast("string").alias("_host"),
        F.xxhash64("text").alias("_text"),
        "row",
        F.explode(lines_with_words(F.col("text"))).alias("line"),
    ).select(*_KEY, "row", F.xxhash64(normalised(F.col("line"))).alias("hash"), word_count(F.col("line")).alias("words"))
    limits = (
        lines.groupBy("_host", "hash", "_text")
        .agg(F.min("_id").alias("first"))
        .groupBy("_host", "hash")
        .agg(F.count("*").alias("docs"), F.min("first").alias("first"))
        .filter(F.col("docs") > max_docs)
        .select(F.col("_host").alias("h"), F.col("hash").alias("l"), "first")
    )
    same = F.col("_host").eqNullSafe(F.col("h")) & (F.col("hash") == F.col("l"))
    other = F.coalesce(F.col("_id") != F.col("first"), F.lit(True))
    return lines.join(limits, same & other).select(*_KEY, "row", "hash", "words")


_MADE = ["figures", "n_symbols", "n_dup_lines", "base_failed", "removed_words", "removed", "kept"]


def apply_rules(
    docs: DataFrame,
    host: str = "source",
    id_col: str = "doc_id",
    max_docs: int = MAX_DOCS,
    max_removed: float = MAX_REMOVED,
) -> DataFrame:
    """`docs` with `figures` (struct), `base_failed`, `removed_words`, `removed` (line hashes), `kept`.

    Columns of `docs` that have one of these names are replaced.
    """
    docs = docs.drop(*(c for c in _MADE if c not in (host, id_col)))
    text = F.coalesce(F.col("text"), F.lit(""))
    lost = (
        frequent_lines(docs.select(id_col, host, "text"), host, id_col, max_docs)
        .groupBy(*_KEY, "row")
        .agg(F.sum("words").alias("removed_words"), F.collect_set("hash").alias("removed"))
        .groupBy(*_KEY)  # repeated rows lose the same words
        .agg(F.max("removed_words").alias("removed_words"), F.max("removed").alias("removed"))
        .select(*(F.col(c).alias(f"{c}2") for c in _KEY), "removed_words", "removed")
    )
    same = F.lit(True)
    for c in _KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}2"))
    rows = docs.withColumns(
        {
            "figures": measures(text),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": let(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "_id": F.col(id_col),
            "_host": F.col(host).cast("string"),
            "_text": F.xxhash64("text"),
        }
    )
    n_words, n_repeat = F.col("figures.n_words"), F.col("figures.n_repeat_words")
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEATED_PERCENT * n_words)
    return (
        rows.join(lost, same, "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("removed_words") <= max_removed * n_words))
        .drop(*_KEY, *(f"{c}2" for c in _KEY))
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return apply_rules(docs).select(
        "doc_id",
        F.col("figures.n_words").alias("n_words"),
        F.col("figures.word_chars").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        F.col("figures.n_repeat_words").alias("n_repeat_words"),
        "removed_words",
        "base_failed",
        "kept",
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Kept documents without the lines above the limits."""
    bare = F.array_join(
        F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("removed"), F.xxhash64(normalised(x)))), "\n"
    )
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(bare)
    rows = apply_rules(docs.select("doc_id", "text", "lang", "source", "n_chars")).filter("kept").withColumn("text", text)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "text", "lang", "source", "n_chars")


ORACLE = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), tri AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM base WHERE len(words) >= 3)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM tri) WHERE c >= 2
), repeated AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r
), lines AS (
  SELECT r, doc_id, host, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w,
    regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]', '0', 'g') AS norm
  FROM (SELECT r, doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dups AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r
), limits AS (
  SELECT host, norm, min(doc_id) AS first FROM lines GROUP BY host, norm HAVING count(DISTINCT text) > 10
), removed AS (
  SELECT r, sum(w) AS n FROM lines JOIN limits USING (host, norm) WHERE doc_id IS DISTINCT FROM first GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(removed.n, 0) AS BIGINT) AS removed_words,
  len(words) < 50 OR 100 * coalesce(repeated.n, 0) > 50 * len(words) AS base_failed,
  NOT (len(words) < 50 OR 100 * coalesce(repeated.n, 0) > 50 * len(words))
    AND coalesce(removed.n, 0) <= 0.5 * len(words) AS kept
FROM base LEFT JOIN dups USING (r) LEFT JOIN repeated USING (r) LEFT JOIN removed USING (r)
"""
