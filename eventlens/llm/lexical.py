"""Ranked lexical search with bit-sliced Bloom signatures.

`build_index` turns documents into blocks of documents of like size. A block holds a matrix of bits, one row
per bit position and one column per document (a slice is such a row): each term of a document sets `HASHES` bits of
its column, once per level of `LEVELS` that its number of occurrences reaches. The block also holds each
document's terms and counts, sorted, for the exact score.

`search` reads the blocks. The conjunction of a term's slices is a bitmap of documents that may hold the term; it
names every document that does, and some that do not. The highest level whose bitmap names a document bounds the
occurrences from above, and the sum of the query terms' weights times the greatest value at that level
is an upper bound of the document's score. A document is left out only if its bound is
below the k-th best exact score that the task has already found for the query; all others are scored exactly.
Every task gives its best k, the best k of those are the result.

Blocks of documents meet blocks of queries by an equi-join on the block of queries and a spread number, so
neither documents nor queries are collected, and a block's matrix is bounded (`MATRIX`). Terms stand for their
64-bit hashes. The weights need N, L and the document frequencies of the queries' terms, which are exact and
cover all documents.

Nulls: a null text has no terms; neither has an empty one; a query without terms has no result. A
row without doc_id is ranked like others and comes after those with equal scores. Repeated rows are documents of their own and
take a rank each. Rows of queries with one id are one query that has all their terms. Texts are read
whole, however long; other columns are ignored; an empty table of documents or queries gives an empty result.
"""

from __future__ import annotations


from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.llm.common import shared_path, stored, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Occurrences from which a term counts as reaching a level.
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 32, 64)
HASHES = 4
#: Bits of a signature per entry (term and level); the next power of two is taken.
BITS_PER_ENTRY = 8
#: Most documents and bits of one block's matrix (a single longer document is a block of its own).
BLOCK_DOCS, MATRIX = 1024, 1 << 25
#: Terms of one block, beyond which it is closed.
BLOCK_TERMS = 1 << 18
#: Blocks of a row group of the stored index, which is what a reading task holds at a time.
ROW_GROUP = 4
#: Queries of one block, on average, and terms that are looked up at once in a block of documents.
QUERY_BLOCK, TERM_STEP = 512, 2048
#: Spread numbers by which blocks of documents and of queries are joined.
SPREAD = 64
#: Terms whose hashes a worker remembers.
MEMO = 200_000

INDEX = (
    "spread int, bits long, docs array<long>, lengths array<long>, firsts array<long>, "
    "terms array<long>, counts binary, slices binary"
)
HITS = "item_id long, doc_id long, score long"

#: Separators become blanks, A-Z are lower-cased; bytes from 0x80 on belong to terms.
_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def terms_of(text: Column) -> Column:
    """The terms of a text, in order, with repeats."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


class _Hashes(dict):
    """Hashes of terms as `xxhash64` of Spark gives them; starts anew when it holds `MEMO` terms."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = xxhash.xxh64_intdigest(term, seed=42)
        self[term] = value = value - (1 << 64) if value >= 1 << 63 else value
        return value


def positions(terms: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The bit positions of each term at a level, one row per term."""
    mixed = terms.view(np.uint64) + np.uint64((level * 0x9E3779B97F4A7C15) % (1 << 64))
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    parts = [(mixed + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(HASHES)]
    return np.stack(parts, axis=1).astype(np.int64)


class _Block:
    """Documents of like size, until they are written as one row of the index."""

    def __init__(self, bits: int):
        self.bits = bits
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, doc: int | None, length: int, terms: np.ndarray, counts: np.ndarray) -> None:
        self.docs.append(doc)
        self.lengths.append(length)
        self.terms.append(terms)
        self.counts.append(counts)
        self.held += len(terms)

    def full(self) -> bool:
        return len(self.docs) >= min(BLOCK_DOCS, max(1, MATRIX // self.bits)) or self.held >= BLOCK_TERMS

    def row(self, spread: int) -> dict:
        sizes = [len(t) for t in self.terms]
        terms, counts = np.concatenate(self.terms), np.concatenate(self.counts)
        columns = np.repeat(np.arange(len(sizes)), sizes)
        width = -(-len(sizes) // 8)
        matrix = np.zeros(self.bits * width, np.uint8)
        for level, least in enumerate(LEVELS):
            there = np.flatnonzero(counts >= least)
            where = positions(terms[there], level, self.bits)
            byte, bit = columns[there] >> 3, (128 >> (columns[there] & 7)).astype(np.uint8)
            for i in range(HASHES):
                np.bitwise_or.at(matrix, where[:, i] * width + byte, bit)
        return {
            "spread": spread,
            "bits": self.bits,
            "docs": self.docs,
            "lengths": self.lengths,
            "firsts": np.cumsum([0, *sizes]),
            "terms": terms,
            "counts": counts.astype("<i4").tobytes(),
            "slices": matrix.tobytes(),
        }


_SCHEMA = pa.schema(
    [
        ("spread", pa.int32()),
        ("bits", pa.int64()),
        *((name, pa.list_(pa.int64())) for name in ("docs", "lengths", "firsts", "terms")),
        ("counts", pa.binary()),
        ("slices", pa.binary()),
    ]
)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    known, open_blocks = _Hashes(), {}
    number = TaskContext.get().partitionId()

    def closed(block: _Block) -> pa.RecordBatch:
        nonlocal number
        number += 1
        return pa.RecordBatch.from_pylist([block.row(number % SPREAD)], _SCHEMA)

    for batch in batches:
        for doc, text in zip(batch.column("_doc").to_pylist(), batch.column("_text"), strict=True):
            said = Counter(text.as_buffer().to_pybytes().translate(_BYTES).split()) if text.is_valid else None
            if not said:
                continue
            terms = np.fromiter(map(known.__getitem__, said), np.int64, len(said))
            counts = np.fromiter(said.values(), np.int64, len(said))
            order = np.argsort(terms)
            terms, counts = terms[order], counts[order]
            entries = sum(int((counts >= least).sum()) for least in LEVELS)
            bits = 1 << (BITS_PER_ENTRY * max(entries, 32) - 1).bit_length()
            block = open_blocks.setdefault(bits, _Block(bits))
            block.add(doc, int(counts.sum()), terms, counts)
            if block.full():
                yield closed(open_blocks.pop(bits))
    for block in open_blocks.values():
        yield closed(block)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The blocks of `docs`, not yet stored; see the module. Documents without terms are in none."""
    rows = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.encode(F.col(text), "UTF-8").alias("_text"))
    return rows.mapInArrow(_build, INDEX)


def store_index(index: DataFrame) -> DataFrame:
    """The index written to the shared folder and read back, in row groups that a task can hold."""
    spark, path = index.sparkSession, shared_path(index.sparkSession, "lexical-index")
    index.write.option("parquet.block.row.count.limit", ROW_GROUP).parquet(path)
    return spark.read.schema(index.schema).parquet(path)


def query_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term): each query's terms, once each, as hashes."""
    words = items.select(F.col(item_id).cast("long").alias("item_id"), F.explode(terms_of(F.col(text))).alias("word"))
    return words.select("item_id", F.xxhash64("word").alias("term")).distinct()


def weighted(index: DataFrame, queries: DataFrame) -> DataFrame:
    """`queries` with each term's weight w, and N and L, from the whole index; terms in no document are left out."""
    totals = index.agg(
        F.sum(F.size("docs").cast("long")).alias("n_docs"),
        F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n_terms"),
    )
    wanted = queries.select("term").distinct()
    counts = index.select(F.explode("terms").alias("term")).join(wanted, "term").groupBy("term").agg(F.count("*").alias("df"))
    n_docs, n_terms = totals.first() or (None, None)
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs or 0).cast("double") + 2) / (2 * F.col("df") + 1))).cast("long")
    sized = counts.select("term", weight.alias("w"), F.lit(n_docs or 0).cast("long").alias("n_docs"))
    return queries.join(sized.withColumn("n_terms", F.lit(n_terms or 0).cast("long")), "term")


def query_blocks(queries: DataFrame) -> DataFrame:
    """Queries packed into blocks (q): their ids, where their terms begin, the terms and weights."""
    each = queries.groupBy("item_id").agg(
        F.sort_array(F.collect_list(F.struct("term", "w"))).alias("found"),
        F.first("n_docs").alias("n_docs"),
        F.first("n_terms").alias("n_terms"),
    )
    blocks = max(1, -(-each.count() // QUERY_BLOCK))
    return (
        each.groupBy(F.pmod(F.hash("item_id"), F.lit(blocks)).alias("q"))
        .agg(F.collect_list(F.struct("item_id", "found")).alias("items"), F.first("n_docs").alias("n_docs"), F.first("n_terms").alias("n_terms"))
        .select(
            "q",
            "n_docs",
            "n_terms",
            F.col("items.item_id").alias("item_ids"),
            F.transform("items", lambda i: F.size(i["found"]).cast("long")).alias("item_sizes"),
            F.flatten(F.transform("items", lambda i: i["found"]["term"])).alias("item_terms"),
            F.flatten(F.transform("items", lambda i: i["found"]["w"])).alias("item_weights"),
        )
    )


class _Queries:
    """A block of queries and the best k that this task has found for each."""

    def __init__(self, row: dict, k: int):
        self.k, self.n_docs, self.n_terms = k, row["n_docs"], row["n_terms"]
        self.ids = row["item_ids"]
        cuts = np.cumsum(row["item_sizes"])[:-1]
        self.terms = np.split(np.asarray(row["item_terms"], np.int64), cuts)
        self.weights = np.split(np.asarray(row["item_weights"], np.int64), cuts)
        self.best: list[list[tuple]] = [[] for _ in self.ids]

    def least(self, i: int) -> int:
        """The score that a document has to reach to be among query i's best."""
        return self.best[i][-1][0] if len(self.best[i]) == self.k else 1

    def offer(self, i: int, found: list[tuple]) -> None:
        ranked = sorted(self.best[i] + found, key=lambda hit: (-hit[0], hit[1] is None, hit[1] or 0))
        self.best[i] = ranked[: self.k]


def bounds(matrix: np.ndarray, bits: int, size: int, terms: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For each term and document the greatest value the document can have at its highest possible level."""
    most = np.zeros((len(terms), size), np.int64)
    alive = np.arange(len(terms))
    here = np.ones((len(terms), size), bool)
    for level in range(len(LEVELS)):
        both = np.bitwise_and.reduce(matrix[positions(terms[alive], level, bits)], axis=1)
        seen = np.unpackbits(both, axis=1, count=size).astype(bool) & here
        some = seen.any(axis=1)
        if not some.any():
            break
        alive, here = alive[some], seen[some]
        # beyond the last level a value stays below 1 000 000
        top = value(np.int64(LEVELS[level + 1] - 1), m) if level + 1 < len(LEVELS) else np.full(size, 1_000_000)
        most[alive] = np.where(here, top, most[alive])
    return most


def value(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _score(block: dict, asked: _Queries) -> None:
    """Offers the block's documents that may be among the best of some query."""
    bits, size = block["bits"], len(block["docs"])
    matrix = np.frombuffer(block["slices"], np.uint8).reshape(bits, -1)
    m = 50 + (50 * block["lengths"] * asked.n_docs) // asked.n_terms
    terms, counts, firsts, docs = block["terms"], block["counts"], block["firsts"], block["docs"]
    for i, (wanted, weights) in enumerate(zip(asked.terms, asked.weights, strict=True)):
        bound = np.zeros(size, np.int64)
        for at in range(0, len(wanted), TERM_STEP):
            most = bounds(matrix, bits, size, wanted[at : at + TERM_STEP], m)
            bound += weights[at : at + TERM_STEP] @ most
        least = asked.least(i)
        rest = np.flatnonzero(bound >= least)
        rest = rest[np.argsort(-bound[rest], kind="stable")]
        found: list[tuple] = []
        for n, d in enumerate(rest.tolist()):
            if n % asked.k == 0 and found:
                asked.offer(i, found)
                found = []
            if bound[d] < asked.least(i):
                break
            own = terms[firsts[d] : firsts[d + 1]]
            place = np.searchsorted(own, wanted)
            place[place == len(own)] = 0
            held = own[place] == wanted
            tf = counts[firsts[d] : firsts[d + 1]][place[held]].astype(np.int64)
            score = int((weights[held] * value(tf, m[d])).sum())
            if score > 0:
                found.append((score, docs[d]))
        if found:
            asked.offer(i, found)


def search(index: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query; `index` has to be stored."""
    blocks = query_blocks(weighted(index, queries))
    many = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("spread")
    asked = stored(blocks, "lexical-queries")
    numbers = asked.select("q", many)
    pairs = index.join(numbers, "spread").join(asked, "q")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, _Queries] = {}
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n] for name in batch.schema.names}
                q = row["q"].as_py()
                if q not in known:
                    names = ("n_docs", "n_terms", "item_ids", "item_sizes", "item_terms", "item_weights")
                    known[q] = _Queries({name: row[name].as_py() for name in names}, k)
                block = {name: row[name].values.to_numpy(zero_copy_only=False) for name in ("lengths", "firsts", "terms")}
                block["counts"] = np.frombuffer(row["counts"].as_buffer(), "<i4")
                block |= {"bits": row["bits"].as_py(), "docs": row["docs"].as_py(), "slices": row["slices"].as_buffer()}
                _score(block, known[q])
        for asked_ in known.values():
            rows = [(item, doc, score) for item, hits in zip(asked_.ids, asked_.best, strict=True) for score, doc in hits]
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    hits = pairs.select(
        "q", "n_docs", "n_terms", "item_ids", "item_sizes", "item_terms", "item_weights",
        "bits", "docs", "lengths", "firsts", "terms", "counts", "slices",
    ).mapInArrow(best, HITS)
    window = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = store_index(build_index(table(spark, sf_dir, "documents")))
    return search(index, query_terms(table(spark, sf_dir, "benchmark")), 50)


ORACLE = f"""
WITH said AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms
  FROM documents
), sized AS (
  SELECT row_id, doc_id, terms, len(terms)::BIGINT AS n FROM said WHERE len(terms) > 0
), totals AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sized
), postings AS (
  SELECT row_id, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT row_id, doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, totals GROUP BY term, n_docs
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
  FROM benchmark
), scored AS (
  SELECT item_id, row_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), totals
  GROUP BY item_id, row_id, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
