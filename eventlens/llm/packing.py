"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents go from long to short, one class of lengths after the other (more than half of the capacity, more than a
quarter, ...). In a round the documents left of the class and the gaps, i.e. the free ends of open sequences, that can
hold one are sorted by range, the largest first. Each task sweeps its range: a gap goes on a stack, a document
takes the gap on top, which is the smallest one that holds it, its successor. A gap stands on the
stack as many times as documents of the class surely fit into it; documents that compete for one gap get their
places by rank. What a range leaves, documents without a gap and gaps without a document, meets what
other ranges leave: from the totals of the ranges follows which ranks of one range's documents take which
ranks of another one's gaps, and both sides get the same match number. Then gaps are updated, and
the round repeats until no gap holds any document of the class; for those that are left new sequences are opened.

Longer documents are cut into pieces of full capacity, which are sequences by themselves, and a first piece of what
is left over, which is packed. `pack` takes any (id, length) rows.

Only the totals of a range, one row each, come to the driver. A range holds about `RANGE` rows; ties of
length and equal texts are dealt over ranges by a hash of their ids, so no length or text is a hot group.

Nulls: a null text is empty, and its document is the end token alone. Rows without doc_id, with equal ids
or repeated are packed like others. Texts are read whole, however long; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.llm.common import stored, table

CAPACITY, TOKENIZER, END = 2048, "byte_bpe_50k.json", 0
#: Classes of lengths: capacity >> 1, >> 2, ... are their lower bounds, the last class reaches down to 1.
CLASSES = 6
#: A sequence that holds at least so many documents of a class is opened by tokens, others by places.
MANY = 8
#: Rows of a sorted range on average; smaller ranges, of SMALL rows at least, keep up to TASKS tasks busy.
RANGE, SMALL, TASKS = 1 << 17, 1 << 13, 32
#: Pre-tokenisation of byte-level BPE files, a fixed public pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SWEPT = "kind string, part long, id long, length long, weight long, place long, gap long"


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """How a worker encodes texts with a byte-level BPE file.

    The file's vocabulary and merges are run by tiktoken, which gives the ids of the tokenizers library; strings
    of added tokens in a text count as these, as they do there.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    # bytes that are not printable stand for characters from 256 on, in order
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    added = {token["content"]: token["id"] for token in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    coder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> list[int]:
        if any(token in text for token in added):
            return coder.encode(text, allowed_special="all")
        return coder.encode_ordinary(text)

    return encode


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, keep: str, path: str, figures: str, each: Callable[[np.ndarray], dict]) -> DataFrame:
    """For each row (`keep`, text) of `docs`, `keep` and what `each` says of the text's ids with the end token behind."""
    name, kind = keep.split()
    schema = f"{keep}, {figures}"
    names = [field.split()[0] for field in figures.split(", ")]
    types = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    arrow = pa.schema([(name, types[kind]), *((f.split()[0], types[f.split()[1]]) for f in figures.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            told = []
            for text in batch.column(1):
                ids = encode(text.as_py() or "") if text.is_valid else []
                ids.append(END)
                told.append(each(np.array(ids, "<u4")))
            columns = [pa.array([t[n] for t in told], arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=arrow)

    return docs.mapInArrow(run, schema)


def first_length(tokens: Column, capacity: int) -> Column:
    """Tokens of the first piece: all, or what is left over from pieces of full capacity."""
    return F.when(tokens > 0, (tokens - 1) % capacity + 1).otherwise(0)


def _parts(rows: int) -> int:
    return max(1, -(-rows // RANGE), min(TASKS, rows // SMALL))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches within one range, and what is left of it.

    Rows come largest first, gaps (`weight` times on the stack) before documents of equal size. Left documents
    get their places from 0 on; left gaps their first place, counted from the top of the stack.
    """
    part = 0
    stack: list[list[int]] = []
    taken: list[tuple[int, int, int]] = []
    alone: list[tuple[int, int]] = []
    for batch in batches:
        part = batch.column("part")[0].as_py() if batch.num_rows else part
        for is_doc, at, size, weight in zip(*(batch.column(n).to_pylist() for n in ("doc", "id", "size", "weight")), strict=True):
            if not is_doc:
                stack.append([at, weight])
            elif stack:
                top = stack[-1]
                taken.append((at, size, top[0]))
                top[1] -= 1
                if not top[1]:
                    stack.pop()
            else:
                alone.append((at, size))

    def rows(kind: str, ids: list, lengths: list, weights: list, places: list, gaps: list) -> pa.RecordBatch:
        n = len(ids)
        ints = [pa.array(c, pa.int64()) for c in (ids, lengths, weights, places, gaps)]
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array([part] * n, pa.int64()), *ints], schema=_SWEPT)

    none = [None] * max(len(taken), len(alone), len(stack))
    if taken:
        ids, lengths, gaps = (list(c) for c in zip(*taken, strict=True))
        yield rows("match", ids, lengths, none[: len(taken)], none[: len(taken)], gaps)
    if alone:
        ids, lengths = (list(c) for c in zip(*alone, strict=True))
        yield rows("doc", ids, lengths, none[: len(alone)], list(range(len(alone))), none[: len(alone)])
    if stack:
        stack.reverse()
        weights = [w for _, w in stack]
        first = np.cumsum([0, *weights[:-1]]).tolist()
        yield rows("gap", [g for g, _ in stack], none[: len(stack)], weights, first, none[: len(stack)])


_KINDS = {"string": pa.string(), "long": pa.int64()}
_SWEPT = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in SWEPT.split(", ")])


def crossings(totals: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which places of one range's left documents take which of an earlier range's left gaps.

    `totals` are (part, documents, places of gaps) by part; the result are (documents' part, their first place, gaps'
    part, their first place, number): the gaps of the nearest earlier range, the smallest, go first.
    """
    stack: list[list[int]] = []
    found = []
    for part, docs, places in sorted(totals):
        at = 0
        while at < docs and stack:
            top = stack[-1]  # part, first free place, places left
            n = min(docs - at, top[2])
            found.append((part, at, top[0], top[1], n))
            at, top[1], top[2] = at + n, top[1] + n, top[2] - n
            if not top[2]:
                stack.pop()
        if places:
            stack.append([part, 0, places])
    return found


def _numbered(kind: str, spans: dict[int, list[tuple[int, int, int]]]) -> Callable:
    """Gives left rows of one kind the numbers of their matches; documents without one get null."""
    schema = pa.schema([("match", pa.int64()), ("id", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("part", "id", "length", "weight", "place")]
            parts, ids, lengths, weights, places = columns
            for part in np.unique(parts):
                here = parts == part
                own = spans.get(int(part), [])
                begin, number, count = (np.array(c, np.int64) for c in zip(*own, strict=True)) if own else [np.zeros(0, np.int64)] * 3
                end = begin + count
                if kind == "doc":
                    place = places[here].astype(np.int64)
                    at = np.searchsorted(begin, place, "right") - 1
                    hit = at >= 0
                    hit[hit] = place[hit] < end[at[hit]]
                    match = np.full(len(place), -1, np.int64)
                    match[hit] = number[at[hit]] + place[hit] - begin[at[hit]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(match, mask=~hit), pa.array(ids[here].astype(np.int64)), pa.array(lengths[here].astype(np.int64))], schema=schema
                    )
                elif own:
                    # only places that a document takes are made
                    taken = np.concatenate([np.arange(b, e) for b, e in zip(begin, end, strict=True)])
                    match = np.concatenate([np.arange(m, m + c) for m, c in zip(number, count, strict=True)])
                    first = places[here].astype(np.int64)
                    last = first + weights[here].astype(np.int64)
                    order = np.argsort(first)
                    at = np.searchsorted(first[order], taken, "right") - 1
                    held = at >= 0
                    held[held] = taken[held] < last[order][at[held]]
                    gap = ids[here].astype(np.int64)[order][at[held]]
                    yield pa.RecordBatch.from_arrays([pa.array(match[held]), pa.array(gap), pa.nulls(len(gap), pa.int64())], schema=schema)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(id, sequence_id, offset) for (id, length) rows of unique ids and lengths from 1 to the capacity.

    `items` has to be stored, or cheap to compute again.
    """
    spark = items.sparkSession
    halves = [capacity >> i for i in range(1, CLASSES) if capacity >> i]
    bounds = [*halves, 0]
    shortest = items.agg(F.min("length")).first()[0] or 1
    big = items.filter(F.col("length") > bounds[0])
    # sequences that a long document begins have its id, doubled; those opened later have odd numbers
    placed = [big.select("id", (F.col("id") * 2).alias("sequence_id"), "length", F.lit(0).alias("round"))]
    gaps = stored(big.select((F.col("id") * 2).alias("sequence_id"), (capacity - F.col("length")).cast("long").alias("free")).filter(F.col("free") >= shortest), "packing-gaps")
    opened, rounds = 0, 0
    for upper, lower in zip(bounds, bounds[1:], strict=False):
        docs = items.filter((F.col("length") > lower) & (F.col("length") <= upper)).select("id", "length")
        left, longest, least, tokens = docs.agg(F.count("*"), F.max("length"), F.min("length"), F.sum("length")).first()
        while left:
            rounds += 1
            widest, count = gaps.agg(F.max("free"), F.count("*")).first()
            if (widest or 0) < least:
                holds = capacity // longest
                new = -(-left // holds) if holds < MANY else max(1, -(-tokens // capacity))
                fresh = spark.range(opened, opened + new).select((F.col("id") * 2 + 1).alias("sequence_id"), F.lit(capacity).cast("long").alias("free"))
                gaps, opened, count = gaps.unionByName(fresh), opened + new, count + new
            matched, docs = _round(gaps, docs, int(longest), int(least))
            placed.append(matched.withColumn("round", F.lit(rounds)))
            used = matched.select("sequence_id", (-F.col("length")).alias("free"))
            update = gaps.unionByName(used).groupBy("sequence_id").agg(F.sum("free").alias("free"))
            gaps = stored(update.filter(F.col("free") >= shortest).coalesce(_parts(count)), "packing-gaps")
            left, longest, least, tokens = docs.agg(F.count("*"), F.max("length"), F.min("length"), F.sum("length")).first()
    whole = placed[0]
    for frame in placed[1:]:
        whole = whole.unionByName(frame)
    # a sequence has at most `capacity` documents
    before = Window.partitionBy("sequence_id").orderBy("round", F.desc("length"), "id").rowsBetween(Window.unboundedPreceding, -1)
    return whole.select("id", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def _round(gaps: DataFrame, docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """One sweep: (id, sequence_id, length) of the documents placed, and the (id, length) of those left."""
    fitting = gaps.filter(F.col("free") >= least)
    line = fitting.select(
        F.lit(False).alias("doc"),
        F.col("sequence_id").alias("id"),
        F.col("free").alias("size"),
        F.greatest(F.lit(1).cast("long"), F.floor(F.col("free") / longest)).alias("weight"),
    ).unionByName(docs.select(F.lit(True).alias("doc"), "id", F.col("length").alias("size"), F.lit(0).cast("long").alias("weight")))
    order = [F.desc("size"), F.asc("doc"), F.xxhash64("id"), F.asc("id")]
    parts = _parts(line.count())
    ranges = line.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    swept = stored(ranges.mapInArrow(_sweep, SWEPT).coalesce(parts), "packing-sweep")
    matched = swept.filter("kind = 'match'").select("id", F.col("gap").alias("sequence_id"), "length")
    alone = swept.filter("kind = 'doc'")
    totals = swept.filter("kind <> 'match'").groupBy("part").agg(
        F.sum(F.when(F.col("kind") == "doc", 1).otherwise(0)).alias("docs"),
        F.sum(F.coalesce("weight", F.lit(0))).alias("places"),
    )
    crossing = crossings([tuple(row) for row in totals.collect()])
    if not crossing:
        return matched, alone.select("id", "length")
    number, doc_spans, gap_spans = 0, {}, {}
    for doc_part, doc_at, gap_part, gap_at, n in crossing:
        doc_spans.setdefault(doc_part, []).append((doc_at, number, n))
        gap_spans.setdefault(gap_part, []).append((gap_at, number, n))
        number += n
    schema = "match long, id long, length long"
    takers = stored(alone.select("part", "id", "length", "weight", "place").mapInArrow(_numbered("doc", doc_spans), schema).coalesce(parts), "packing-left")
    places = swept.filter("kind = 'gap'").select("part", "id", "length", "weight", "place").mapInArrow(_numbered("gap", gap_spans), schema)
    found = takers.filter("match IS NOT NULL").join(places.select("match", F.col("id").alias("sequence_id")), "match")
    matched = matched.unionByName(found.select("id", "sequence_id", "length"))
    return stored(matched.coalesce(parts), "packing-matched"), takers.filter("match IS NULL").select("id", "length")


def pieces_of(tokens: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of `tokens` (id, n_tokens, ...) for each piece: piece, start, length, and the id that `pack` needs.

    `tokens` has to be stored. First pieces are packed, the others are sequences of their own.
    """
    first = first_length(F.col("n_tokens"), capacity)
    many = F.ceil(F.col("n_tokens") / capacity)
    packed = pack(tokens.select("id", first.alias("length")), capacity)
    firsts = tokens.withColumns({"piece": F.lit(0), "start": F.lit(0).cast("long"), "length": first}).join(packed, "id")
    rest = tokens.filter(F.col("n_tokens") > capacity).withColumn("piece", F.explode(F.sequence(F.lit(1), (many - 1).cast("int"))))
    # below zero: no sequence of `pack` is there
    rest = rest.withColumns(
        {
            "start": first + (F.col("piece") - 1) * capacity,
            "length": F.lit(capacity).cast("long"),
            "sequence_id": -1 - F.monotonically_increasing_id(),
            "offset": F.lit(0).cast("long"),
        }
    )
    return firsts.unionByName(rest)


def _digest(capacity: int) -> Callable[[np.ndarray], dict]:
    def figures(ids: np.ndarray) -> dict:
        first = (len(ids) - 1) % capacity + 1
        starts = [0, *range(first, len(ids), capacity)]
        return {"n_tokens": len(ids), "crcs": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]}

    return figures


def _whole(ids: np.ndarray) -> dict:
    return {"n_tokens": len(ids), "ids": ids.astype(np.int32)}


def packed_ids(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(sequence_id, ids): the documents' token ids as packed sequences, each of at most `capacity` ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    tokens = encoded(rows, "id long", path or tokenizer_path(), "n_tokens long, ids array<int>", _whole)
    tokens = stored(tokens.withColumn("id", F.monotonically_increasing_id()), "packing-ids")
    pieces = pieces_of(tokens, capacity).select("sequence_id", "offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids"))
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(ordered["ids"]).alias("ids"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = encoded(docs, "doc_id long", tokenizer_path(), "n_tokens long, crcs array<long>", _digest(CAPACITY))
    tokens = stored(tokens.withColumn("id", F.monotonically_increasing_id()), "packing-tokens")
    pieces = pieces_of(tokens)
    return pieces.select("doc_id", "piece", "start", "length", F.col("crcs")[F.col("piece")].alias("ids_crc32"), "sequence_id", "offset")
