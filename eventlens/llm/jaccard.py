"""N-gram Jaccard join: documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

Method: rare-first prefix filtering. Documents with equal sets form a class, which takes part once.
Of each class only the prefix, its rarest n-grams, is joined; two classes that reach the threshold
share an n-gram of their prefixes, whatever the order of rarity is, so it may rest on the first bits
of n-grams' hashes (`survey`) without losing a link. N-grams of one document only, known from a bit map,
are not joined at all. Candidates pass length and positional filters, and each pair is verified once,
after a suffix filter, on the whole sets.

Large groups of near copies would give the square of their size in pairs. Links only have to connect, so
rounds of stars come first: in each n-gram's posting list every class is compared with one centre, and
components are formed. What is left are pairs of different components, all of which are compared
(`open_pairs`). No pair within a component is made or compared.

Hot n-grams are dealt by class as well, in their stars; joins on them are split by adaptive execution.
Intermediate tables go to the shared folder, so a lost executor costs no more than a stage.

Hashes have 64 bits: an n-gram stands for its hash, a class for the hash of its set.

Nulls: a null text has no words, an empty set and no links, and is a component of its own; a row
without doc_id counts in components, whose id is the smallest doc_id that is there. Repeated rows and ties
give equal results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.llm.common import WORD, let, stored, table

GRAM = 5
PERCENT = 80
#: Frequent n-grams whose counts are broadcast, at most (16 bytes each).
FREQUENT = 1 << 19
#: N-grams that a task packs at once, bits of their hashes by which they are counted, and bits packed as they are.
BLOCK, KEY_BITS, LOW_BITS = 1 << 21, 48, 24
#: Documents whose results a task holds at a time.
PIECE = 1024
#: Documents of an n-gram's posting list that one task is to hold.
HOT = 20_000
STARS = 2
#: First repeated n-grams of a class that its rows carry, to tell whether a pair has met before.
HEAD = 16
#: Bits of the hash that make the suffix filter's parts.
PART_BITS = 4
#: Size of the bit maps of n-grams and of classes that are broadcast (16 MB each).
FILTER_BITS = 27
MAX_STEPS = 60

_U = np.uint64
_MULTIPLIER, _SHORT = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible order (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def gram_sets(words: pa.ListArray, gram: int) -> Iterator[np.ndarray]:
    """For each document's word hashes, its sorted set of n-gram hashes."""
    bounds = words.offsets.to_numpy()
    first, last = int(bounds[0]), int(bounds[-1])
    values = words.values.to_numpy(zero_copy_only=False)[first:last].view(np.uint64)
    bounds = bounds - first
    count = max(0, len(values) - gram + 1)
    grams = np.zeros(count, np.uint64)
    for k in range(gram):
        grams = grams * _MULTIPLIER + values[k : k + count]
    grams = mix(grams)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= gram:
            yield np.unique(grams[a : b - gram + 1])
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for value in values[a:b]:
                whole = whole * _MULTIPLIER + value
            yield mix(whole + np.array([b - a], np.uint64) * _SHORT)
        else:
            yield np.zeros(0, np.uint64)


def class_of(grams: np.ndarray) -> int:
    total = mix(grams + _SHORT).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total + np.array([len(grams)], np.uint64) * _MULTIPLIER).view(np.int64)[0])


def word_hashes(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())
    return F.transform(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def hashed(docs: DataFrame) -> DataFrame:
    """`doc_id`, `row` (a key of the row's content) and `words`, the hashes of its words in order."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), word_hashes(F.col("text")).alias("words"))


def packed(values: np.ndarray, width: int) -> bytes:
    """Sorted numbers of `width` bits in about 4 bytes each (Elias-Fano): low bits as they are, high ones in unary."""
    lows = values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : LOW_BITS // 8]
    marks = np.zeros(len(values) + (1 << (width - LOW_BITS)), bool)
    marks[(values >> LOW_BITS) + np.arange(len(values))] = True
    return len(values).to_bytes(4, "little") + lows.tobytes() + np.packbits(marks).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    count, step = int.from_bytes(data[:4], "little"), LOW_BITS // 8
    lows = np.zeros((count, 4), np.uint8)
    lows[:, :step] = np.frombuffer(data, np.uint8, count * step, 4).reshape(count, step)
    marks = np.unpackbits(np.frombuffer(data, np.uint8, offset=4 + count * step))
    highs = np.flatnonzero(marks)[:count] - np.arange(count)
    return (highs << LOW_BITS) + lows.view("<u4").ravel()


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches PIECE rows at a time; at the end Arrow gives back what the worker would keep for its next task."""
    for batch in batches:
        for at in range(0, len(batch), PIECE):
            yield batch.slice(at, PIECE)
    pa.default_memory_pool().release_unused()


def by_range(held: list[np.ndarray], width: int) -> tuple[list[int], list[bytes]]:
    """Empties `held`, n-grams' hashes, into ranges of the first bits of their keys: numbers of ranges, packed keys.

    Works in place: beside the hashes it takes one copy of them."""
    whole = np.concatenate(held)
    held.clear()
    whole >>= _U(64 - KEY_BITS)
    whole.sort()
    keys = whole.view(np.int64)
    starts = np.searchsorted(keys, np.arange((1 << (KEY_BITS - width)) + 1) << width)
    buckets = np.flatnonzero(np.diff(starts))
    low = (1 << width) - 1
    return buckets.tolist(), [packed(keys[starts[b] : starts[b + 1]] & low, width) for b in buckets]


def survey(docs: DataFrame, gram: int) -> DataFrame:
    """One pass and one shuffle: a row for each document (`size` is its set's, `class` names its set), and rows
    with `size` null for n-grams (their first KEY_BITS bits, in `class`) that occur in `count` > 1 documents.

    N-grams travel packed by ranges, in blocks; a range is counted in one task and holds a few million of them.
    A class counts once per task.
    """
    bits = min(KEY_BITS - LOW_BITS, max(8, math.ceil(math.log2(max(1, docs.count()) / 4096))))
    width = KEY_BITS - bits
    names = ["bucket", "grams", "doc_id", "row", "size", "class"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        n = 0

        def ranges() -> pa.RecordBatch:
            buckets, parts = by_range(held, width)
            none = pa.nulls(len(parts), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(parts, pa.binary()), none, none, none, none], names)

        for batch in pieces(batches):
            sizes, classes = [], []
            for grams in gram_sets(batch.column("words"), gram):
                own = class_of(grams) if len(grams) else None
                sizes.append(len(grams))
                classes.append(own)
                if own is not None and own not in seen:
                    seen.add(own)
                    held.append(grams)
                    n += len(grams)
                if n >= BLOCK:
                    yield ranges()
                    n = 0
            rows = batch.column("row")
            spread = -1 - (rows.to_numpy() & 1023)
            columns = [pa.array(spread), pa.nulls(len(rows), pa.binary()), batch.column("doc_id"), rows]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(classes, pa.int64())], names)
        if n:
            yield ranges()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = -1

        def repeated() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            grams, counts = grams[counts > 1] + (at << width), counts[counts > 1]
            none = pa.nulls(len(grams), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(grams), pa.array(counts)], [*names[2:], "count"])

        for batch in batches:
            own = batch.filter(pc.less(batch.column("bucket"), 0))
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names[2:]), pa.nulls(len(own), pa.int64())], [*names[2:], "count"])
            for bucket, grams in zip(batch.column("bucket").to_pylist(), batch.column("grams"), strict=True):
                if bucket < 0:
                    continue
                if bucket != at and held:
                    yield repeated()
                    held = []
                at = bucket
                held.append(unpacked(grams.as_py()))
        if held:
            yield repeated()

    gathered = hashed(docs).mapInArrow(gather, "bucket long, grams binary, doc_id long, row long, size long, class long")
    dealt = gathered.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(count, "doc_id long, row long, size long, class long, count long")


def bit_map(frame: DataFrame, place: Column) -> np.ndarray:
    """A bit map of the places, numbers of FILTER_BITS bits, that occur; packed by tasks, so its size bounds what is collected."""
    chunks = frame.groupBy(F.shiftright(place, 15).alias("chunk")).agg(
        F.collect_set(place.bitwiseAND((1 << 15) - 1).cast("int")).alias("bits")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for bits in batch.column("bits"):
                flags = np.zeros(1 << 15, bool)
                flags[bits.values.to_numpy()] = True
                parts.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(parts, pa.binary())], ["chunk", "bits"])

    whole = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in chunks.mapInArrow(pack, "chunk long, bits binary").collect():
        at = row["chunk"] << 12
        whole[at : at + (1 << 12)] = np.frombuffer(row["bits"], np.uint8)
    return whole


def in_bit_map(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).astype(bool)


def repeated_grams(surveyed: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bit map of all n-grams that several documents hold, and keys and counts of the most frequent, at most `most`.

    The bit map may have others too, once there are very many; those then count as repeated. A histogram of 8 steps per power
    of two says from which count on n-grams are taken by name.
    """
    counts = surveyed.filter(F.col("size").isNull()).select("class", "count")
    bits = bit_map(counts, F.shiftright("class", KEY_BITS - FILTER_BITS))
    step = F.floor(F.log2(F.col("count")) * 8).cast("int")
    least, total = None, 0
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    if least is None:
        return bits, np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = counts.filter(step >= least).toArrow()
    keys, count = top.column("class").to_numpy(), top.column("count").to_numpy()
    order = np.argsort(keys)
    return bits, keys[order], count[order]


def prefixes(
    docs: DataFrame, repeated: tuple[np.ndarray, np.ndarray, np.ndarray], gram: int, percent: int, hot: int = HOT
) -> DataFrame:
    """(token, salt, salts, class, place, size, rare) for the prefix of each class; a class once per task.

    N-grams of one document only come first and meet no other; they take their places but are
    not given out. `rare` is their number. A token is dealt to `salts` shares of about `hot` documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(repeated)
    names = ["token", "salt", "salts", "class", "place", "size", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known, counts = shared.value
        seen: set[int] = set()
        for batch in pieces(batches):
            found: list[tuple] = []
            for grams in gram_sets(batch.column("words"), gram):
                size = len(grams)
                if not size or (own := class_of(grams)) in seen:
                    continue
                seen.add(own)
                keys = (grams >> _U(64 - KEY_BITS)).astype(np.int64)
                several = np.flatnonzero(in_bit_map(bits, keys >> (KEY_BITS - FILTER_BITS)))
                rare = size - len(several)
                length = size + percent * size // -100 + 1
                if rare >= length:
                    continue
                grams, keys, often = grams[several], keys[several], np.ones(len(several), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    often = np.where(known[at] == keys, counts[at], 1)
                order = np.argsort(often, kind="stable")[: length - rare]  # rare first, then by hash
                same = [np.full(len(order), x, np.int64) for x in (own, size, rare)]
                places = np.arange(rare, rare + len(order))
                salts = often[order] // hot + 1
                found.append((grams[order].view(np.int64), own % salts, salts, same[0], places, same[1], same[2]))
            if found:
                columns = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return hashed(docs).mapInArrow(run, ", ".join(f"{name} long" for name in names))


def postings(prefix: DataFrame) -> DataFrame:
    """Prefix rows of tokens that several classes hold, each class once per token.

    A class alone in its share may have partners in the token's other shares, so tokens of several shares stay whole.
    """
    ints = [F.col(c).cast("int") for c in ("salts", "place", "size", "rare")]
    rows = (
        prefix.select("token", "salt", "class", *ints)
        .repartition("token", "salt")
        .groupBy("token", "salt", "class")
        .agg(*(F.min(c).alias(c) for c in ("salts", "place", "size", "rare")))
    )
    group = Window.partitionBy("token", "salt")
    rows = rows.withColumn("many", F.min("class").over(group) != F.max("class").over(group))
    return rows.filter(F.col("many") | (F.col("salts") > 1)).drop("many", "salts")


def close_sizes(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def star_pairs(posts: DataFrame, labels: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """Each class with the centre of each of its tokens; centres change with `turn`."""
    rows = labelled(posts, labels)
    # first the class with least of its own, which is what near copies were copied from, then any
    order = F.struct(F.col("rare") if turn == 0 else F.lit(0), F.xxhash64("class", F.lit(turn)))
    centre = F.min(F.struct(order.alias("o"), F.col("class").alias("hub"), F.col("size").alias("hub_size"), F.col("label").alias("hub_label")))
    dealt = rows.groupBy("token", "salt").agg(centre.alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    dealt = dealt.select("token", "salt", "c.*", "lo", "hi")
    # centres of a hot token's shares are compared with each other as well
    hubs = dealt.groupBy("token").agg(
        F.min(F.struct("o", "hub", "hub_size", "hub_label")).alias("c"), F.count("*").alias("shares")
    )
    hubs = hubs.filter("shares > 1").select(
        "token", F.col("c.hub").alias("top"), F.col("c.hub_size").alias("top_size"), F.col("c.hub_label").alias("top_label")
    )
    own = rows.join(dealt.filter(F.col("lo") != F.col("hi")), ["token", "salt"]).filter(F.col("label") != F.col("hub_label"))
    own = own.select("hub", F.col("class").alias("other"), "hub_size", F.col("size").alias("other_size"))
    across = dealt.join(hubs, "token").filter(F.col("top_label") != F.col("hub_label"))
    across = across.select(
        F.col("top").alias("hub"), F.col("hub").alias("other"), F.col("top_size").alias("hub_size"), F.col("hub_size").alias("other_size")
    )
    return own.unionByName(across).filter(close_sizes(F.col("hub_size"), F.col("other_size"), percent)).distinct()


def labelled(posts: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return posts.withColumn("label", F.col("class"))
    found = posts.join(labels.withColumnRenamed("node", "class"), "class", "left")
    return found.withColumn("label", F.coalesce("label", "class"))


def open_pairs(posts: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """All pairs of classes of different components that pass the length and positional filters.

    Of a token's components the one with most classes meets the others, which meet each other; tokens
    within one component give nothing. A pair is given out at its first common token: rows carry the first
    `HEAD` tokens of their class, and where two classes share one of those that comes earlier, they meet there.
    N-grams of one document only come first in its order and are common to no pair, so before a common token at places i and j
    are at most min(i - rare, j - rare') common ones, none if all earlier ones are in the heads, and behind it as many as
    the shorter rest has. A row that leaves too few rules its pair out.
    """
    rows = labelled(posts, labels)
    by_label = rows.groupBy("token", "label").agg(F.count("*").alias("n"))
    largest = by_label.groupBy("token").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count("*").alias("labels"))
    largest = largest.filter("labels > 1").drop("labels")
    rows = stored(rows.join(largest, "token").drop("salt"), "open-rows")
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("class").orderBy("place")))
    first = ranked.filter(F.col("nth") <= HEAD).groupBy("class").agg(
        F.sort_array(F.collect_list(F.struct("place", "token")))["token"].alias("head")
    )
    rows = stored(ranked.join(first, "class"), "open-rows")
    minor = rows.filter(F.col("label") != F.col("main"))
    a, b = minor.alias("a"), rows.alias("b")
    once = (F.col("b.label") == F.col("b.main")) | (F.col("a.class") < F.col("b.class"))

    def earlier(side: str) -> Column:
        return F.slice(F.col(f"{side}.head"), F.lit(1), F.least(F.lit(HEAD), F.col(f"{side}.nth") - 1))

    known = F.greatest("a.nth", "b.nth") <= HEAD + 1
    before = F.when(known, 0).otherwise(F.least("a.nth", "b.nth") - 1)
    after = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place"))
    possible = (100 + percent) * (before + after) >= percent * (F.col("a.size") + F.col("b.size"))
    met = a.join(
        b,
        (F.col("a.token") == F.col("b.token"))
        & (F.col("a.label") != F.col("b.label"))
        & once
        & close_sizes(F.col("a.size"), F.col("b.size"), percent)
        & possible
        & ~F.arrays_overlap(earlier("a"), earlier("b")),
    )
    low, high = F.least("a.class", "b.class"), F.greatest("a.class", "b.class")
    pairs = met.select(low.alias("hub"), high.alias("other")).distinct()
    return counted(pairs, rows, percent)


def counted(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Those `pairs` whose common prefix tokens and the rests behind the last of them leave enough."""
    listed = rows.groupBy("class").agg(
        F.sort_array(F.collect_list(F.struct("place", "token"))).alias("prefix"), F.max("size").alias("size")
    )
    listed = stored(listed, "open-prefixes")
    hub = listed.select(F.col("class").alias("hub"), F.col("prefix").alias("x"), F.col("size").alias("hub_size"))
    other = listed.select(F.col("class").alias("other"), F.col("prefix").alias("y"), F.col("size").alias("other_size"))
    found = pairs.join(hub, "hub").join(other, "other")
    both = F.array_intersect(F.col("x.token"), F.col("y.token"))

    def rest(side: str, size: str, common: Column) -> Column:
        # prefixes are in one order, so the last common n-gram is the same for both
        at = F.array_position(F.col(f"{side}.token"), F.element_at(common, -1)).cast("int")
        return F.col(size) - F.element_at(F.col(f"{side}.place"), at) - 1

    # all common n-grams up to the last one found are counted; behind it the shorter rest bounds them
    bound = let(both, lambda common: F.size(common) + F.least(rest("x", "hub_size", common), rest("y", "other_size", common)))
    enough = (100 + percent) * bound >= percent * (F.col("hub_size") + F.col("other_size"))
    return found.filter(enough).select("hub", "other", "hub_size", "other_size")


def whole_sets(docs: DataFrame, posts: DataFrame, gram: int) -> str:
    """The name of a table (class, grams, parts) of the sets of the classes that have postings.

    `parts` counts a set's n-grams in 2**PART_BITS ranges of hashes. The table is bucketed by class, so that joins with it
    do not shuffle it. The bit map keeps most other classes from being written; any that come through are not joined.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bit_map(posts, F.shiftrightunsigned("class", 64 - FILTER_BITS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in pieces(batches):
            classes, sets, parts = [], [], []
            for grams in gram_sets(batch.column("words"), gram):
                if not len(grams) or (own := class_of(grams)) in seen:
                    continue
                if in_bit_map(bits, np.array([(own & (1 << 64) - 1) >> (64 - FILTER_BITS)]))[0]:
                    seen.add(own)
                    classes.append(own)
                    sets.append(grams.view(np.int64))
                    parts.append(np.bincount((grams >> _U(64 - PART_BITS)).astype(np.int64), minlength=1 << PART_BITS))
            if classes:
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                even = np.arange(len(classes) + 1, dtype=np.int32) << PART_BITS
                listed = [pa.ListArray.from_arrays(ends, np.concatenate(sets)), pa.ListArray.from_arrays(even, np.concatenate(parts))]
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), *listed], ["class", "grams", "parts"])

    sets = hashed(docs).mapInArrow(run, "class long, grams array<long>, parts array<long>")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"gram_sets_{uuid.uuid4().hex}"
    once = sets.repartition(buckets, "class").dropDuplicates(["class"])
    once.write.bucketBy(buckets, "class").saveAsTable(name)
    return name


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """`hub`, `other`, `linked` for each pair, decided on the whole sets.

    The suffix filter comes first: what the sets' parts differ in number is a lower bound of
    what the sets differ in, and pairs too far apart are not compared.
    """
    one = sets.select(F.col("class").alias("hub"), F.col("grams").alias("x"), F.col("parts").alias("px"))
    two = sets.select(F.col("class").alias("other"), F.col("grams").alias("y"), F.col("parts").alias("py"))
    rows = pairs.select("hub", "other").join(one, "hub").join(two, "other")
    both = F.size("x") + F.size("y")
    apart = F.aggregate(F.zip_with("px", "py", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, n: s + n)
    # of both sets' n-grams, at most (both - apart) / 2 can be in common
    near = (100 + percent) * (both - apart) >= 2 * percent * both
    enough = (100 + percent) * F.size(F.array_intersect("x", "y")) >= percent * both
    return rows.select("hub", "other", F.when(near, enough).otherwise(F.lit(False)).alias("linked"))


def components(edges: DataFrame) -> DataFrame | None:
    """(node, label) with the smallest node of each node's component; None without edges.

    Each step takes over the smallest label among neighbours, then the label's own label, so
    that chains shorten by half.
    """
    both = edges.select("hub", "other").union(edges.select("other", "hub")).distinct().toDF("node", "next")
    both = stored(both, "edges")
    labels = stored(both.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("label")), "labels")
    if labels.isEmpty():
        return None
    for _ in range(MAX_STEPS):
        far = both.join(labels.withColumnRenamed("node", "next"), "next").groupBy("node").agg(F.min("label").alias("near"))
        moved = labels.join(far, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        target = moved.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        moved = moved.join(target, "label", "left").select("node", F.least("label", "jump").alias("label"), "old")
        moved = stored(moved, "labels")
        labels = moved.select("node", "label")
        if moved.filter("label != old").isEmpty():
            return labels
    raise RuntimeError(f"components are not settled after {MAX_STEPS} steps")


def join_classes(
    docs: DataFrame, gram: int = GRAM, percent: int = PERCENT, hot: int = HOT
) -> tuple[DataFrame, DataFrame | None]:
    """The survey of `docs` (`doc_id`, `text`) and the components of its classes."""
    docs = docs.select("doc_id", "text")
    surveyed = stored(survey(docs, gram), "survey")
    posts = stored(postings(prefixes(docs, repeated_grams(surveyed), gram, percent, hot)), "postings")
    sets = whole_sets(docs, posts, gram)
    labels: DataFrame | None = None
    tested: DataFrame | None = None
    for turn in range(STARS + 1):
        pairs = open_pairs(posts, labels, percent) if turn == STARS else star_pairs(posts, labels, turn, percent)
        if tested is not None:
            low, high = F.least("hub", "other"), F.greatest("hub", "other")
            past = tested.select(low.alias("low"), high.alias("high"))
            pairs = pairs.join(past, (low == F.col("low")) & (high == F.col("high")), "left_anti")
        found = stored(verified(pairs, docs.sparkSession.table(sets), percent), "pairs")
        tested = found if tested is None else tested.unionByName(found)
        labels = components(tested.filter("linked"))
    docs.sparkSession.sql(f"DROP TABLE {sets}")
    return surveyed, labels


def link(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """`doc_id`, `row`, `n_shingles`, `component_id` for each row of `docs`."""
    return rooted(docs, gram, percent, hot).drop("root")


def rooted(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """`link` with `root`, which names the component even where doc_ids repeat or lack; null for empty sets."""
    surveyed, labels = join_classes(docs, gram, percent, hot)
    rows = surveyed.filter(F.col("size").isNotNull())
    classes = rows.filter("size > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    if labels is None:
        ids = classes.select("class", F.col("least").alias("component_id"), F.col("class").alias("root"))
    else:
        root = classes.join(labels.withColumnRenamed("node", "class"), "class", "left")
        root = root.withColumn("label", F.coalesce("label", "class"))
        least = root.groupBy("label").agg(F.min("least").alias("component_id"))
        ids = root.select("class", "label").join(least, "label").select("class", "component_id", F.col("label").alias("root"))
    found = rows.join(ids, "class", "left")
    own = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "row", F.col("size").alias("n_shingles"), own.alias("component_id"), "root")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row: the smallest doc_id, of equal ones a text by its hash, of equal rows one.

    Rows with neither doc_id nor words are components of their own and all stay.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    bare = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    found = rooted(docs.filter(~bare)).withColumn("alone", F.when(F.col("root").isNull(), F.col("doc_id")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    keep = found.groupBy("root", "alone").agg(first["row"].alias("row")).select("row")
    rows = docs.filter(~bare).select(*columns).withColumn("row", F.xxhash64("doc_id", "text")).join(keep, "row", "left_semi")
    once = rows.groupBy("row").agg(F.min(F.struct(*columns)).alias("d")).select("d.*")
    return once.unionByName(docs.filter(bare).select(*columns))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
    GROUP BY ALL
  ) JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 80 * (s.n + t.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN sizes USING (doc_id)
"""
