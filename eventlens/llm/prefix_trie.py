"""Prefix trie of conversations from ternary search trees, one per range shard.

Turns become ids (`turn_ids`, hashes of role and text whose dictionary is checked for clashes), so a
conversation is a sequence of ids. Equal sequences are brought together once, with their number, their
smallest conversation and a digest of all their conversations. The distinct sequences are sorted
by range into shards. A task builds a ternary search tree of its shard: the median sequence goes in first,
then the medians of both halves and so on, so that the search trees below each node stay balanced.
An iterative traversal adds up members, children, leaves and savings from the bottom.

Only nodes on the path of a shard's first or last sequence can have members in other shards. These
boundary nodes are left open and handed on with what is known of them; the boundary nodes of
`MERGE` neighbouring shards are merged in a tree of the same kind, which leaves only its own first and last path
open, and so on until one tree is left. Children of open nodes learn their parent from the chain of merges.

A task holds one shard or the boundary paths of MERGE shards; a conversation has to fit into a row as
an array of ids, its texts do not. Conversations that many share, and prefixes that all share, are no hot
groups: equal sequences are combined in sorted ranges, which cut through a group, and shards are cut by whole sequences.

Nulls: null role or text becomes empty, a null turn comes first, rows without conv_id belong to no conversation and are
left out. Turns of one number follow each other by their ids, repeated rows are turns of
their own. Texts are read whole, however long, by the id and the number of words. Other columns are ignored; without
conversations there are no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import stored, table, word_count

#: Turns of a shard at most; smaller ones, of SMALL_SHARD at least, keep up to TASKS tasks busy.
SHARD_TURNS, SMALL_SHARD, TASKS = 1 << 19, 1 << 11, 64
#: Neighbouring shards whose boundary nodes are merged in one tree.
MERGE = 64
#: Conversations of one piece of a digest, and of one sorted range of members.
CHUNK, RANGE = 1 << 14, 1 << 18

SEQUENCES = "conv_id long, n long, ids array<long>, words array<long>, ends string"
OUT = (
    "kind string, level int, part long, idx long, up long, ref long, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, turn long, words long, "
    "on_first boolean, on_last boolean"
)
NONE = hashlib.sha256(b"").hexdigest()


def turn_ids(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, id, words): turns as ids; two turns have one id if role and text are equal."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.xxhash64("role", "text").alias("id"),
        F.xxhash64(F.lit(1), "text", "role").alias("check"),
        F.coalesce(word_count(F.col("text")), F.lit(0).cast("long")).alias("words"),
    )


def check_dictionary(ids: DataFrame) -> None:
    """Raises if one id stands for different turns."""
    clash = ids.groupBy("id").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a <> b")
    if clash.limit(1).count():
        raise ValueError("two different turns have one id")


def sequences_of(ids: DataFrame) -> DataFrame:
    """(conv_id, ids, words): each conversation's turns in order."""
    told = F.sort_array(F.collect_list(F.struct("turn", "id", "words")))
    grouped = ids.groupBy("conv_id").agg(told.alias("told"))
    return grouped.select("conv_id", F.col("told.id").alias("ids"), F.col("told.words").alias("words"))


def _tasks(rows: int, most: int) -> int:
    return max(1, -(-rows // most), min(TASKS, rows // SMALL_SHARD))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal sequences in a sorted range, in pieces of at most `CHUNK` conversations."""
    key, held, first = None, [], None

    def piece() -> pa.RecordBatch:
        row = {
            "a": key[0], "b": key[1], "conv_id": held[0], "n": len(held), "ids": first[0], "words": first[1],
            "said": ",".join(map(str, held)),
        }
        return pa.RecordBatch.from_pylist([row], schema)

    ints = pa.list_(pa.int64())
    schema = pa.schema(
        [("a", pa.int64()), ("b", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ids", ints), ("words", ints), ("said", pa.string())]
    )
    for batch in batches:
        keys = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
        for i, (now, conv) in enumerate(zip(keys, batch.column("conv_id").to_pylist(), strict=True)):
            if held and (now != key or len(held) == CHUNK):
                yield piece()
                held = []
            if not held:
                key, first = now, (batch.column("ids")[i].as_py(), batch.column("words")[i].as_py())
            held.append(conv)
    if held:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per sequence from its sorted pieces; the digest is fed piece by piece."""
    key, row, digest = None, None, None
    done: list[dict] = []
    ints = pa.list_(pa.int64())
    schema = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("ids", ints), ("words", ints), ("ends", pa.string())])
    for batch in batches:
        for found in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            if row is not None and (found["a"], found["b"]) == key:
                digest.update(b"," + found["said"].encode())
                row["n"] += found["n"]
                continue
            if row is not None:
                done.append(row | {"ends": digest.hexdigest()})
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
            key, digest = (found["a"], found["b"]), hashlib.sha256(found["said"].encode())
            row = {name: found[name] for name in ("conv_id", "n", "ids", "words")}
    if row is not None:
        done.append(row | {"ends": digest.hexdigest()})
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def distinct_sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, n, ids, words, ends): each distinct sequence of the stored `rows` with its smallest
    conversation, their number, and the digest of all of them in ascending order."""
    keyed = rows.select(F.xxhash64("ids").alias("a"), F.xxhash64(F.lit(1), "ids").alias("b"), "conv_id", "ids", "words")
    ranges = _tasks(rows.count(), RANGE)
    order = ["a", "b", "conv_id"]
    pieces = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(
        _pieces, "a long, b long, conv_id long, n long, ids array<long>, words array<long>, said string"
    )
    return pieces.repartition(ranges, "a", "b").sortWithinPartitions(*order).mapInArrow(_digests, SEQUENCES).coalesce(ranges)


class Tree:
    """A trie whose children are ternary search trees; node 0 is the root, parents come before children."""

    def __init__(self) -> None:
        self.turn, self.words, self.parent, self.depth = [0], [0], [-1], [0]
        self.low, self.high, self.below = [-1], [-1], [-1]
        self.members, self.kids, self.leaves, self.saved = [0], [0], [0], [0]
        self.smallest: list[int | None] = [None]
        self.ends: list[str | None] = [None]

    def _new(self, parent: int, turn: int, words: int) -> int:
        for column, value in (
            (self.turn, turn), (self.words, words), (self.parent, parent), (self.depth, self.depth[parent] + 1),
            (self.low, -1), (self.high, -1), (self.below, -1), (self.members, 0), (self.kids, 0), (self.leaves, 0),
            (self.saved, 0), (self.smallest, None), (self.ends, None),
        ):
            column.append(value)
        return len(self.turn) - 1

    def child(self, node: int, turn: int, words: int) -> int:
        """The child of `node` by `turn`, which is made if there is none."""
        links, at = self.below, node
        while (found := links[at]) >= 0 and self.turn[found] != turn:
            links, at = (self.low if turn < self.turn[found] else self.high), found
        if found < 0:
            found = links[at] = self._new(node, turn, words)
        return found

    def join(self, node: int, members: int, smallest: int) -> None:
        self.members[node] += members
        least = self.smallest[node]
        self.smallest[node] = smallest if least is None else min(least, smallest)

    def insert(self, row: dict) -> None:
        node = 0
        self.join(node, row["n"], row["conv_id"])
        for turn, words in zip(row["ids"], row["words"], strict=True):
            node = self.child(node, turn, words)
            self.join(node, row["n"], row["conv_id"])
        self.ends[node] = row["ends"]

    def path(self, turns: list[int]) -> list[int]:
        nodes = [0]
        for turn in turns:
            nodes.append(self.child(nodes[-1], turn, 0))
        return nodes

    def order(self) -> Iterator[int]:
        """All nodes, parents first, without recursion."""
        stack = [0]
        while stack:
            node = stack.pop()
            yield node
            stack += [n for n in (self.low[node], self.high[node], self.below[node]) if n >= 0]

    def finish(self, level: int, part: int, first: set[int], last: set[int], links: list[tuple]) -> pa.RecordBatch:
        """Rows of all nodes: complete ones, open ones (on a boundary), and what became of handed-on ones (`links`)."""
        rows: list[dict] = []
        opened = first | last
        nodes = list(self.order())
        for node in reversed(nodes):
            up = self.parent[node]
            row = {
                "kind": "open" if node in opened else "node",
                "level": level,
                "part": part,
                "idx": node if node in opened else None,
                "ref": up if up in opened else None,
                "conv_id": self.smallest[node],
                "depth": self.depth[node],
                "parent_conv_id": None if up in opened or up < 0 else self.smallest[up],
                "n_convs": self.members[node],
                "ends": self.ends[node],
            }
            if node in opened:
                row |= {"turn": self.turn[node], "words": self.words[node], "on_first": node in first, "on_last": node in last}
            else:
                self.saved[node] += (self.members[node] - 1) * self.words[node]
                self.leaves[node] = self.leaves[node] if self.kids[node] else 1
                row["ends"] = row["ends"] or NONE
                if up >= 0:
                    self.kids[up] += 1
                    self.leaves[up] += self.leaves[node]
                    self.saved[up] += self.saved[node]
            # of an open node these are the sums over its complete children
            row |= {"n_children": self.kids[node], "n_leaves": self.leaves[node], "saved_tokens": self.saved[node]}
            rows.append(row)
        for old_part, idx, node in links:
            is_open = node in opened
            rows.append({
                "kind": "link", "level": level, "part": old_part, "idx": idx, "up": part,
                "ref": node if is_open else None, "conv_id": None if is_open else self.smallest[node],
            })
        return pa.RecordBatch.from_pylist(rows, _OUT)


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
_OUT = pa.schema([(field.split()[0], _TYPES[field.split()[1]]) for field in OUT.split(", ")])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tree of one sorted shard, medians inserted first."""
    from pyspark import TaskContext

    rows = [row for batch in batches for row in batch.to_pylist()]
    if not rows:
        return
    tree, halves = Tree(), [(0, len(rows))]
    for begin, end in halves:
        if begin < end:
            middle = (begin + end) // 2
            tree.insert(rows[middle])
            halves += [(begin, middle), (middle + 1, end)]
    first, last = (set(tree.path(rows[at]["ids"])) for at in (0, -1))
    yield tree.finish(0, TaskContext.get().partitionId(), first, last, [])


def _merge(rows: pa.Table, group: int, level: int, top: bool) -> pa.Table:
    """One tree of the open nodes of neighbouring parts, of which the last level's leaves none open."""
    parts: dict[int, dict[int, dict]] = {}
    for row in rows.to_pylist():
        parts.setdefault(row["part"], {})[row["idx"]] = row
    tree, links = Tree(), []
    ends: list[set[int]] = [set(), set()]
    numbers = sorted(parts)
    for number in numbers:
        place: dict[int, int] = {}
        for idx in sorted(parts[number]):  # parents have the smaller numbers
            row = parts[number][idx]
            node = place[idx] = 0 if row["depth"] == 0 else tree.child(place[row["ref"]], row["turn"], row["words"])
            tree.join(node, row["n_convs"], row["conv_id"])
            tree.kids[node] += row["n_children"]
            tree.leaves[node] += row["n_leaves"]
            tree.saved[node] += row["saved_tokens"]
            tree.ends[node] = row["ends"] or tree.ends[node]
            links.append((number, idx, node))
            if number == numbers[0] and row["on_first"]:
                ends[0].add(node)
            if number == numbers[-1] and row["on_last"]:
                ends[1].add(node)
    first, last = (set(), set()) if top else ends
    return pa.Table.from_batches([tree.finish(level, group, first, last, links)])


def _merger(level: int, top: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        return _merge(rows, key[0].as_py(), level, top)

    return merge


def build_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, ids, words), one row per conversation.

    conv_id, the smallest member; depth; parent_conv_id; n_convs; n_children; n_leaves and
    saved_tokens, summed over the subtree; ends_sha256, of the conversations that end at the node.
    """
    distinct = stored(distinct_sequences(stored(sequences, "trie-rows")), "trie-sequences")
    turns = distinct.agg(F.sum(F.size("ids").cast("long"))).first()[0] or 0
    sorted_shards = distinct.repartitionByRange(_tasks(turns, SHARD_TURNS), "ids").sortWithinPartitions("ids")
    levels = [stored(sorted_shards.mapInArrow(_shard, OUT), "trie-level")]
    while True:
        opened = levels[-1].filter("kind = 'open'")
        parts = (opened.agg(F.max("part")).first()[0] or 0) + 1
        top = parts <= MERGE
        group = F.floor(F.col("part") / MERGE).alias("group")
        levels.append(stored(opened.groupBy(group).applyInArrow(_merger(len(levels), top), OUT), "trie-level"))
        if top:
            break
    known: DataFrame | None = None  # the smallest member of each open node of the level at hand
    done = []
    for at in range(len(levels) - 1, -1, -1):
        nodes = levels[at].filter("kind = 'node'")
        done.append(nodes.filter("ref IS NULL"))
        if known is not None:
            waiting = nodes.filter("ref IS NOT NULL").drop("parent_conv_id")
            parents = known.select("part", F.col("idx").alias("ref"), F.col("conv_id").alias("parent_conv_id"))
            done.append(waiting.join(parents, ["part", "ref"]))
        links = levels[at].filter("kind = 'link'")
        if at:
            told = links.filter("ref IS NULL").select("part", "idx", "conv_id")
            if known is not None:
                later = known.select(F.col("part").alias("up"), F.col("idx").alias("ref"), "conv_id")
                told = told.unionByName(links.filter("ref IS NOT NULL").select("part", "idx", "up", "ref").join(later, ["up", "ref"]).select("part", "idx", "conv_id"))
            known = told
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    result = done[0].select(*columns)
    for frame in done[1:]:
        result = result.unionByName(frame.select(*columns))
    return result


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Every conversation c with the first crc32(c) % 4 turns of conversation c - c % 20 in front of its later ones."""
    head = F.crc32(F.col("conv_id").cast("string")) % 4
    base = F.col("conv_id") - F.col("conv_id") % 20
    heads = sequences.filter("conv_id % 20 = 0").select(
        F.col("conv_id").alias("base"), F.slice("ids", 1, 3).alias("head_ids"), F.slice("words", 1, 3).alias("head_words")
    )
    rows = sequences.withColumn("base", base).withColumn("h", head.cast("int")).join(heads, "base", "left")

    def both(name: str) -> Column:
        front = F.slice(F.coalesce(f"head_{name}", F.array().cast("array<long>")), F.lit(1), F.col("h"))
        return F.concat(front, F.slice(name, F.col("h") + 1, F.greatest(F.size(name), F.lit(1)))).alias(name)

    return rows.select("conv_id", both("ids"), both("words"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = stored(turn_ids(table(spark, sf_dir, "conversations")), "trie-turns")
    check_dictionary(ids)
    own = stored(sequences_of(ids), "trie-own")
    return build_trie(rebuilt(own))


ORACLE = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT DISTINCT conv_id, list_reduce(
    list_transform(range(length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, (i + 1)::BIGINT, 1))::BIGINT),
    lambda s, b: list_reduce(range(8), lambda t, k: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384::BIGINT) ELSE t >> 1 END, xor(s, b)),
    4294967295::BIGINT) AS crc
  FROM conversations WHERE conv_id IS NOT NULL
), sized AS (
  SELECT conv_id, xor(crc, 4294967295::BIGINT) % 4 AS h FROM heads
), mixed AS (
  SELECT s.conv_id, t.place, 0 AS own, t.role, t.text
  FROM sized s JOIN turns t ON t.conv_id = s.conv_id - s.conv_id % 20 AND t.place <= s.h
  UNION ALL
  SELECT s.conv_id, t.place, 1 AS own, t.role, t.text FROM sized s JOIN turns t USING (conv_id) WHERE t.place > s.h
), placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth, role, text FROM mixed
), steps AS (
  SELECT conv_id, 0::BIGINT AS depth, 'root' AS path, 0::BIGINT AS words FROM sized
  UNION ALL
  SELECT conv_id, depth, sha256(string_agg(sha256(role) || sha256(text), '') OVER
           (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS path,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words
  FROM placed
), sizes AS (
  SELECT conv_id, max(depth) AS turns FROM steps GROUP BY conv_id
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs, max(words) AS words,
         sha256(coalesce(string_agg(CASE WHEN depth = turns THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM steps JOIN sizes USING (conv_id) GROUP BY path, depth
), parents AS (
  SELECT n.path, n.depth, p.path AS parent_path, q.conv_id AS parent_conv_id
  FROM nodes n JOIN steps p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 JOIN nodes q ON q.path = p.path AND q.depth = p.depth
), kids AS (
  SELECT parent_path AS path, count(*)::BIGINT AS n_children FROM parents GROUP BY parent_path
), full_nodes AS (
  SELECT n.*, parent_conv_id, coalesce(n_children, 0)::BIGINT AS n_children
  FROM nodes n LEFT JOIN parents USING (path) LEFT JOIN kids ON kids.path = n.path
), below AS (
  SELECT DISTINCT a.path AS top, b.path
  FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), sums AS (
  SELECT top, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM below JOIN full_nodes USING (path) GROUP BY top
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM full_nodes JOIN sums ON sums.top = full_nodes.path
"""
