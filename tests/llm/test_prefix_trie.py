"""The prefix trie against one built from the definition, in few and in many shards."""

import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventlens.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    told = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        told[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(told):
        for d in range(len(told[c]) + 1):
            members[told[c][:d]].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len(path[-1][1].split()) if path else 0
        leaves[path] = sum(leaves[k] for k in kids[path]) if kids[path] else 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[k] for k in kids[path])
    return {
        (
            members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p],
            hashlib.sha256(",".join(str(c) for c in members[p] if told[c] == p).encode()).hexdigest(),
        )
        for p in members
    }


def got(spark, frame, tmp_path):
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    rows = trie.op12_prefix_trie(spark, str(tmp_path)).collect()
    return {tuple(r[c] for c in trie_columns) for r in rows}, len(rows)


trie_columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sample(seed, convs):
    """Many equal conversations, hot first turns, deep and short ones, in shuffled order."""
    random.seed(seed)
    rows = []
    for c in range(-5, convs):
        for turn in range(random.choice([1, 2, 3, 3, 5, 40 if c % 37 == 0 else 4])):
            same = random.random() < 0.7
            rows.append((c, turn, random.choice(["user", "bot"]) if not same else "user", f"hi {turn}" if same else f"t {random.randrange(9)} x"))
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize(("small", "merge"), [(4, 2), (16, 3), (1 << 11, 64)])
def test_equals_the_definition(spark, tmp_path, monkeypatch, small, merge):
    monkeypatch.setattr(trie, "SMALL_SHARD", small)
    monkeypatch.setattr(trie, "MERGE", merge)
    rows = sample(small, 260)
    found, count = got(spark, spark.createDataFrame(rows, SCHEMA), tmp_path)
    assert count == len(found)
    assert found == expected(rows)


def test_nulls_repeats_long_texts_and_other_columns(spark, tmp_path):
    rows = [
        (1, None, None, None), (1, 0, "user", ""), (2, 0, None, "a b"), (2, 1, "user", "w " * 100_000), (None, 0, "user", "x"),
        (3, 0, "user", "same"), (3, 0, "user", "same"), (20, 0, "x", "y"), (21, 0, "x", "y"), (25, 0, "q", None), (-7, 0, "x", "y"),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "ids", "words", "check", "base", "h", "n", "ends", "part"):
        frame = frame.withColumn(name, F.lit("x"))
    found, _ = got(spark, frame, tmp_path)
    assert found == expected(rows)


def test_empty_table(spark, tmp_path):
    assert got(spark, spark.createDataFrame([], SCHEMA), tmp_path) == (set(), 0)


def test_digest_in_pieces(monkeypatch):
    """A sequence of many conversations is digested piece by piece, over several sorted ranges."""
    monkeypatch.setattr(trie, "CHUNK", 3)
    rows = [{"a": 1, "b": 1, "conv_id": i, "ids": [5], "words": [2]} for i in range(20)]
    rows += [{"a": 2, "b": 1, "conv_id": 3, "ids": [6], "words": [1]}]
    pieces = [b for part in (rows[:7], rows[7:]) for b in trie._pieces(iter([pa.RecordBatch.from_pylist(part)]))]
    assert max(p["n"] for b in pieces for p in b.to_pylist()) == 3
    out = [r for b in trie._digests(iter(pieces)) for r in b.to_pylist()]
    assert [(r["conv_id"], r["n"]) for r in out] == [(0, 20), (3, 1)]
    assert out[0]["ends"] == hashlib.sha256(",".join(map(str, range(20))).encode()).hexdigest()


def test_search_trees_stay_shallow():
    """Medians first: among 1000 first turns none is more than about log2 steps away."""
    tree, halves = trie.Tree(), [(0, 1000)]
    rows = [{"ids": [i], "words": [1], "n": 1, "conv_id": i, "ends": "e"} for i in range(1000)]
    for begin, end in halves:
        if begin < end:
            middle = (begin + end) // 2
            tree.insert(rows[middle])
            halves += [(begin, middle), (middle + 1, end)]
    depth, level = 0, [tree.below[0]]
    while level:
        depth += 1
        level = [n for at in level for n in (tree.low[at], tree.high[at]) if n >= 0]
    assert depth == 10


def test_clashing_ids_are_refused(spark):
    ids = spark.createDataFrame([(1, 5, 6), (2, 5, 7)], "conv_id long, id long, check long")
    with pytest.raises(ValueError, match="one id"):
        trie.check_dictionary(ids)
