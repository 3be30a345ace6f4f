"""Ranked lexical search against a brute-force ranking, and its bounds."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from eventlens.llm import lexical
from eventlens.llm.common import stored

TERM = re.compile(lexical.TERM)


def said(text):
    table = str.maketrans(lexical.UPPER, lexical.LOWER)
    return Counter(TERM.findall((text or "").translate(table)))


def ranking(docs, items, k):
    """Scores straight from the definition."""
    held = [(doc, said(text)) for doc, text, *_ in docs]
    held = [(doc, c) for doc, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = set()
    for item, text in items:
        hits = []
        for doc, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for t in said(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                hits.append((-score, doc is None, doc))
        hits.sort()
        out |= {(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(hits[:k], 1)}
    return out


def found(spark, make_docs, docs, items, k):
    index = lexical.store_index(lexical.build_index(make_docs(docs)))
    queries = lexical.query_terms(spark.createDataFrame(items, "item_id long, text string"))
    got = lexical.search(index, queries, k).collect()
    assert len({(r["item_id"], r["rank"]) for r in got}) == len(got)
    return {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got}


def test_equals_brute_force(spark, make_docs):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)] + ["ÉTÉ", "été", "日本", "A1", "a1", "x" * 5000]
    odds = 1 / np.arange(1, len(words) + 1)
    odds /= odds.sum()
    docs = [(i, ", ".join(rng.choice(words, rng.integers(1, 200), p=odds))) for i in range(700)]
    docs += [(700, None), (701, ""), (702, ".,;"), (3, docs[3][1]), (None, docs[4][1]), (703, "w1 " * 50_000)]
    docs += [(1000 + i, docs[5][1]) for i in range(80)]  # ties
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "unseen words"), (103, docs[5][1]), (104, "W1 w1!w2")]
    assert found(spark, make_docs, docs, items, 20) == ranking(docs, items, 20)


def test_empty_tables_and_other_columns(spark, make_docs):
    assert found(spark, make_docs, [], [(1, "a")], 5) == set()
    assert found(spark, make_docs, [(1, "a b")], [(1, None)], 5) == set()
    docs = make_docs([(1, "a b"), (2, "c d"), (3, "a a")])
    for name in ("term", "spread", "score", "rank", "item_id", "_text0"):
        docs = docs.withColumn(name, docs["source"])
    index = stored(lexical.build_index(docs), "index")
    items = spark.createDataFrame([(1, "a", "x", "y")], "item_id long, text string, term string, w string")
    got = lexical.search(index, lexical.query_terms(items), 5).collect()
    assert [(r["rank"], r["doc_id"]) for r in got] == [(1, 3), (2, 1)]


def test_many_query_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 3)
    docs = [(i, f"a{i % 7} b{i % 11} c{i}") for i in range(60)]
    items = [(i, f"a{i % 7} b{i % 5}") for i in range(20)]
    assert found(spark, make_docs, docs, items, 4) == ranking(docs, items, 4)


@pytest.mark.parametrize("level", range(len(lexical.LEVELS)))
def test_bounds_never_fall_below_the_value(level):
    """Every document's value at each number of occurrences stays within its bound."""
    rng = np.random.default_rng(level)
    block = lexical._Block(256)
    terms = np.sort(rng.integers(-(1 << 62), 1 << 62, 12))
    counts = rng.integers(lexical.LEVELS[level], lexical.LEVELS[level] + 9, (20, 12))
    for d in range(20):
        block.add(d, int(counts[d].sum()), terms, counts[d])
    row = block.row(0)
    m = 50 + np.arange(20)
    matrix = np.frombuffer(row["slices"], np.uint8).reshape(256, -1)
    most = lexical.bounds(matrix, 256, 20, terms, m)
    assert (most >= lexical.value(counts.T, m[None, :])).all()
