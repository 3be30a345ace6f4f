import json
import random

import pytest
from pyspark.sql import functions as F

from eventlens.functions.embedding import hash_embedder
from eventlens.model import KIND, SOURCE, VECTOR, VectorFilter
from eventlens.operators import search

TEXTS = {
    "a": "person walked to the front door",
    "b": "the washing machine finished",
    "c": "temperature is rising slowly",
}


@pytest.fixture(scope="module")
def stored(make_events):
    return make_events(
        [(k, f"cam.{k}", "note", i * 100, json.dumps({"text": t})) for i, (k, t) in
         enumerate(TEXTS.items())]
    )


@pytest.fixture(scope="module")
def indexed(stored):
    return search.embed_events(stored).cache()


def test_best_hit(indexed):
    hits = search.search(indexed, "person at the front door", 2).collect()
    assert len(hits) == 2 and hits[0]["event_id"] == "a"
    assert hits[0]["score"] >= hits[1]["score"]


def test_filters(indexed, ids):
    by_time = VectorFilter(100, 200)
    assert ids(search.search(indexed, "x", None, by_time)) == ["b"]
    assert ids(search.search(indexed, "x", None, VectorFilter(start_ms=100))) == ["b", "c"]
    assert ids(search.search(indexed, "x", None, VectorFilter(sources=("cam.[ab]",)))) == ["a", "b"]
    assert ids(search.search(indexed, "x", None, VectorFilter(kinds=("other",)))) == []


@pytest.mark.parametrize("query", ["", "  \n"])
def test_blank_query(indexed, query):
    with pytest.raises(ValueError, match="empty"):
        search.search(indexed, query)


def test_bad_range(indexed):
    with pytest.raises(ValueError, match="empty time range"):
        search.search(indexed, "x", flt=VectorFilter(5, 5))


def test_limit():
    assert [search.top_k(n) for n in (None, 1, 7, 50, 1000)] == [10, 1, 7, 50, 1000]
    for bad in (0, -3):
        with pytest.raises(ValueError, match="limit"):
            search.top_k(bad)


def test_hydrate_keeps_every_hit(spark, make_events):
    hits = spark.createDataFrame([(f"e{i:03}", float(i), False) for i in range(80)], "event_id string, score double, truncated boolean")
    rows = make_events([(f"e{i:03}", "s", "k", i) for i in range(80)])
    got = [r["score"] for r in search.hydrate(hits, rows).collect()]
    assert got == [float(i) for i in range(79, -1, -1)]


def test_whole_texts_are_embedded(make_events):
    rows = make_events([("a", "s", "k", 1, "word " * 2000 + "tail"), ("b", "s", "k", 1, "word " * 2000)])
    got = {r["event_id"]: r for r in search.embed_events(rows).collect()}
    assert got["a"]["vector"] != got["b"]["vector"] and not got["a"]["truncated"]


def test_ties_go_by_id(spark):
    rows = [(i, "s", "k", 1, False, "m", [1.0, 0.0]) for i in ("c", "a", "b")]
    hits = search.search_vector(spark.createDataFrame(rows, VECTOR), [1.0, 0.0], 2).collect()
    assert [h["event_id"] for h in hits] == ["a", "b"]


def test_hydrate_skips_swept_events(indexed, stored):
    hits = search.search(indexed, "person at the front door")
    rows = search.hydrate(hits, stored.where("event_id <> 'b'")).collect()
    assert [r["event_id"] for r in rows] == ["a", "c"]
    assert rows[0]["semantic"] == json.dumps({"text": TEXTS["a"]}) and rows[0]["score"] > 0


def test_truncation_flag(make_events):
    rows = make_events([("long", "s", "k", 1, "aaa日本"), ("short", "s", "k", 1, "aaa")])
    got = {r["event_id"]: r for r in search.embed_events(rows, max_bytes=5).collect()}
    assert got["long"]["truncated"] and not got["short"]["truncated"]
    assert got["long"]["vector"] == got["short"]["vector"]


def test_selection(spark, make_events, ids):
    def source(name, embed):
        return tuple({"source_id": name, "kinds": [], "embed": embed, "ord": 0}.get(f)
                     for f in SOURCE.fieldNames())

    def kind(name, embed, ord=0):
        return tuple({"name": name, "embed": embed, "ord": ord}.get(f) for f in KIND.fieldNames())

    sources = spark.createDataFrame([source("off", False), source("on", True), source("x", None)], SOURCE)
    kinds = spark.createDataFrame([kind("yes", True), kind("no", False)], KIND)
    rows = make_events(
        [("1", "off", "yes", 1), ("2", "on", "no", 1), ("3", "x", "yes@v2", 1), ("4", "x", "no", 1),
         ("5", "other", "unknown", 1)]
    )
    assert ids(search.select_for_embedding(rows, sources, kinds)) == ["2", "3"]
    assert ids(search.select_for_embedding(rows, sources, kinds, True)) == ["2", "3", "5"]


@pytest.mark.parametrize("block_size", [3, 100])
def test_search_many_equals_single_searches(spark, block_size):
    rng = random.Random(5)

    def vector():
        return [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]

    rows = [(f"{i:03d}", "s", "k", i, False, "m", vector()) for i in range(120)]
    vectors = spark.createDataFrame(rows, VECTOR).repartition(5)
    asked = [(f"q{i}", vector()) for i in range(10)]
    queries = spark.createDataFrame(asked, "query_id string, query array<double>")
    flt = VectorFilter(start_ms=10)
    got = search.search_many(vectors, queries, 4, flt, block_size)
    mine: dict[str, list] = {}
    for r in got.orderBy("query_id", "rank").collect():
        mine.setdefault(r["query_id"], []).append((r["event_id"], r["score"]))
    for name, query in asked:
        single = search.search_vector(vectors, query, 4, flt).collect()
        assert mine[name] == [(h["event_id"], h["score"]) for h in single]


def test_search_many_without_queries(spark, indexed):
    nothing = spark.createDataFrame([], "query_id long, query array<float>")
    assert search.search_many(indexed, nothing).count() == 0


def test_embedder_is_pluggable(stored):
    @F.pandas_udf("array<float>")
    def length(texts):
        return texts.map(lambda t: [float(len(t))])

    model = hash_embedder().__class__("length", 1, length, lambda t: [float(len(t))])
    rows = search.embed_events(stored, model).collect()
    assert {r["model_id"] for r in rows} == {"length"}
    assert all(len(r["vector"]) == 1 for r in rows)


def test_search_many_scans_the_vectors_once(spark, tmp_path):
    rows = [(f"{i:03d}", "s", "k", i, False, "m", [1.0, float(i)]) for i in range(50)]
    spark.createDataFrame(rows, VECTOR).write.parquet(str(tmp_path / "v"))
    queries = spark.createDataFrame([(i, [1.0, -float(i)]) for i in range(40)], "query_id long, query array<double>")
    hits = search.search_many(spark.read.parquet(str(tmp_path / "v")), queries, 2, block_size=4)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [event_id") == 1 and plan.count("MapInArrow _pack") == 1
    assert hits.count() == 80


def test_ties_beyond_the_limit_go_by_id(spark):
    rows = [(f"{i:04d}", "s", "k", 1, False, "m", [1.0, 0.0]) for i in reversed(range(3000))]
    vectors = spark.createDataFrame(rows, VECTOR).repartition(2)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, query array<double>")
    got = search.search_many(vectors, queries, 3).orderBy("query_id", "rank").collect()
    assert [r["event_id"] for r in got] == ["0000", "0001", "0002"] * 2
