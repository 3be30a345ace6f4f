"""The subpackage's queries against their SQL, and the pipeline against its stages, on the smallest sample."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from eventlens.llm import registry

duckdb = pytest.importorskip("duckdb")
SAMPLE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SAMPLE), reason="no sample tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(SAMPLE):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SAMPLE}/{file}'")
    got = entry.queries()[name](spark, SAMPLE)
    expected = connection.execute(entry.oracle_sql()[name])
    columns = sorted(c[0] for c in expected.description)
    assert sorted(got.columns) == columns
    at = [[c[0] for c in expected.description].index(c) for c in columns]
    rows = [tuple(r[i] for i in at) for r in expected.fetchall()]
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, rows))


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    """Each stage on what the one before left, with the figures that have to agree between them."""
    from eventlens.llm import quality, secrets

    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], SAMPLE).write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(f.columns == columns for f in frames[:-1])
    ids = [sorted(r["doc_id"] for r in f.select("doc_id").collect()) for f in frames]
    kept = {r["doc_id"] for r in quality.apply_rules(docs).filter("kept").collect()}
    assert set(ids[1]) == kept
    assert len(ids[2]) == len(set(ids[2])) <= len(ids[1]) and set(ids[2]) <= set(ids[1])
    assert ids[3] == ids[2] and set(ids[4]) <= set(ids[3]) and ids[5] == ids[4]
    left = secrets.find_secrets(frames[3]).selectExpr("size(fixed) AS n").agg({"n": "sum"}).first()[0]
    assert left == 0
    whole = corpus_pipeline.run(spark, SAMPLE)
    assert sorted(map(str, whole.collect())) == sorted(map(str, frames[5].collect()))


def test_pipeline_on_an_empty_table(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_with_nulls_repeats_long_texts_and_other_columns(spark, make_docs, tmp_path):
    from pyspark.sql import functions as F

    prose = " ".join(f"word{i}" for i in range(90))
    other = " ".join(f"more{i}" for i in range(120))
    rows = [
        (1, prose, "a", "en"), (1, prose, "a", "en"), (2, None, None, None), (3, "", "b", "en"), (4, other, "b", None),
        (5, "long " * 3 + " ".join(f"x{i}" for i in range(60_000)), "c", "de"), (6, other + " end", "b", "en"), (7, "short", "a", "en"),
    ]
    frame = make_docs(rows)
    for name in ("removed", "removed_words", "kept", "figures", "row", "root", "label", "ids", "taken", "size", "h", "l", "first"):
        frame = frame.withColumn(name, F.lit("x"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # texts of fewer than 50 words go, of repeats and near copies one stays; the mix need not take the one that outweighs all others
    assert {r["doc_id"] for r in got} - {5} == {1, 4}
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_the_rest_does_not_need_the_subpackage(tmp_path):
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("__spark_entry__.py", "eventlens"):
        os.symlink(f"{root}/{name}", tmp_path / name) if name.endswith(".py") else os.mkdir(tmp_path / name)
    for name in os.listdir(f"{root}/eventlens"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/eventlens/{name}", tmp_path / "eventlens" / name)
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import runpy; e = runpy.run_path({str(tmp_path)!r} + '/__spark_entry__.py'); print(sorted(e['queries']()))"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path)
    assert said.returncode == 0, said.stderr
    assert "window_scan" in said.stdout
