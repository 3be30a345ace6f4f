"""Every registered query against its SQL, on the smallest sample."""

import os

import pytest

import __spark_entry__ as entry
from eventlens.operators import admission
from eventlens.plans import settings
from eventlens.plans.oracle import ORACLE
from eventlens.plans.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
SAMPLE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SAMPLE), reason="no sample tables")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in os.listdir(SAMPLE):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SAMPLE}/{file}'")
    return connection


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, tables, name):
    got = entry.queries()[name](spark, SAMPLE)
    expected = tables.execute(entry.oracle_sql()[name])
    columns = sorted(c[0] for c in expected.description)
    assert sorted(got.columns) == columns
    at = [[c[0] for c in expected.description].index(c) for c in columns]
    rows = [tuple(r[i] for i in at) for r in expected.fetchall()]
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, rows))


def test_rate_limit_query(spark):
    """The rule applied batch by batch."""
    got = QUERIES["rate_limit"](spark, SAMPLE).collect()
    rates = {t.name: t.rate_limit for t in settings.TOKENS}
    due: dict[str, int] = {}
    for row in sorted(got, key=lambda r: (r["token_name"], r["at_ms"], r["batch_id"])):
        token, rate = row["token_name"], rates[row["token_name"]]
        if rate is None:
            assert row["allowed"]
            continue
        now = row["at_ms"] * 1_000_000
        burst, step = admission.parse_rate(rate)
        allowed = max(due.get(token, 0), now) + step - now <= burst * step
        assert row["allowed"] == allowed
        if allowed:
            due[token] = max(due.get(token, 0), now) + step


def test_entry(spark):
    assert entry.entry(spark).count() > 0
