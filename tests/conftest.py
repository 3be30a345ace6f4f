import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from eventlens.model import EVENT  # noqa: E402
from eventlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_events(spark):
    """Events from short tuples (id, source, kind, ts[, semantic[, ingest]])."""

    def make(rows):
        full = []
        for row in rows:
            event_id, source, kind, ts, *rest = row
            semantic = rest[0] if rest else "{}"
            ingest = rest[1] if len(rest) > 1 else ts
            full.append((event_id, source, kind, ts, semantic, None, None, ingest, None, None, None))
        return spark.createDataFrame(full, EVENT)

    return make


@pytest.fixture(scope="session")
def ids():
    """Sorted values of one column, as a list."""

    def get(df, column="event_id"):
        return sorted(row[column] for row in df.select(column).collect())

    return get
