"""What happened in a time range: ordered scan and keyset pages."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from eventlens.functions.globs import glob_filter, time_between
from eventlens.functions.scalars import day_of
from eventlens.model import Anchor, WindowFilter


class CursorMismatch(ValueError):
    """The token belongs to another filter."""


class CursorMalformed(ValueError):
    """The token cannot be read."""


def window_rows(events: DataFrame, flt: WindowFilter, anchor: Anchor | None = None) -> DataFrame:
    """Matching rows without order or limit.

    A log stored by day is also filtered by ``day``, which prunes directories.
    """
    if flt.end_ms <= flt.start_ms:
        raise ValueError(f"empty time range: end {flt.end_ms} <= start {flt.start_ms}")
    start = flt.start_ms if anchor is None else max(flt.start_ms, anchor.ts_ms_utc)
    ts = F.col("ts_ms_utc")
    cond = time_between(ts, start, flt.end_ms)
    if "day" in events.columns:
        cond &= F.col("day").between(day_of(F.lit(start)), day_of(F.lit(flt.end_ms - 1)))
    cond &= glob_filter(F.col("source_id"), flt.sources)
    cond &= glob_filter(F.col("kind"), flt.kinds)
    if anchor is not None:
        cond &= (ts > anchor.ts_ms_utc) | (
            (ts == anchor.ts_ms_utc) & (F.col("event_id") > anchor.event_id)
        )
    return events.where(cond)


def window_scan(events: DataFrame, flt: WindowFilter, anchor: Anchor | None = None) -> DataFrame:
    """Rows after ``anchor`` by (event time, id); a distributed top-n if the filter has a limit."""
    rows = window_rows(events, flt, anchor).orderBy("ts_ms_utc", "event_id")
    return rows if flt.limit is None else rows.limit(flt.limit)


def _filter_hash(flt: WindowFilter) -> str:
    canonical = [
        flt.start_ms, flt.end_ms, flt.page_size,
        sorted(flt.sources or ()), sorted(flt.kinds or ()),
    ]
    return hashlib.sha256(json.dumps(canonical).encode()).hexdigest()[:32]


def page_token(flt: WindowFilter, anchor: Anchor) -> str:
    body = json.dumps([_filter_hash(flt), anchor.ts_ms_utc, anchor.event_id])
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def read_token(token: str, flt: WindowFilter) -> Anchor:
    try:
        padded = token + "=" * (-len(token) % 4)
        body = base64.b64decode(padded.encode("ascii"), altchars=b"-_", validate=True)
        seen, ts_ms, event_id = json.loads(body)
        anchor = Anchor(int(ts_ms), str(event_id))
    except (ValueError, TypeError) as error:
        raise CursorMalformed("cursor is malformed") from error
    if seen != _filter_hash(flt):
        raise CursorMismatch("cursor_filter_mismatch")
    return anchor


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    next_token: str | None


def get_page(events: DataFrame, flt: WindowFilter, token: str | None = None) -> Page:
    """One page; a full page carries a token even if nothing follows it."""
    anchor = read_token(token, flt) if token is not None else None
    rows = window_scan(events, replace(flt, limit=flt.page_size), anchor).collect()
    full = bool(rows) and len(rows) >= flt.page_size
    last = Anchor(rows[-1]["ts_ms_utc"], rows[-1]["event_id"]) if full else None
    return Page(rows, page_token(flt, last) if last else None)


def iter_pages(events: DataFrame, flt: WindowFilter) -> Iterator[Page]:
    """Pages in order until the window is exhausted; each is its own query."""
    token: str | None = None
    while True:
        page = get_page(events, flt, token)
        yield page
        token = page.next_token
        if token is None:
            return


def window_all(events: DataFrame, flt: WindowFilter) -> DataFrame:
    """The whole window as one globally sorted DataFrame, for bulk readers.

    Same rows and order as `iter_pages`, from a range-partitioned sort.
    """
    return window_rows(events, flt).orderBy("ts_ms_utc", "event_id")
