"""Keyed state for `transformWithState`."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import (
    StatefulProcessor,
    StatefulProcessorHandle,
)

from eventlens.operators.admission import permits


class RateProcessor(StatefulProcessor):
    """One number per token: when its next permit is due.

    Rows are distinct milliseconds of a token, each with the batches that came in it; what is held at a time are
    the milliseconds of one token in one micro-batch.
    """

    def __init__(self, rates: dict[str, tuple[int, int]]) -> None:
        self.rates = rates

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.due = handle.getValueState("due", "due_ns long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        token = key[0]
        arrived: dict[int, list] = defaultdict(list)
        for row in rows:
            arrived[row.at_ms].extend(row.batch_ids)
        due = self.due.get()[0] if self.due.exists() else min(arrived) * 1_000_000
        for at_ms in sorted(arrived):
            wanted = sorted(arrived[at_ms])
            granted, due = permits(due, at_ms * 1_000_000, len(wanted), *self.rates[token])
            for place, batch_id in enumerate(wanted):
                yield Row(batch_id=batch_id, token_name=token, at_ms=at_ms, allowed=place < granted)
        self.due.update((due,))

    def close(self) -> None:
        pass
