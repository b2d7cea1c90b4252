"""Streams of captured events: what each producer's sequence numbers cover, and an append that may be repeated."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Gaps that a producer may have open; a number that would open more is refused and may be sent again later.
MOST_GAPS = 1024
OUTCOMES = "producer long, sequence long, outcome string, contiguous_through long"
_STATE = "head long, gaps string"


class Coverage:
    """The numbers from 1 that a producer has sent: the highest, and the open gaps below it in order."""

    def __init__(self, head: int = 0, gaps: Iterable[Iterable[int]] = ()):
        self.head, self.gaps = head, [tuple(g) for g in gaps]

    @property
    def contiguous_through(self) -> int:
        return self.gaps[0][0] - 1 if self.gaps else self.head

    def take(self, n: int, most: int = MOST_GAPS) -> str:
        """`next`, `ahead` (a gap opens), `late` (it lies in a gap), `duplicate`, or `refused` (below 1, or too many gaps)."""
        if n < 1:
            return "refused"
        if n > self.head:
            new = [(self.head + 1, n - 1)] if n > self.head + 1 else []
            if len(self.gaps) + len(new) > most:
                return "refused"
            self.gaps, self.head = self.gaps + new, n
            return "ahead" if new else "next"
        at = bisect_right(self.gaps, (n, self.head)) - 1
        if at < 0 or self.gaps[at][1] < n:
            return "duplicate"
        low, high = self.gaps[at]
        left = [g for g in ((low, n - 1), (n + 1, high)) if g[0] <= g[1]]
        if len(self.gaps) - 1 + len(left) > most:
            return "refused"
        self.gaps[at : at + 1] = left
        return "late"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    head, gaps = state.get if state.exists else (0, "[]")
    held = Coverage(head, json.loads(gaps))
    for frame in frames:
        rows = [(key[0], n, held.take(int(n)), held.contiguous_through) for n in frame["sequence"]]
        yield pd.DataFrame(rows, columns=["producer", "sequence", "outcome", "contiguous_through"])
    state.update((held.head, json.dumps(held.gaps)))


def coverage(stream: DataFrame) -> DataFrame:
    """An outcome for each (producer, sequence: longs) of a stream. State is a number and a bounded list for each producer.

    Rows with a null in either are left out. The order within a micro-batch isn't defined; over batches, first come first served.
    """
    rows = stream.where("producer is not null and sequence is not null").select("producer", "sequence")
    return rows.groupBy("producer").applyInPandasWithState(_advance, OUTCOMES, _STATE, "append", GroupStateTimeout.NoTimeout)


def append_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet at `path`, a folder for each micro-batch: a batch that is run again replaces its own rows."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
