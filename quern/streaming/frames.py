"""Stateful streams: ingested frames with acknowledgements, circuit breakers, retained events, leases, scheduled work, resumed runs.

Each is a small machine over one key's state with a bound on what it holds; the same machine runs in applyInPandasWithState and, over
rows at rest, in a grouped fold. Streams are read with a checkpoint, so a restart resumes from the state that was committed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Frames that a stream may hold before it is complete; events that a reader's ring keeps; open work of a workspace.
MOST_FRAMES, MOST_EVENTS, MOST_OPEN = 10_000, 1000, 1000


class Frames:
    """A stream of frames: a manifest at position 0, then each next position; a repeated one replays its acknowledgement."""

    columns = "position long, outcome string"

    def __init__(self, held: dict | None = None):
        self.held = held or {"digests": [], "total": None, "done": False}

    def take(self, position: int, digest: str, total: int | None = None) -> str:
        """accepted, complete, replay, conflict (another digest there), skipped, no_manifest, or over (too many, or behind the end)."""
        d = self.held["digests"]
        if 0 <= position < len(d):
            return "replay" if d[position] == digest else "conflict"
        if position != len(d):
            return "no_manifest" if not d else "skipped"
        if position == 0:
            if total is None or total < 1:
                return "no_manifest"
            self.held["total"] = int(total)
        if self.held["done"] or len(d) >= min(MOST_FRAMES, self.held["total"]):
            return "over"
        d.append(digest)
        self.held["done"] = len(d) == self.held["total"]
        return "complete" if self.held["done"] else "accepted"


class Breaker:
    """A circuit breaker: so many failures in a row open it until a time; then one probe decides. Errors that say nothing of health close it."""

    columns = "at long, outcome string, state string"

    def __init__(self, held: dict | None = None, threshold: int = 3, open_for: int = 30_000):
        self.held = held or {"failures": 0, "retry_at": None}
        self.threshold, self.open_for = threshold, open_for

    def take(self, at: int, result: str) -> tuple[str, str]:
        """What became of a call at a time with result ok, failure or neutral: (called or refused, state after)."""
        h = self.held
        if h["retry_at"] is not None and at < h["retry_at"]:
            return "refused", "open"
        probe = h["retry_at"] is not None
        if result == "failure":
            h["failures"] += 1
            if probe or h["failures"] >= self.threshold:
                h["retry_at"] = at + self.open_for
                return "called", "open"
            return "called", "closed"
        h["failures"], h["retry_at"] = 0, None
        return "called", "closed"


class Ring:
    """The last events of a reader; a cursor under what was dropped has expired."""

    columns = "event_id long, dropped_before long, kept long"

    def __init__(self, held: dict | None = None, most: int = MOST_EVENTS):
        self.held, self.most = held or {"ids": [], "dropped_before": 0}, most

    def take(self, event_id: int) -> tuple[int, int]:
        ids = self.held["ids"]
        if event_id not in ids:
            ids.append(event_id)
        while len(ids) > self.most:
            self.held["dropped_before"] = ids.pop(0) + 1
        return self.held["dropped_before"], len(ids)

    def read(self, after: int, most: int) -> list[int]:
        """Events behind a cursor, in order; ValueError if it has expired."""
        if after + 1 < self.held["dropped_before"]:
            raise ValueError("the cursor has expired")
        return sorted(i for i in self.held["ids"] if i > after)[:most]


class Queue:
    """Scheduled work: the same work is held once, at its most urgent priority; batches are of one kind, urgent first, then as it came."""

    columns = "work string, outcome string"
    URGENCY = ("urgent", "normal", "bulk")

    def __init__(self, held: dict | None = None, most: int = MOST_OPEN):
        self.held, self.most = held or {"seq": 0, "open": {}}, most

    def take(self, work: str, kind: str, priority: str) -> str:
        """queued, coalesced, raised (now more urgent) or refused (too much is open)."""
        own, rank = self.held["open"].get(work), self.URGENCY.index(priority)
        if own is not None:
            if rank < own[0]:
                own[0] = rank
                return "raised"
            return "coalesced"
        if len(self.held["open"]) >= self.most:
            return "refused"
        self.held["seq"] += 1
        self.held["open"][work] = [rank, self.held["seq"], kind]
        return "queued"

    def drain(self, most: int) -> list[str]:
        """The next batch: up to `most` works of the kind of the most urgent one."""
        order = sorted(self.held["open"].items(), key=lambda e: e[1][:2])
        batch = [w for w, e in order if e[2] == order[0][1][2]][:most] if order else []
        for w in batch:
            del self.held["open"][w]
        return batch


class Lease:
    """A lease on a clock that never goes back: who holds it may renew it before it ends; behind that anyone may take it, with a higher fence."""

    columns = "at long, holder string, outcome string, fence long"

    def __init__(self, held: dict | None = None, length: int = 10_000):
        self.held, self.length = held or {"now": 0, "holder": None, "until": 0, "fence": 0}, length

    def take(self, at: int, holder: str) -> tuple[str, int]:
        h = self.held
        h["now"] = max(h["now"], at)
        if h["holder"] == holder and h["now"] < h["until"]:
            h["until"] = h["now"] + self.length
            return "renewed", h["fence"]
        if h["holder"] is not None and h["now"] < h["until"]:
            return "held", h["fence"]
        h["holder"], h["until"], h["fence"] = holder, h["now"] + self.length, h["fence"] + 1
        return "taken", h["fence"]


def resume(journal: list[tuple[str, str]], checkpoint: int, most: int = 1000) -> dict[str, str]:
    """What a resumed run knows of its requests: done with a result, else unknown (never sent again). `journal` is (request, event) in order; at most `most` lie behind the checkpoint."""
    if len(journal) - checkpoint > most:
        raise ValueError("too much lies behind the checkpoint")
    known: dict[str, str] = {}
    for request, event in journal:
        known[request] = "done" if event == "result" else known.get(request, "unknown")
    return known


def _machine(kind: type, key: str, fields: list[str], order: list[str]) -> Callable:
    names = [c.split()[0] for c in kind.columns.split(", ")]

    def rows(machine, frame: pd.DataFrame) -> list[tuple]:
        out = []
        for r in frame.sort_values(order, kind="stable").itertuples(index=False):
            args = [None if pd.isna(v := getattr(r, f)) else v for f in fields]
            got = machine.take(*args)
            said = got if isinstance(got, tuple) else (got,)
            echo = [args[fields.index(n)] for n in names if n in fields]
            out.append((*echo, *said))
        return out

    def frame_of(value, found: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=names)
        out.insert(0, key, value)
        return out

    return rows, frame_of


def stream(kind: type, rows: DataFrame, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """The outcomes of a machine over a stream, its state kept for each key; rows with a null key are left out. In a micro-batch rows go by `order`."""
    take, frame_of = _machine(kind, key, fields, order)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = kind(json.loads(state.get[0]) if state.exists else None)
        whole = pd.concat(list(frames))  # a key's share of one micro-batch
        found = take(machine, whole)
        state.update((json.dumps(machine.held),))
        yield frame_of(k[0], found)

    schema = f"{key} {dict(rows.dtypes)[key]}, {kind.columns}"
    return rows.where(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(run, schema, "held string", "append", GroupStateTimeout.NoTimeout)


def fold(kind: type, rows: DataFrame, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """The same over rows at rest: sorted within partitions, each key's rows pass by once, and only the state of the key at hand is held."""
    take, frame_of = _machine(kind, key, fields, order)
    ordered = rows.where(F.col(key).isNotNull()).select(key, *dict.fromkeys([*fields, *order])).repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, machine = None, None
        for b in batches:
            for value, part in b.groupby(key, sort=False):
                if machine is None or value != at:
                    at, machine = value, kind()
                yield frame_of(value, take(machine, part))

    return ordered.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, {kind.columns}")


def subscribe(events: DataFrame, allowed: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Events that the reader may see, each id once for an hour of event time, appended batch by batch: a resumed query goes on from its checkpoint."""
    seen = events.withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["event_id"]).join(F.broadcast(allowed), key, "left_semi")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return seen.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def project(stream_: DataFrame, path: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """A table with the last row of each key, rebuilt by each micro-batch into a folder of its own; `current` in the folder's name order is the last one."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v={number - 1}") if number else None
        rows = batch if old is None else old.select(*batch.columns).unionByName(batch)
        rest = [c for c in batch.columns if c != key]
        rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*").write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream_.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
