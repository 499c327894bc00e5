"""Streams whose state lapses: sliding windows of requests, leases, and the log of runs.

Each is a processor on the RocksDB store in event time: what a key holds is dropped by a timer once the watermark says that no
row can ask for it any more. Rows of a key are taken in order within a batch of the stream; a stream whose batches come in
order of time gives the rows of its batch twin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# --- fixed values -----------------------------------------------------------------
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEASE_MS, LEASES = 90_000, 3
#: Rows that a task packs by key at once.
PACKED = 500_000
RUNNING, COMPLETED, FAILED, SKIPPED = "running", "completed", "failed", "skipped"
#: What may follow what; before its first row, and after it has ended, a stage of a segment is idle.
LEGAL = {"idle": (RUNNING, FAILED), RUNNING: (COMPLETED, FAILED, SKIPPED)}
# ------------------------------------------------------------------------------------


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that these processors need, while a query is started."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


class Lapsing(StatefulProcessor):
    """A key's rows in order through ``step(held, row) -> (held, output)``, and its state until ``lapses(held)``, when ``left(held, now)`` is what stays of it."""

    def __init__(self, order: list[str], schema: str, start: Callable[[], list], step: Callable[[list, Any], tuple[list, Any]], lapses: Callable[[list], int | None], left: Callable[[list, int], list], columns: list[str], out: Row):
        self.order, self.schema, self.start, self.step, self.lapses, self.left, self.columns, self.out = order, schema, start, step, lapses, left, columns, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", self.schema)

    def _held(self) -> list:
        """What the key holds, if anything. Each call of the state or of a timer is a message to the JVM and back."""
        got = self.state.get()
        return [tuple(h) if isinstance(h, tuple) else h for h in got[0]] if got else []

    def _keep(self, before: list, held: list, fired: bool = False) -> None:
        """A key has one timer while it holds something, and none else; that of ``before`` tells when it is. One that has fired is dropped by Spark."""
        if held == before:
            if held and fired:
                self.handle.registerTimer(self.lapses(held) + 1)
            return
        old, new = (self.lapses(h) + 1 if h else None for h in (before, held))
        if old is not None and old != new and not fired:
            self.handle.deleteTimer(old)
        if held:
            self.state.update((held,))
            if old != new or fired:
                self.handle.registerTimer(new)
        else:
            self.state.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = self._held()
        held = before or self.start()
        out = []
        said = (dict(zip(self.columns, values, strict=True)) for pack in rows for values in zip(*(pack[c] for c in self.columns), strict=True))
        for row in sorted(said, key=itemgetter(*self.order)):
            held, answer = self.step(held, row)
            if answer is not None:
                out.append(answer)
        self._keep(before, held)
        if out:
            yield self.out(*key, *map(list, zip(*out, strict=True)))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        before = self._held()
        self._keep(before, self.left(before, expiredTimerInfo.getExpiryTimeInMs()), True)
        yield from ()

    def close(self) -> None:
        pass


def _packs(keys: list[str], columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows to one row for each key of some ``PACKED`` rows: its rows' columns as arrays, and the newest of its times."""

    def packed(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        made = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([*((c, "list") for c in columns), ("at", "max")])
        return made.select([*keys, *(f"{c}_list" for c in columns), "at_max"]).rename_columns([*keys, *columns, "_newest"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED:
                yield from packed(held)
                held = []
        if held:
            yield from packed(held)

    return run


def _run(stream: DataFrame, keys: list[str], processor: Callable[[list[str], Row], Lapsing], out: str, lateness: str) -> DataFrame:
    """A key's rows of a batch of the stream pass to its processor as few packed rows, not one by one. A pack has the time of its newest row, so that rows are dropped as late where the whole pack is."""
    columns = [c for c in stream.columns if c not in keys]
    kind = lambda c: stream.schema[c].dataType.simpleString()
    plain = ", ".join(f"{k} {kind(k)}" for k in keys)
    packed = stream.repartition(*keys).select(*keys, *columns).mapInArrow(_packs(keys, columns), f"{plain}, {', '.join(f'{c} array<{kind(c)}>' for c in columns)}, _newest {kind('at')}")
    timed = packed.withColumn("_time", F.timestamp_millis(F.col("_newest"))).drop("_newest").withWatermark("_time", lateness)
    names, kinds = zip(*(x.split() for x in out.split(", ")), strict=True)
    arrays = ", ".join(f"{n} array<{k}>" for n, k in zip(names, kinds, strict=True))
    said = timed.groupBy(*keys).transformWithState(statefulProcessor=processor(columns, Row(*keys, *names)), outputStructType=f"{plain}, {arrays}", outputMode="Append", timeMode="EventTime")
    return said.select(*keys, F.inline(F.arrays_zip(*names)))


def _admit(recent: list[int], at: int, limit: int, window_ms: int) -> tuple[list[int], bool]:
    live = [t for t in recent if t > at - window_ms]
    return (live + [at], True) if len(live) < limit else (live, False)


def rate_limit_stream(stream: DataFrame, key: str, limit: int, window_ms: int, lateness: str = "0 seconds") -> DataFrame:
    """(key, id, allowed) of a stream of (key, at, id), as ``stateful.rate_limit``: a key's state is its allowed requests of the last window, and lapses with the newest of them."""

    def step(held: list, row: dict) -> tuple[list, tuple]:
        held, ok = _admit(held, int(row["at"]), limit, window_ms)
        return held, (row["id"], ok)

    p = partial(Lapsing, ["at", "id"], "times array<long>", list, step, lambda held: max(held) + window_ms, lambda held, now: [t for t in held if t + window_ms >= now])
    return _run(stream, [key], p, "id long, allowed boolean", lateness)


def lease_stream(stream: DataFrame, key: str, cap: int = LEASES, ttl_ms: int = LEASE_MS, lateness: str = "0 seconds") -> DataFrame:
    """(key, id, allowed) of the requests in a stream of (key, at, id, released): a row with ``released`` gives the lease of that id back, before requests of the same
    time. A key's state is its live leases; the last of them to lapse takes the state with it."""

    def step(held: list, row: dict) -> tuple[list, tuple | None]:
        at = int(row["at"])
        live = [x for x in held if x[1] > at and not (row["released"] and x[0] == row["id"])]
        if row["released"]:
            return live, None
        ok = len(live) < cap
        return (live + [(int(row["id"]), at + ttl_ms)] if ok else live), (row["id"], ok)

    p = partial(Lapsing, ["at", "given_back_first", "id"], "leases array<struct<id:long,end:long>>", list, step, lambda held: max(x[1] for x in held), lambda held, now: [x for x in held if x[1] >= now])
    rows = stream.withColumn("given_back_first", F.when(F.col("released"), 0).otherwise(1))
    return _run(rows, [key], p, "id long, allowed boolean", lateness)


def _transition(held: list, at: int, status: str) -> tuple[list, str]:
    """``held``: the last accepted (status, at) of a stage of a segment, if any."""
    last, when = held[0] if held else ("idle", None)
    if when is not None and at < when:
        return held, "late"
    if status not in LEGAL.get(last, LEGAL["idle"]):
        return held, "illegal"
    return [(status, at)], "accepted"


def run_log(log: DataFrame, seq: str = "seq") -> DataFrame:
    """(segment, stage, id, verdict) of the rows (segment, stage, at, id, status) of a log, in order of arrival ``seq``: a run starts, then ends as completed, failed or skipped; what
    may not follow what was accepted last is ``illegal``, and what is older is ``late``. A key's rows pass in order; its last accepted row is all that is held."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out = []
            for segment, stage, at, status in zip(*(batch.column(c).to_pylist() for c in ("segment", "stage", "at", "status")), strict=True):
                if (segment, stage) != now:
                    now, held = (segment, stage), []
                held, verdict = _transition(held, at, status)
                out.append(verdict)
            yield pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("stage"), batch.column("id"), pa.array(out, pa.string())], names=["segment", "stage", "id", "verdict"])

    rows = log.select("segment", "stage", F.col("at").cast("long").alias("at"), F.col("id").cast("long").alias("id"), "status", seq).repartition("segment", "stage").sortWithinPartitions("segment", "stage", seq)
    return rows.mapInArrow(fold, f"segment {log.schema['segment'].dataType.simpleString()}, stage string, id long, verdict string")


def run_log_stream(stream: DataFrame, keep_ms: int = 86_400_000, lateness: str = "0 seconds") -> DataFrame:
    """The same on a stream of (segment, stage, at, id, status, seq). The state of a stage lapses ``keep_ms`` after its last accepted row; a run that never ended is dropped with it."""

    def step(held: list, row: dict) -> tuple[list, tuple]:
        held, verdict = _transition(held, int(row["at"]), row["status"])
        return held, (row["id"], verdict)

    p = partial(Lapsing, ["seq"], "runs array<struct<status:string,at:long>>", list, step, lambda held: held[0][1] + keep_ms, lambda held, now: [x for x in held if x[1] + keep_ms >= now])
    return _run(stream, ["segment", "stage"], p, "id long, verdict string", lateness)


def collected(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what there is now into files of a shared folder, and reads them."""
    spark = stream.sparkSession
    with rocksdb(spark):
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


