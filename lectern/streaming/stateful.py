"""Event-time and stateful operators, each with a batch twin of the same result."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------
LEASE_MS, LEASES = 90_000, 3
# ------------------------------------------------------------------------------------


def spend_by_day(stream: DataFrame, ts: str, cost: Column, lateness: str = "48 hours") -> DataFrame:
    """Micro-units per UTC day; days close once the watermark passes."""
    micros = F.floor(cost * 1_000_000).cast("long").alias("micros")
    return stream.select(F.col(ts), micros).withWatermark(ts, lateness).groupBy(F.window(ts, "1 day")).agg(F.sum("micros").alias("micros")).select(F.to_date("window.start").alias("day"), "micros")


def _allowed(times: list[int], recent: list[int], limit: int, window_ms: int) -> tuple[list[bool], list[int]]:
    out = []
    for t in times:
        recent = [r for r in recent if r > t - window_ms]
        ok = len(recent) < limit
        if ok:
            recent.append(t)
        out.append(ok)
    return out, recent


def rate_limit(events: DataFrame, key: str, limit: int, window_ms: int) -> DataFrame:
    """(key, at, id) with ``allowed``: a sliding log of allowed requests only. A key's rows pass in order, and its log, ``limit`` times at most, is all that is held."""
    rows = events.select(key, F.col("at").cast("long").alias("at"), F.col("id").cast("long").alias("id")).repartition(key).sortWithinPartitions(key, "at", "id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, recent = object(), []
        for batch in batches:
            out = []
            for k, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now, recent = (now, recent) if k == now else (k, [])
                ok, recent = _allowed([at], recent, limit, window_ms)
                out += ok
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.bool_())], names=[key, "id", "allowed"])

    return rows.mapInArrow(fold, f"{key} {events.schema[key].dataType.simpleString()}, id long, allowed boolean")


def rate_limit_stream(stream: DataFrame, key: str, limit: int, window_ms: int) -> DataFrame:
    """The same on a stream of (key, at, id): the log of a key is its state, and lapses with the window."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        ok, recent = _allowed(rows["at"].tolist(), recent, limit, window_ms)
        state.update((recent,))
        yield pd.DataFrame({key: [k[0]] * len(rows), "id": rows["id"].to_numpy(), "allowed": ok})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, id long, allowed boolean", "recent array<long>", "append", "NoTimeout")


def leases(events: DataFrame, key: str, cap: int = LEASES, ttl_ms: int = LEASE_MS) -> DataFrame:
    """Requests (key, at, id[, released_at]) admitted while the key has fewer than ``cap`` leases. An admitted request holds its lease until it is
    released, and for ``ttl_ms`` at most. A key's rows pass in order; only its live leases are held."""
    released = F.col("released_at") if "released_at" in events.columns else F.lit(None).cast("long")
    lapses = F.col("at") + F.lit(ttl_ms)
    ends = F.when(released.isNull(), lapses).otherwise(F.least(lapses, F.greatest(released, F.col("at"))))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, live = object(), []
        for batch in batches:
            ok = []
            for k, at, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                now, live = (now, [e for e in live if e > at]) if k == now else (k, [])
                ok.append(len(live) < cap)
                if ok[-1]:
                    live.append(end)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ok, pa.bool_())], names=[key, "id", "allowed"])

    rows = events.select(key, F.col("at").cast("long").alias("at"), F.col("id").cast("long").alias("id"), ends.alias("_end")).repartition(key).sortWithinPartitions(key, "at", "id")
    return rows.mapInArrow(fold, f"{key} {events.schema[key].dataType.simpleString()}, id long, allowed boolean")


def latest_status(log: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    return log.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status), F.count("*").alias("n"))


def cached_answers(requests: DataFrame, key: str, ts: str, ttl: str = "7 days") -> DataFrame:
    """Requests that no cached answer serves: the first of each key, and each that comes when the answer written last has expired. On a stream, the
    first of each key within the time to live. In a batch a key's requests pass in order and only the last answer's time is held."""
    if requests.isStreaming:
        return requests.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])
    columns = requests.columns
    rows = requests.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_end", F.unix_micros(F.col(ts).cast("timestamp") + F.expr(f"INTERVAL {ttl}")))
    rows = rows.repartition(key).sortWithinPartitions(key, "_t", *(c for c in columns if c not in (key, ts)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, end = object(), 0
        for batch in batches:
            at, miss = batch.schema.names.index(key), []
            for k, t, expires in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist(), strict=True):
                miss.append(k != now or t >= end)
                if miss[-1]:
                    now, end = k, expires
            yield batch.select(columns).filter(pa.array(miss, pa.bool_()))

    return rows.mapInArrow(fold, requests.schema)
