"""Streams in several batches against their batch twins, and their state after the window."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.streaming import lapsing, stateful


def stream_of(spark, rows, schema, path, parts):
    """A stream that gets the rows in ``parts`` batches, in order."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(path))
    files = sorted(path.glob("*.parquet"), key=lambda p: p.stat().st_mtime)
    for k, p in enumerate(files):
        import os

        os.utime(p, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(spark, stream, tmp_path):
    """(rows, rows of state at the end)."""
    got = lapsing.collected(stream, str(tmp_path / "run")).collect()
    with lapsing.rocksdb(spark):
        state = spark.read.format("statestore").option("path", str(tmp_path / "run" / "state")).option("stateVarName", "held").load().count()
    return sorted(map(tuple, got), key=str), state


def test_rate_limit(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted((rng.choice("abc"), rng.randrange(8000), k) for k in range(120))
    rows = [(k, at, i) for i, (at, k) in enumerate(sorted((at, k) for k, at, _ in rows))]
    schema = "ip string, at long, id long"
    late = [("z", 1_000_000, 1000), ("z", 2_000_000, 1001)]
    got, state = run(spark, lapsing.rate_limit_stream(stream_of(spark, rows + late, schema, tmp_path / "in", 6), "ip", 3, 500), tmp_path)
    assert got == sorted(map(tuple, stateful.rate_limit(spark.createDataFrame(rows + late, schema), "ip", 3, 500).collect()), key=str)
    assert state <= 1  # of four keys those whose window is over are gone


def test_leases_with_releases(spark, tmp_path):
    rng = random.Random(2)
    asked = [(rng.choice("ab"), at, i) for i, at in enumerate(sorted(rng.randrange(60_000) for _ in range(60)))]
    released = {i: at + rng.choice([1, 500, 3000]) for _, at, i in asked if i % 3}
    batch = spark.createDataFrame([(k, at, i, released.get(i)) for k, at, i in asked], "k string, at long, id long, released_at long")
    want = sorted(map(tuple, stateful.leases(batch, "k", 2, 4000).collect()), key=str)
    events = sorted([(at, 1, i, k, False) for k, at, i in asked] + [(released[i], 0, i, k, True) for k, _, i in asked if i in released])
    rows = [(k, at, i, r) for at, _, i, k, r in events] + [("z", 10_000_000, 999, False), ("z", 20_000_000, 998, False)]
    got, state = run(spark, lapsing.lease_stream(stream_of(spark, rows, "k string, at long, id long, released boolean", tmp_path / "in", 5), "k", 2, 4000, "1 second"), tmp_path)
    assert [g for g in got if g[0] != "z"] == want
    assert state <= 1


def log(rng, n):
    rows = []
    for i in range(n):
        rows.append((rng.randrange(6), rng.choice(["align", "index"]), 1000 + i * 10 - rng.choice([0, 0, 0, 35]), i, rng.choice(["running", "completed", "failed", "skipped", "running", "unheard"]), i))
    return rows


def test_run_log(spark, tmp_path):
    rows = log(random.Random(3), 200) + [(99, "align", 10**9, 900, "running", 900), (98, "align", 2 * 10**9, 901, "running", 901)]
    schema = "segment long, stage string, at long, id long, status string, seq long"
    held, want = {}, []
    for segment, stage, at, id_, status, _ in rows:
        last, when = held.get((segment, stage), (None, None))
        busy = last == "running"
        verdict = "late" if when is not None and at < when else "accepted" if status in (("completed", "failed", "skipped") if busy else ("running", "failed")) else "illegal"
        if verdict == "accepted":
            held[segment, stage] = (status, at)
        want.append((segment, stage, id_, verdict))
    assert {w[3] for w in want} == {"late", "accepted", "illegal"}
    assert sorted(map(tuple, lapsing.run_log(spark.createDataFrame(rows, schema).repartition(3)).collect())) == sorted(want)
    got, state = run(spark, lapsing.run_log_stream(stream_of(spark, rows, schema, tmp_path / "in", 4), 100_000, "1 minute"), tmp_path)
    assert sorted(got) == sorted(want)
    assert state <= 2


def test_state_store_setting_is_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with pytest.raises(RuntimeError), lapsing.rocksdb(spark):
        assert spark.conf.get(name) == lapsing.STORE
        raise RuntimeError
    assert spark.conf.get(name, None) == before


def test_timestamps_are_milliseconds(spark):
    assert spark.range(1).select(F.timestamp_millis(F.lit(1500)).cast("double").alias("t")).first()["t"] == 1.5


def test_rows_are_packed_by_key(spark, monkeypatch):
    """A processor is sent a key's rows of a batch as few arrays; each row is in one of them."""
    monkeypatch.setattr(lapsing, "PACKED", 250)
    rows = [(i % 3 if i % 7 else None, 1000 + i, i, f"s{i}" if i % 5 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, at long, id long, status string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = df.mapInArrow(lapsing._packs(["k"], ["at", "id", "status"]), "k long, at array<long>, id array<long>, status array<string>, _newest long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 8  # four keys, 300 rows and 300
    assert sorted(((r["k"], *x) for r in got for x in zip(r["at"], r["id"], r["status"], strict=True)), key=str) == sorted(rows, key=str)
    assert all(r["_newest"] == max(r["at"]) for r in got)
