"""Streams read from files with availableNow, against their batch twins."""

from pyspark.sql import functions as F

from lectern.streaming import stateful


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.sparkSession.table(name) if hasattr(q, "sparkSession") else None


def stream_of(spark, df, path):
    df.coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = [("a", t, i) for i, t in enumerate([0, 10, 20, 30, 1000, 1005, 1011, 1012])] + [("b", 5, 100)]
    df = spark.createDataFrame(rows, "ip string, at long, id long")
    batch = sorted(map(tuple, stateful.rate_limit(df, "ip", 2, 1000).collect()))
    run(stateful.rate_limit_stream(stream_of(spark, df, tmp_path / "r"), "ip", 2, 1000), "rate_out")
    assert sorted(map(tuple, spark.table("rate_out").collect())) == batch
    assert [x[2] for x in batch if x[0] == "a"] == [True, True, False, False, True, False, True, False]


def test_leases(spark):
    df = spark.createDataFrame([("k", t * 1000, t) for t in (0, 1, 2, 3, 90, 91)], "k string, at long, id long")
    assert [r["allowed"] for r in sorted(stateful.leases(df, "k").collect(), key=lambda r: r["id"])] == [True, True, True, False, True, True]


def test_released_leases_make_room(spark):
    rows = [("k", 0, 0, 1500), ("k", 1000, 1, None), ("k", 2000, 2, None), ("k", 3000, 3, 9_000), ("k", 4000, 4, None), ("k", 9000, 5, None), ("j", 4000, 6, None)]
    df = spark.createDataFrame(rows, "k string, at long, id long, released_at long")
    assert [r["allowed"] for r in sorted(stateful.leases(df, "k").collect(), key=lambda r: r["id"])] == [True, True, True, True, False, True, True]


def test_daily_spend_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(f"2024-01-0{d} 0{h}:00:00", 0.0000019 * h) for d in (1, 2, 9) for h in (1, 2, 3)], "ts string, cost double").select(F.col("ts").cast("timestamp").alias("ts"), "cost")
    batch = dict(map(tuple, df.groupBy(F.to_date("ts")).agg(F.sum(F.floor(F.col("cost") * 1_000_000).cast("long"))).collect()))
    run(stateful.spend_by_day(stream_of(spark, df, tmp_path / "s"), "ts", F.col("cost")), "spend_out", "complete")
    assert dict(map(tuple, spark.table("spend_out").collect())) == batch


def test_answer_cache(spark, tmp_path):
    df = spark.createDataFrame([("q", "2024-01-01 00:00:00"), ("q", "2024-01-02 00:00:00"), ("z", "2024-01-02 00:00:00"), ("q", "2024-01-20 00:00:00")], "k string, ts string").select("k", F.col("ts").cast("timestamp").alias("ts"))
    assert stateful.cached_answers(df, "k", "ts").count() == 3
    run(stateful.cached_answers(stream_of(spark, df.where("ts < '2024-01-10'"), tmp_path / "c"), "k", "ts"), "cache_out")
    assert sorted(r["k"] for r in spark.table("cache_out").collect()) == ["q", "z"]


def test_cached_answers_expire_from_the_day_they_were_written(spark):
    days = lambda *d: [("q", f"2024-01-{x:02d} 00:00:00") for x in d]
    df = spark.createDataFrame(days(1, 6, 11, 13, 18, 25) + [("z", "2024-01-06 00:00:00")], "k string, ts string").select("k", F.col("ts").cast("timestamp").alias("ts"))
    got = sorted((r["k"], r["ts"].day) for r in stateful.cached_answers(df, "k", "ts").collect())
    assert got == [("q", 1), ("q", 11), ("q", 18), ("q", 25), ("z", 6)]


def test_latest_status(spark):
    df = spark.createDataFrame([(1, 1, "pending"), (1, 3, "indexed"), (1, 2, "aligned")], "segment int, t int, status string")
    assert stateful.latest_status(df, "segment", ["t"], "status").first()["status"] == "indexed"
