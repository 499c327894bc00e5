"""The driver tables as stand-ins for the archive's, and the same as SQL.

A transcript is a user of ``events``: its words are the events in order, timed by ``ts`` and ``value``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ms(ts: str = "ts"):
    """Milliseconds of a timestamp without zone; the session's zone plays no part."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})").cast("long")


def words(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts")
    return e.select(
        F.col("user_id").alias("transcript"), (F.row_number().over(order) - 1).cast("long").alias("idx"), F.col("event_type").alias("text"), ms().alias("start_ms"),
        (ms() + F.floor(F.abs("value") * 1000)).cast("long").alias("end_ms"), "event_id",
    )


WORDS = """words AS (SELECT user_id AS transcript, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_type AS text,
 epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(floor(abs(value) * 1000) AS BIGINT) AS end_ms, event_id FROM events)"""
TOKENS = r"""tok AS (SELECT doc_id AS doc, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS word FROM (SELECT doc_id, regexp_extract_all(
 trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')), '[\p{L}\p{N}_]+') AS l FROM documents))"""
