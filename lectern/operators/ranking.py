"""Places in a total order, without one window over all rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[Column | str], place: str, total: str) -> DataFrame:
    """Each row's place from 1 and the number of rows.

    Rows are range-partitioned and sorted; the partitions' sizes (one row each, so they are broadcast) give each one's
    first place. Both uses must see the same partitions, but range bounds come from a sample that each plan draws anew, so
    the sorted rows are persisted (on disk); lost blocks are made again with the bounds once drawn.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_m0"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", "_m0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    got = rows.join(F.broadcast(starts), "_p")
    return got.withColumn(place, F.col("_m") - F.col("_m0") + F.col("_at") + 1).withColumn(total, F.col("_all")).drop("_p", "_m", "_m0", "_at", "_all")
