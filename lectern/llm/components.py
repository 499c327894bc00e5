"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps only aggregate and join on a node; a node with very many edges is a skewed join side, which
Spark splits at run time, and its minimum is combined before the shuffle. Each round is written to the
checkpoint folder, so that lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROUNDS = 60


def _toward_least(pairs: DataFrame) -> DataFrame:
    """For (u, v): each v beside the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges as stars around the least node of what they connect: fewer rounds for long chains."""
    for batch in batches:
        root: dict = {}

        def find(x, root=root):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
        stars = [(x, find(x)) for x in list(root)]
        stars = [x for x in stars if x[0] != x[1]]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in stars], batch.schema.field(k).type) for k in (0, 1)], schema=batch.schema)


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), of any orderable type; component is the least node reachable."""
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).mapInArrow(_contracted, edges.select(F.col("a").alias("u"), F.col("b").alias("v")).schema).distinct().checkpoint()
    before = None
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = _toward_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = small.checkpoint()
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
