"""Nearest passages by cosine, from vectors stored in cells, under a filter and a model tag.

``create`` groups the unit vectors of each model around centroids (k-means over a bounded sample; every row is put into
its cell) and writes them as ``cells/model=…/cell=…``, with the columns that filters ask for. A question is compared with the
cells nearest to it, exactly. How many that takes is measured when the index is made: for ``AUDITED`` of its rows the true
neighbours down to a depth are found, and the cells that hold ``SHARE`` of them are counted. A filter that keeps one row in f
makes the k-th match lie at depth k / f, so the depth grows with it; beyond what was measured all cells are
read, which then are few rows, as the filter goes down to the scan. Where a filter leaves fewer than k rows in the cells
read, twice as many are read, until k are found or no cell is left. Then the result is made exact: with the greatest angle
between a cell's rows and its centroid, which is stored too, the nearest that a cell can hold is bounded, and the cells
not read yet that can hold one as near as the k-th are read in one more pass.

Questions are broadcast in chunks of ``CHUNK_BYTES``; vectors are never shuffled, each task sends its best k for each question.
Rows with a null, zero or non-finite vector, or of another length than their model's first, are in no cell.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

CELLS, SAMPLE, STEPS = 64, 20_000, 12
AUDITED, DEPTHS, SHARE = 64, (10, 100, 1000), 0.98
CHUNK_BYTES = 8 << 20
#: Products that a task holds at once.
TILE = 1 << 20
#: Models of one index.
MOST_MODELS = 256


def units(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a usable vector of that length, their unit vectors) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dims)
    flat = column.take(pa.array(at)).flatten()
    x = np.where(flat.is_valid().to_numpy(zero_copy_only=False), flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), np.nan).reshape(len(at), dims)
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    good = np.isfinite(x).all(axis=1) & (dims > 0)
    return at[good], x[good]


def centroids_of(x: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Spherical k-means; centroids that lose all their rows stay where they were."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:cells]]
    for _ in range(STEPS):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(length > 0, total / np.maximum(length, 1e-12), c)
    return c


def _first(own: np.ndarray, distance: np.ndarray, id_: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each question."""
    order = np.lexsort((id_, distance, own))
    place = np.arange(len(order)) - np.searchsorted(own[order], own[order])
    return order[place < k]


@dataclass
class VectorCells:
    """The index in a folder that all executors share; ids are longs."""

    spark: SparkSession
    path: str
    models: dict[str, dict]

    @classmethod
    def create(cls, rows: DataFrame, id_: str, vector: str, model: str, path: str, keep: tuple[str, ...] = (), cells: int = CELLS) -> VectorCells:
        spark = rows.sparkSession
        named = rows.where(F.col(vector).isNotNull() & F.col(model).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("vector"), F.col(model).cast("string").alias("model"), *keep)
        models: dict[str, dict] = {}
        tags = [r["model"] for r in named.select("model").distinct().orderBy("model").limit(MOST_MODELS + 1).collect()]
        if len(tags) > MOST_MODELS:
            raise ValueError(f"more than {MOST_MODELS} models")
        for tag in tags:
            own = named.where(F.col("model") == tag).where(F.size("vector") > 0)
            # the rows least by a hash: a bounded sample that does not depend on their order
            sample = own.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
            dims = len(sample.column(1)[0]) if len(sample) else 0
            _, x = units(sample.column(1), dims) if dims else (None, np.zeros((0, 0)))
            if len(x):
                models[tag] = {"dims": dims, "centroids": centroids_of(x, cells).tolist(), "audit": x[:AUDITED].tolist()}
        shared = spark.sparkContext.broadcast({t: (m["dims"], np.array(m["centroids"])) for t, m in models.items()})
        schema = StructType([*named.schema.fields, StructField("cell", IntegerType())])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tag = np.array(batch.column(2).to_pylist(), dtype=object)
                for t in set(tag) & set(shared.value):
                    mine = np.flatnonzero(tag == t)
                    dims, c = shared.value[t]
                    part = batch.take(pa.array(mine))
                    at, x = units(part.column(1), dims)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([*part.take(pa.array(at)).columns, pa.array((x @ c.T).argmax(axis=1).astype(np.int32))], names=[*batch.schema.names, "cell"])

        dealt = named.mapInArrow(assign, schema).repartitionByRange("model", "cell", "id").sortWithinPartitions("model", "cell", "id")
        dealt.write.partitionBy("model", "cell").parquet(f"{path}/cells")
        index = cls(spark, path, {})
        for t, m in models.items():
            index.models[t] = {"dims": m["dims"], "centroids": m["centroids"], "rows": 0, "probes": {}}
            index.models[t]["radius"] = index._radii(t)
            index.models[t] |= index._audited(t, np.array(m.pop("audit")))
        spark.createDataFrame([(json.dumps(index.models),)], "value string").coalesce(1).write.text(f"{path}/about")
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorCells:
        return cls(spark, path, json.loads(spark.read.text(f"{path}/about").first()["value"]))

    def stored(self, model: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", False).parquet(f"{self.path}/cells").where(F.col("model").cast("string") == model)

    def _radii(self, model: str) -> list[float]:
        """For each cell the greatest angle between one of its rows and its centroid."""
        dims, centroids = self.models[model]["dims"], np.array(self.models[model]["centroids"])
        shared = self.spark.sparkContext.broadcast(centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wide = np.zeros(len(shared.value))
            for batch in batches:
                at, v = units(batch.column(0), dims)
                cell = batch.column(1).to_numpy()[at]
                np.maximum.at(wide, cell, np.arccos(np.clip((v * shared.value[cell]).sum(axis=1), -1, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(wide))), pa.array(wide)], ["cell", "angle"])

        rows = self.stored(model).select("vector", "cell").mapInArrow(run, "cell long, angle double").groupBy("cell").agg(F.max("angle").alias("angle")).collect()
        found = {r["cell"]: r["angle"] for r in rows}
        return [found.get(c, 0.0) for c in range(len(centroids))]

    def _audited(self, model: str, x: np.ndarray) -> dict:
        """Rows of the model, and for each depth the cells that hold ``SHARE`` of the audited rows' neighbours down to it."""
        rows = self.stored(model).count()
        rank = self._ranks(model, x)
        depth = min(DEPTHS[-1], max(1, rows // 4))
        found = self._scan(model, x, np.ones((len(x), len(self.models[model]["centroids"])), dtype=bool), depth, None)
        probes = {}
        for d in (d for d in DEPTHS if d <= depth):
            at = sorted(rank[q, cell] + 1 for q, best in found.items() for _, _, cell in best[:d])
            probes[d] = int(at[min(len(at) - 1, int(np.ceil(SHARE * len(at))) - 1)])
        return {"rows": rows, "probes": probes}

    def _ranks(self, model: str, x: np.ndarray) -> np.ndarray:
        """For each question the places of the cells by nearness."""
        order = np.argsort(-(x @ np.array(self.models[model]["centroids"]).T), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :].repeat(len(x), axis=0), axis=1)
        return rank

    def _scan(self, model: str, x: np.ndarray, asked: np.ndarray, k: int, condition: Column | None, most: np.ndarray | None = None) -> dict[int, list[tuple[float, int, int]]]:
        """For each question its best k of (distance, id, cell) over the cells it asks, none beyond its distance in ``most``; k for each of a bounded chunk of questions."""
        shared = self.spark.sparkContext.broadcast((x, asked, np.full(len(x), np.inf) if most is None else most))
        dims = self.models[model]["dims"]
        rows = self.stored(model).where(F.col("cell").isin(np.flatnonzero(asked.any(axis=0)).tolist()))
        rows = rows if condition is None else rows.where(condition)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, ask, far_most = shared.value
            held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
            for batch in batches:
                at, v = units(batch.column(1), dims)
                id_, cell = batch.column(0).to_numpy()[at], batch.column(2).to_numpy()[at]
                for c in np.unique(cell):
                    mine, who = np.flatnonzero(cell == c), np.flatnonzero(ask[:, c])
                    new = [held[0][:0], held[1][:0], held[2][:0], held[3][:0]]
                    for some in np.array_split(who, -(-len(who) * len(mine) // TILE)):
                        far = np.round(1 - q[some] @ v[mine].T, 6) + 0.0  # no negative zero
                        cut = far_most[some]
                        if len(mine) > k:
                            cut = np.minimum(cut, np.partition(far, k - 1, axis=1)[:, k - 1])
                        own, near = np.nonzero(far <= cut[:, None])
                        new = [np.append(a, b) for a, b in zip(new, [some[own], far[own, near], id_[mine[near]], np.full(len(own), c, np.int64)], strict=True)]
                    held = [np.append(a, b) for a, b in zip(held, new, strict=True)]
                    best = _first(held[0], held[1], held[2], k)
                    held = [a[best] for a in held]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in held], ["q", "distance", "id", "cell"])

        order = Window.partitionBy("q").orderBy("distance", "id")
        best = rows.select("id", "vector", "cell").mapInArrow(run, "q long, distance double, id long, cell long").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        out: dict[int, list[tuple[float, int, int]]] = {i: [] for i in range(len(x))}
        for r in best.collect():
            out[r["q"]].append((r["distance"], r["id"], r["cell"]))
        return {i: sorted(v) for i, v in out.items()}

    def _probes(self, model: str, k: int, condition: Column | None) -> int:
        about = self.models[model]
        kept = about["rows"] if condition is None else self.stored(model).where(condition).count()
        depth = k * about["rows"] / max(kept, 1)
        fit = [p for d, p in sorted((int(d), p) for d, p in about["probes"].items()) if d >= depth]
        return fit[0] if fit else len(about["centroids"])

    def nearest(self, questions: DataFrame, question: str, vector: str, model: str, k: int = 50, condition: Column | None = None) -> DataFrame:
        """(question, id, distance, place) of the k nearest rows of the model that pass the condition; questions without a usable vector have none."""
        schema = f"question {questions.schema[question].dataType.simpleString()}, id long, distance double, place int"
        if model not in self.models:
            return self.spark.createDataFrame([], schema)
        dims = self.models[model]["dims"]
        asked = questions.where(F.size(vector) == dims).select(F.col(question).alias("question"), vector)
        chunks = max(1, -(-asked.count() * dims * 8 // CHUNK_BYTES))
        if chunks > 1:
            asked = asked.repartition(chunks).checkpoint()
        probes, out = self._probes(model, k, condition), []
        for c in range(chunks):
            taken = (asked.where(F.spark_partition_id() == c) if chunks > 1 else asked).toArrow()
            at, x = units(taken.column(1), dims)
            names = [taken.column(0)[int(i)].as_py() for i in at]
            result = self.spark.createDataFrame([(names[i], id_, d, p + 1) for i, best in self._widening(model, x, k, probes, condition).items() for p, (d, id_, _) in enumerate(best)], schema)
            out.append(result.checkpoint() if chunks > 1 else result)
        union = out[0]
        for more in out[1:]:
            union = union.unionByName(more)
        return union

    def _widening(self, model: str, x: np.ndarray, k: int, probes: int, condition: Column | None) -> dict[int, list]:
        best: dict[int, list] = {i: [] for i in range(len(x))}
        if not len(x):
            return best
        rank, cells, low = self._ranks(model, x), len(self.models[model]["centroids"]), 0
        read = np.zeros((len(x), cells), dtype=bool)
        while low < cells and (open_ := [i for i, b in best.items() if len(b) < k]):
            wide = np.zeros((len(x), cells), dtype=bool)
            wide[open_] = (rank[open_] >= low) & (rank[open_] < probes)
            for i, more in self._scan(model, x, wide, k, condition).items():
                best[i] = sorted([*best[i], *more])[:k]
            read |= wide
            low, probes = probes, 2 * probes
        most = np.array([best[i][-1][0] if len(best[i]) == k else np.inf for i in range(len(x))])
        angle = np.arccos(np.clip(x @ np.array(self.models[model]["centroids"]).T, -1, 1))
        least = 1 - np.cos(np.clip(angle - np.array(self.models[model].get("radius", [np.pi] * cells)), 0, None))
        wide = ~read & (least - 2e-6 <= most[:, None])  # distances are rounded to six digits
        if wide.any():
            for i, more in self._scan(model, x, wide, k, condition, most).items():
                best[i] = sorted([*best[i], *more])[:k]
        return best
