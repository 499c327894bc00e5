"""Operator 12: hard negatives by bit-sliced integer products.

Components are integers, floor(256 x). A row's integers are written in two's complement and multiplied plane by
plane, the sign first: after the planes down to bit b, what is left of each component lies in [0, 2^b - 1], so the score
lies between the partial sum plus (2^b - 1) times the anchor's negative components and plus (2^b - 1) times its
positive ones. Pairs whose interval cannot qualify are dropped: for positives where it lies below the anchor's
fifth best score so far, for negatives where it misses every band of the anchor's positives or lies below the fifth
best in each. Planes are products of whole blocks while many pairs remain, and of single pairs after that.

Anchors are taken in chunks of ``CHUNK_BYTES``, which are broadcast (a bound by construction); the rows are never
shuffled: every task passes its own rows by all anchors of the chunk and sends at most five rows for each
anchor, or anchor and positive. So a label that holds a third of all rows is no hot group. Two
passes a chunk: the five best positives, which are the chunk's bands, then the negatives in them.

Defined results: rows with a null ``vec_id``, label or vector, or a null or non-finite component, take no part; shorter
vectors end in zeros, an empty vector is all zeros; repeated rows count as often as they occur, rows of the
anchor's own ``vec_id`` are not its positives; scores beyond 64 bits are held at the ends of that range; an empty
table, or one without anchors, gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import checkpoints

#: Bytes of a chunk of anchors, as eight-byte integers.
CHUNK_BYTES = 8 << 20
#: Anchors and rows of a block.
ANCHORS = 512
ROWS = 2048
#: Below this share of pairs, planes are multiplied pair by pair.
FEW = 1 / 16
#: Bounds are not looked at while an interval is this many times as wide as scores spread.
WIDE = 3
BEST = 5

_LONG = (-(1 << 63), (1 << 63) - 1)
_FOUND = "anchor long, anchor_id long, place int, positive_id long, positive_score long, id long, score long"


@dataclass
class Anchors:
    """A chunk of anchors and, in the second pass, the bands of scores of their positives (empty: low above high)."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    positive: np.ndarray | None = None
    score: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def integers(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their floor(256 x) as float64 of ``width`` components) of a list column without null lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = column.flatten()
    ok = np.asarray(flat.is_valid().to_numpy(zero_copy_only=False))
    x = np.where(ok, np.asarray(flat.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.float64), np.nan)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(256 * x)
    bad = np.zeros(len(size), dtype=bool)
    bad[np.repeat(np.arange(len(size)), size)[~np.isfinite(x)]] = True
    width = int(size.max(initial=0)) if width is None else width
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    keep = (at < width) & ~bad[row]
    out[row[keep], at[keep]] = x[keep]
    return np.flatnonzero(~bad), out[~bad]


def interval_products(a: np.ndarray, c: np.ndarray, alive: Callable[[np.ndarray, np.ndarray], np.ndarray], still: Callable[..., np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``c``, exact product) of the pairs that are never ruled out.

    ``alive(low, high)`` judges the whole block by its bounds, ``still(i, j, low, high)`` single pairs.
    """
    bits = max(1, int(max(c.max(initial=0), -c.min(initial=0) - 1)).bit_length())
    whole = c.astype(np.int64)
    plus, minus = np.maximum(a, 0).sum(axis=1), np.minimum(a, 0).sum(axis=1)
    total = a @ (-float(1 << bits) * (whole < 0)).T
    pairs = None
    for b in range(bits - 1, -1, -1):
        plane = (whole >> b & 1).astype(np.float64)
        rest = float((1 << b) - 1)
        if pairs is None:
            total += float(1 << b) * (a @ plane.T)
            if b and rest * (plus - minus).mean() > WIDE * total[:, :64].std():
                continue
            mask = alive(total + (rest * minus)[:, None], total + (rest * plus)[:, None])
            if b == 0 or np.count_nonzero(mask) <= FEW * mask.size:
                i, j = np.nonzero(mask)
                pairs = i, j, total[i, j]
        else:
            i, j, s = pairs
            s = s + float(1 << b) * np.einsum("nd,nd->n", a[i], plane[j])
            keep = still(i, j, s + rest * minus[i], s + rest * plus[i])
            pairs = i[keep], j[keep], s[keep]
    return pairs


def exact_products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All products, for components that do not fit 53 bits."""
    whole = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape)
    s = whole(a) @ whole(c).T if a.shape[1] else np.zeros((len(a), len(c)), dtype=object)
    return np.clip(s, *_LONG)


class Best:
    """The best rows of each key so far: highest score, then smallest id."""

    def __init__(self, keys: int):
        self.keys = keys
        self.key, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.least = np.full(keys, -np.inf)

    def add(self, key: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        key, score, id_ = np.append(self.key, key), np.append(self.score, score.astype(np.int64)), np.append(self.id, id_)
        order = np.lexsort((id_, ~score, key))  # ~s falls as s rises, without overflow
        key, score, id_ = key[order], score[order], id_[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        keep = place < BEST
        self.key, self.score, self.id = key[keep], score[keep], id_[keep]
        full = place == BEST - 1
        self.least[key[full]] = score[full]


def _blocks(chunk: Anchors, ids: np.ndarray, labels: np.ndarray, c: np.ndarray) -> Iterator[tuple]:
    for x in range(0, len(chunk.ids), ANCHORS):
        a = chunk.values[x : x + ANCHORS]
        for y in range(0, len(ids), ROWS):
            yield slice(x, x + ANCHORS), a, ids[y : y + ROWS], labels[y : y + ROWS], c[y : y + ROWS]


def _pairs(a: np.ndarray, c: np.ndarray, fits: np.ndarray, block: Callable, single: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates with exact scores; rows whose scores may pass 53 bits go the long way."""
    large = np.abs(c).max(axis=1, initial=0) * np.abs(a).sum(axis=1).max(initial=0) >= 1 << 52
    if not large.all():
        at = np.flatnonzero(~large)
        mask = fits[:, at]
        i, j, s = interval_products(a, c[at], lambda lo, hi: mask & block(lo, hi), single)
        yield i, at[j], s
    if large.any():
        at = np.flatnonzero(large)
        i, j = np.nonzero(fits[:, at])
        yield i, at[j], exact_products(a, c[at])[i, j]


def positives(chunk: Anchors, best: Best, ids: np.ndarray, labels: np.ndarray, c: np.ndarray) -> None:
    for at, a, id_, label, part in _blocks(chunk, ids, labels, c):
        fits = (chunk.labels[at][:, None] == label) & (chunk.ids[at][:, None] != id_)
        least = best.least[at]

        def block(low: np.ndarray, high: np.ndarray, fits=fits, least=least) -> np.ndarray:
            new = np.flatnonzero(np.isinf(least))
            bound = least.copy()
            if len(new) and low.shape[1] == fits.shape[1] and low.shape[1] >= BEST:
                bound[new] = np.partition(np.where(fits[new], low[new], -np.inf), -BEST, axis=1)[:, -BEST]
            return high >= bound[:, None]

        for i, j, s in _pairs(a, part, fits, block, lambda i, j, low, high, least=least: high >= least[i]):
            best.add(i + at.start, s, id_[j])


def negatives(chunk: Anchors, best: Best, ids: np.ndarray, labels: np.ndarray, c: np.ndarray) -> None:
    """Keys are anchor * BEST + place of the positive."""
    for at, a, id_, label, part in _blocks(chunk, ids, labels, c):
        fits = chunk.labels[at][:, None] != label
        low_of, high_of = np.maximum(chunk.low[at], best.least.reshape(-1, BEST)[at]), chunk.high[at]
        open_ = low_of <= high_of
        lowest = np.where(open_, low_of, np.inf).min(axis=1)
        highest = np.where(open_, high_of, -np.inf).max(axis=1)
        inside = lambda i, low, high, lo=low_of, hi=high_of: (high[:, None] >= lo[i]) & (low[:, None] <= hi[i])
        block = lambda low, high, lo=lowest, hi=highest: (high >= lo[:, None]) & (low <= hi[:, None])
        for i, j, s in _pairs(a, part, fits, block, lambda i, j, low, high, inside=inside: inside(i, low, high).any(axis=1)):
            if not len(s):
                continue
            score = s.astype(np.int64)
            pair, place = np.nonzero((score[:, None] >= chunk.low[at][i]) & (score[:, None] <= chunk.high[at][i]))
            best.add((i[pair] + at.start) * BEST + place, score[pair], id_[j[pair]])


def _pass(table: DataFrame, shared: Broadcast, fill: Callable, places: int) -> DataFrame:
    """The best rows of each task for each anchor (and positive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: Anchors = shared.value
        best = Best(len(chunk.ids) * places)
        for batch in batches:
            rows, c = integers(batch.column(2), chunk.values.shape[1])
            fill(chunk, best, batch.column(0).to_numpy()[rows], batch.column(1).to_numpy()[rows], c)
        anchor, place = best.key // places, best.key % places
        bands = [np.zeros(len(anchor), dtype=np.int64)] * 2 if chunk.positive is None else [chunk.positive[anchor, place], chunk.score[anchor, place]]
        columns = [anchor, chunk.ids[anchor], place.astype(np.int32), *bands, best.id, best.score]
        names = [f.split()[0] for f in _FOUND.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    found = table.mapInArrow(run, _FOUND)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)


def _with_bands(chunk: Anchors, found: list) -> Anchors:
    """The chunk with its positives, given as rows (anchor, id, score, rank)."""
    n = len(chunk.ids)
    positive, score = np.zeros((2, n, BEST), dtype=np.int64)
    low, high = np.ones((n, BEST), dtype=np.int64), np.zeros((n, BEST), dtype=np.int64)
    for anchor, id_, s, rank in found:
        positive[anchor, rank - 1], score[anchor, rank - 1] = id_, s
        low[anchor, rank - 1], high[anchor, rank - 1] = -(-80 * s // 100), s
    return Anchors(chunk.ids, chunk.labels, chunk.values, positive, score, low, high)


def hard_negatives(table: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = table.sparkSession
    id_, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    rows = table.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(id_.alias("vec_id"), F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding")
    anchors = rows.where("vec_id % 100 = 0")
    count, width = anchors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    chunks = max(1, -(-count * max(1, width) * 8 // CHUNK_BYTES))
    if chunks > 1:
        checkpoints.ensure(spark)
        anchors = anchors.repartition(chunks).checkpoint()
    out = []
    for k in range(chunks):
        taken = (anchors.where(F.spark_partition_id() == k) if chunks > 1 else anchors).toArrow()
        at, values = integers(taken.column(2), int(width))
        chunk = Anchors(taken.column(0).to_numpy()[at], taken.column(1).to_numpy()[at], values)
        best = _pass(rows, spark.sparkContext.broadcast(chunk), positives, 1).select("anchor", "id", "score", "rank").collect()
        found = _pass(rows, spark.sparkContext.broadcast(_with_bands(chunk, best)), negatives, BEST)
        result = found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.append(result.checkpoint() if chunks > 1 else result)
    union = out[0]
    for more in out[1:]:
        union = union.unionByName(more)
    return union


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same rows in DuckDB, by all products of anchors and rows.
SQL = """
WITH taken AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM taken a, taken r WHERE a.vec_id % 100 = 0 AND (a.label <> r.label OR a.vec_id <> r.vec_id)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INT AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
)
SELECT * FROM ranked WHERE rank <= 5
"""
