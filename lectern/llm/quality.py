"""Operator 2: quality scores from random-indexing word vectors and a two-layer network.

*Words.* A token is a run of letters, digits and other word bytes, or a run of punctuation, case kept. The ``vocabulary`` most
frequent tokens of all documents are words of their own (all of a count go in or none, so that it is at most that many); each of the
rest has one of ``SHARED`` vectors by its hash, together with others.

*Vectors.* Each word has a sparse ternary index vector, fixed by its hash; its context vector is the sum of the index vectors of the tokens up
to ``WINDOW`` places away, over all documents, less what the mean token has around it, and normalised. Each task sums into one table and
sends it once, packed by bytes. A document is pooled to three means over its tokens: of the vectors, of their squares, and of the
products with the vector of the token before (how alike neighbours are, by component). There are no other inputs.

*Network.* tanh layer, then a logistic unit, trained in numpy by Adam from labelled rows outside the held-out
fold; at most ``most_labels`` of them, those least by hash of doc_id. A sixth of these is kept back to
choose the temperature by which the logits are divided.

Labels, language, source and doc_id are no inputs of a score. Defined results: a null text counts as
empty; an empty text has the zero vector and the score that the network gives it; a null ``doc_id`` stays
null, is not held out and has no label; rows repeated in labels count once each (of different labels for a
document the least counts, null labels none); repeated documents each give a row; with no labels of both
kinds every score is the share of label 1 (0.5 without any); equal texts have equal scores; a very long text is one pass of its own and needs
memory in proportion; columns other than those named are kept by ``score_quality``, which takes the names of
its two columns and refuses those that are there already; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import checkpoints
from lectern.llm import exchange as X
from lectern.llm.lm_score import find, summed
from lectern.llm.textkernel import Polynomial, runs, splitmix

VOCABULARY, SHARED, DIMS, NONZERO, WINDOW = 1 << 15, 1 << 12, 32, 4, 2
MOST_LABELS = 20_000
HIDDEN = 24
THRESHOLD = 0.7
#: Runs of texts whose counts are sent together.
RUNS = 4

_TOKENS = Polynomial(77)
_KIND = np.full(256, 2, dtype=np.uint8)  # 0 space, 1 word, 2 other
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def index_vectors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the nonzero components of the index vectors of hashes; places may repeat."""
    bits = splitmix(h ^ np.uint64(0x51EDBEEF))
    k = np.arange(NONZERO, dtype=np.uint64)
    places = (bits[:, None] >> (k * np.uint64(8))) % np.uint64(DIMS)
    signs = (bits[:, None] >> (np.uint64(48) + k)) & np.uint64(1)
    return places.astype(np.int64), signs.astype(np.int64) * 2 - 1


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each token."""
    kind = _KIND[data]
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    change = np.ones(len(kind) + 1, dtype=bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[off] = True
    at = np.flatnonzero(change)
    start, end = at[:-1], at[1:]
    real = kind[start] > 0
    start, end = start[real], end[real]
    return np.searchsorted(off, start, side="right") - 1, _TOKENS.spans(_TOKENS.prefix(data), start, end)


def slots(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A token's place in the table of vectors: its word's, or behind them that which its hash shares."""
    at = find(words, h)
    return np.where(at >= 0, at, len(words) + (h >> np.uint64(40)).astype(np.int64) % SHARED)


def index_table(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return index_vectors(np.concatenate([words, splitmix(np.arange(SHARED, dtype=np.uint64))]))


def add_contexts(table: np.ndarray, row: np.ndarray, slot: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> None:
    """Adds each token's neighbours' index vectors to its slot's sum; the last column counts."""
    places, signs = index
    n = len(table)
    for d in range(1, WINDOW + 1):
        if len(row) <= d:
            break
        near = row[d:] == row[:-d]
        a, b = slot[d:][near], slot[:-d][near]
        for x, y in ((a, b), (b, a)):
            flat = (x[:, None] * DIMS + places[y]).ravel()
            table[:, :DIMS] += np.bincount(flat, signs[y].ravel(), n * DIMS).reshape(n, DIMS).astype(np.int64)
    table[:, DIMS] += np.bincount(slot, minlength=n)


def frequent_words(docs: DataFrame, most: int) -> np.ndarray:
    """Hashes, in order, of the most frequent tokens of all documents: those of the least count for which there are ``most`` at most."""
    checkpoints.ensure(docs.sparkSession)
    buckets = X.bucket_count(X.text_size(docs))

    def dealt(parts: list) -> pa.RecordBatch:
        h, n = summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        edge = np.searchsorted(X.bucket_of(h, buckets), np.arange(buckets + 1))
        return X.rows([(b, 0, X.tight(X.pack(*X.differences(h[edge[b] : edge[b + 1]]), *X.planes(n[edge[b] : edge[b + 1]])))) for b in np.flatnonzero(np.diff(edge)).tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for _, _, data, off in runs(batch):
                held.append(np.unique(tokens(data, off)[1], return_counts=True))
                if len(held) == RUNS:
                    yield dealt(held)
                    held = []
        if held:
            yield dealt(held)

    def add(table: pa.Table) -> pa.Table:
        parts = [X.unpack(X.loose(c.as_py())) for c in table.column("cell")]
        h, n = summed(np.concatenate([X.undiffer(p[0], p[1]) for p in parts]), np.concatenate([X.unplane(p[2]) for p in parts]))
        return pa.Table.from_batches([X.rows([(0, 0, X.tight(X.pack(*X.differences(h), *X.planes(n))))])])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                n, words = np.unique(X.unplane(X.unpack(X.loose(cell.as_py()))[2]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(words)], names=["n", "words"])

    counted = docs.select("text").mapInArrow(run, X.ROWS).groupBy("bucket").applyInArrow(add, X.ROWS).select("cell").checkpoint()
    # counts by class, exact below 4,096 and in steps of a thousandth above, so that the least count is found without a sort
    size = F.when(F.col("n") < 4096, F.col("n").cast("double")).otherwise(4096 + F.floor(F.log(F.col("n") / 4096) * 1000))
    classes = counted.mapInArrow(counts, "n long, words long").groupBy(size.alias("class")).agg(F.sum("words").alias("words"), F.min("n").alias("least")).orderBy(F.desc("class")).collect()  # some 4,096 + 20,000 classes
    total, least = 0, np.iinfo(np.int64).max
    for r in classes:
        total += r["words"]
        if total > most:
            break
        least = r["least"]

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                first, steps, n = X.unpack(X.loose(cell.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(X.undiffer(first, steps)[X.unplane(n) >= least].view(np.int64))], names=["h"])

    return np.sort(counted.mapInArrow(often, "h long").toArrow().column("h").to_numpy().view(np.uint64))  # ``most`` at most


def word_vectors(docs: DataFrame, most: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """(words' hashes, a vector for each and for each shared slot), from all documents."""
    words = frequent_words(docs, most)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    slices, n = 16, len(words) + SHARED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, index = np.zeros((n, DIMS + 1), dtype=np.int64), index_table(shared.value)
        for batch in batches:
            for _, _, data, off in runs(batch):
                row, h = tokens(data, off)
                add_contexts(table, row, slots(h, shared.value), index)
        yield X.rows([(i, 0, X.tight(X.pack(*X.planes(_unsigned(part.ravel()))))) for i, part in enumerate(np.array_split(table, slices))])

    def reduce(cells: pa.Table) -> pa.Table:
        total = np.sum([_signed(X.unplane(X.unpack(X.loose(c.as_py()))[0])) for c in cells.column("cell")], axis=0)
        return pa.Table.from_batches([X.rows([(cells.column("bucket")[0].as_py(), 0, X.pack(total))])])

    got = docs.select("text").mapInArrow(run, X.ROWS).groupBy("bucket").applyInArrow(reduce, X.ROWS).collect()  # vocabulary + SHARED vectors
    if not got:
        return words, np.zeros((n, DIMS), dtype=np.float32)
    table = np.concatenate([X.unpack(bytes(r["cell"]))[0] for r in sorted(got, key=lambda r: r["bucket"])]).reshape(n, DIMS + 1).astype(np.float64)
    return words, normalised(table)


def normalised(table: np.ndarray) -> np.ndarray:
    vectors = table[:, :DIMS].copy()
    used = table[:, DIMS] > 0
    vectors[used] -= table[used, DIMS : DIMS + 1] * (vectors[used].sum(axis=0) / max(table[used, DIMS].sum(), 1))
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _unsigned(a: np.ndarray) -> np.ndarray:
    return (a << 1) ^ (a >> 63)


def _signed(a: np.ndarray) -> np.ndarray:
    return (a >> 1) ^ -(a & 1)


def pooled(data: np.ndarray, off: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row per document."""
    words, vectors = model
    row, h = tokens(data, off)
    n = len(off) - 1
    out = np.zeros((n, 3 * DIMS), dtype=np.float64)
    if len(row):
        at = np.flatnonzero(np.diff(row, prepend=-1))
        v = vectors[slots(h, words)]
        summed_ = lambda x: np.add.reduceat(x, at, axis=0, dtype=np.float64)
        out[row[at], :DIMS], out[row[at], DIMS : 2 * DIMS] = summed_(v), summed_(v * v)
        v[1:] *= v[:-1].copy()
        v[at] = 0  # the first token of a document has none before
        out[row[at], 2 * DIMS :] = summed_(v)
        out /= np.maximum(np.bincount(row, minlength=n), 1)[:, None]
    return np.round(out, 6)  # products of matrices differ in the last digits with the rows beside them


class Network:
    """Standardised inputs, a tanh layer, a logistic unit and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = 600, rate: float = 0.02, decay: float = 1e-3):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.fitted = len(y) > 1 and 0 < self.prior < 1
        if not self.fitted:
            return
        rng = np.random.RandomState(11)
        kept = np.arange(len(y)) % 6 == 5 if len(y) >= 60 else np.zeros(len(y), dtype=bool)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._inputs(x)
        p = [rng.randn(z.shape[1], HIDDEN) / np.sqrt(z.shape[1]), np.zeros(HIDDEN), rng.randn(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        zt, yt = z[~kept], y[~kept]
        for t in range(1, steps + 1):
            hidden = np.tanh(zt @ p[0] + p[1])
            err = (1 / (1 + np.exp(-(hidden @ p[2] + p[3]))) - yt) / len(yt)
            back = np.outer(err, p[2]) * (1 - hidden**2)
            grads = [zt.T @ back + decay * p[0], back.sum(axis=0), hidden.T @ err + decay * p[2], np.array([err.sum()])]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g**2
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.p = p
        logits, yk = (self._logits(x[kept]), y[kept]) if kept.any() else (self._logits(x), y)
        loss = lambda temp: np.mean(np.logaddexp(0, logits / temp) - yk * logits / temp)
        self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._inputs(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logits(x) / self.temperature, -700, 700)))


def held_out(folds: int, held: int) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, most_labels: int = MOST_LABELS, vocabulary: int = VOCABULARY) -> tuple[tuple[np.ndarray, np.ndarray], Network]:
    vectors = word_vectors(docs, vocabulary)
    taught = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(folds, held)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # most_labels rows of two numbers bound the broadcast
    taught = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quality, doc = batch.column("quality").to_numpy(zero_copy_only=False), batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield X.rows([(0, 0, X.pack(doc[i:j].astype(np.int64), quality[i:j].astype(np.float64), pooled(data, off, shared.value).ravel())) for i, j, data, off in runs(batch)])

    got = docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id").select("doc_id", "quality", "text").mapInArrow(run, X.ROWS).select("cell").collect()
    doc, y, x = X.joined([X.unpack(bytes(r["cell"])) for r in got], ("<i8", "<f8", "<f8"))
    x = x.reshape(len(y), 3 * DIMS)
    order = np.lexsort((*x.T[:3], doc))  # the network doesn't depend on the order of arrival
    order = order[np.argsort(splitmix(doc[order].view(np.uint64)), kind="stable")]
    return vectors, Network(x[order], y[order])


def score_quality(docs: DataFrame, vectors: tuple[np.ndarray, np.ndarray], network: Network, threshold: float = THRESHOLD, names: tuple[str, str] = ("quality_score", "quality_predicted")) -> DataFrame:
    """The documents with their score and whether it is ``threshold`` or more (1 or 0), in columns of these names."""
    if there := {*names} & {*docs.columns}:
        raise ValueError(f"the documents have columns {sorted(there)} already")
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors_, network_ = shared.value
        for batch in batches:
            parts = [network_.scores(pooled(data, off, vectors_)) for _, _, data, off in runs(batch, batch.schema.names[at])]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{names[0]}` double, `{names[1]}` int")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, *model).select("doc_id", held_out(4, 2).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))
