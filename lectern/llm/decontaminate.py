"""Operator 7: benchmark decontamination by a BM25 index with block-max WAND.

Benchmark items are the indexed documents, their terms are pairs of neighbouring words (single words bound
scores too loosely: common ones occur in every passage); every passage of every text is a query. Passages are
windows of ``span`` words with a step of half that; ``span`` is at least twice the longest item's words, so
that each item that occurs in a text lies whole in some passage. An item's BM25 weights are divided by
their sum, so that a score is the share of the item's weight that a passage covers.

All items of score ``retrieve`` or more are retrieved: first a bound for each passage and block of items, the
sum of its terms' greatest weights in the block, is accumulated for many passages of a run at once; passages
with no block at the threshold are done. The others run block-max WAND: postings of the passage's terms
are advanced together, the pivot is the first item whose terms' bounds reach the threshold, blocks whose
finer bounds don't are skipped, and pivots are scored in full.

A retrieved item is verified by word trigrams: the passage holds at least ``whole`` of the item's, and at least
``part`` of those of its question and of its answer. The question ends at the item's first question
mark, or else at half its words.

The index is broadcast. It is bounded: items are taken in chunks of at most ``CHUNK_BYTES`` of text, one pass
over the documents for each (a benchmark beyond one chunk is rare). Document frequencies, the number and mean length of items and
``span`` are those of the whole benchmark, so that results do not depend on the chunks.

Defined results: null or empty texts have no passages and are clean; null and empty items are in no text; an item of one or two
words, which occur in many texts by chance, is in the texts that hold its words and no other; equal
items each count; a null ``doc_id`` stays null, items without ``item_id`` are ignored; repeated rows each give a row; items of equal score
are all retrieved; a very long text is many passages and needs memory in proportion to its words only; other columns are kept by
``contaminated``, which refuses one of the name it adds, and ignored by the query; empty tables give no rows, or clean ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import checkpoints
from lectern.llm import exchange as X
from lectern.llm.textkernel import runs, shingles, splitmix, words

CHUNK_BYTES = 16 << 20
BLOCK = 32
K1, B = 1.2, 0.75
#: Passages times blocks whose bounds are summed at a time.
CELLS = 1 << 22


def pairs(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, hash) of each pair of neighbouring words of a row."""
    at = np.flatnonzero(row[1:] == row[:-1])
    return at, splitmix(h[at] * np.uint64(0x9E3779B97F4A7C15) + splitmix(h[at + 1]))


@dataclass(frozen=True)
class Statistics:
    """Of the whole benchmark: items of three words or more, their mean length and the longest one; terms in order, and in how many items each is."""

    n: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray

    def of(self, terms: np.ndarray) -> np.ndarray:
        return self.df[np.searchsorted(self.terms, terms)]


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, row, hash, start) of the words of texts."""
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    row, h, start, _ = words(np.frombuffer(b"".join(texts), dtype=np.uint8), off)
    return off, row, h, start


class Index:
    """Postings by term, ordered by item; each posting's weight; the greatest weights by block of BLOCK items and by term. Items of fewer than three words are kept by the hash of all their words."""

    def __init__(self, items: list[tuple[int, str]], whole: Statistics):
        every = sorted((i, t.encode()) for i, t in items if i is not None and t)
        _, row, h, _ = _words_of([t for _, t in every])
        length = np.bincount(row, minlength=len(every))
        few = (length > 0) & (length < 3)
        self.short: dict[int, list[int]] = {}
        at, key = shingles(row[few[row]], h[few[row]], 3)
        for k, g in zip(at.tolist(), key.tolist(), strict=True):
            self.short.setdefault(g, []).append(every[k][0])
        self.ids = [i for (i, _), n in zip(every, length.tolist(), strict=True) if n >= 3]
        texts = [t for (_, t), n in zip(every, length.tolist(), strict=True) if n >= 3]
        off, row, h, start = _words_of(texts)
        self.n = len(texts)
        length = np.bincount(row, minlength=self.n)
        place, pair_hash = pairs(row, h)
        self.terms, term = np.unique(pair_hash, return_inverse=True)
        pair, tf = np.unique(term * max(self.n, 1) + row[place], return_counts=True)
        self.term, self.item = pair // max(self.n, 1), pair % max(self.n, 1)
        df = whole.of(self.terms)
        idf = np.log(1 + (whole.n - df + 0.5) / (df + 0.5))
        weight = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.item] / max(whole.mean, 1)))
        self.weight = weight / np.bincount(self.item, weight, self.n)[self.item]
        self.first = np.searchsorted(self.term, np.arange(len(self.terms) + 1))
        self.blocks = -(-self.n // BLOCK)
        key = self.term * max(self.blocks, 1) + self.item // BLOCK
        self.bkey, at = np.unique(key, return_index=True)
        self.bmax = np.maximum.reduceat(self.weight, at) if len(at) else np.zeros(0)
        self.bterm, self.bblock = self.bkey // max(self.blocks, 1), self.bkey % max(self.blocks, 1)
        self.bfirst = np.searchsorted(self.bterm, np.arange(len(self.terms) + 1))
        self.tmax = np.array([self.bmax[a:b].max() for a, b in zip(self.bfirst[:-1], self.bfirst[1:], strict=True)])
        srow, self.grams = shingles(row, h, 3)
        order = np.argsort(srow, kind="stable")
        srow, self.grams = srow[order], self.grams[order]
        self.gfirst = np.searchsorted(srow, np.arange(self.n + 1))
        self.question = []
        for k in range(self.n):
            mark = texts[k].find(b"?")
            ends = start[row == k] - off[k]
            self.question.append(int((ends <= mark).sum()) if 0 <= mark < len(texts[k]) - 1 else -(-int(length[k]) // 2))

    def bounds(self, passage: np.ndarray, term: np.ndarray, count: int) -> np.ndarray:
        """For distinct (passage, term): whether some block's bound reaches a score, as passage by block sums."""
        n = self.bfirst[term + 1] - self.bfirst[term]
        at = np.repeat(self.bfirst[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        return np.bincount(np.repeat(passage, n) * self.blocks + self.bblock[at], self.bmax[at], count * self.blocks).reshape(count, self.blocks)

    def retrieve(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """Block-max WAND: (item, score) of all items whose score is at least ``least``."""
        end = self.n
        lists = [[self.item[self.first[t] : self.first[t + 1]], self.weight[self.first[t] : self.first[t + 1]], 0, t] for t in terms]
        out = []
        now = lambda x: int(x[0][x[2]]) if x[2] < len(x[0]) else end
        while True:
            lists = sorted((x for x in lists if x[2] < len(x[0])), key=now)
            bound, pivot = 0.0, None
            for k, x in enumerate(lists):
                bound += self.tmax[x[3]]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                return out
            item = now(lists[pivot])
            while pivot + 1 < len(lists) and now(lists[pivot + 1]) == item:
                pivot += 1
            block = item // BLOCK
            finer = sum(self._block_max(x[3], block) for x in lists[: pivot + 1])
            if finer < least:
                goal = min((block + 1) * BLOCK, now(lists[pivot + 1]) if pivot + 1 < len(lists) else end)
                goal = max(goal, item + 1)
                for x in lists[: pivot + 1]:
                    x[2] = int(np.searchsorted(x[0], goal))
            elif now(lists[0]) == item:
                score = sum(float(x[1][x[2]]) for x in lists if now(x) == item)
                if score >= least:
                    out.append((item, score))
                for x in lists:
                    if now(x) == item:
                        x[2] += 1
            else:
                for x in lists[:pivot]:
                    if now(x) < item:
                        x[2] = int(np.searchsorted(x[0], item))

    def _block_max(self, term: int, block: int) -> float:
        key = term * self.blocks + block
        at = int(np.searchsorted(self.bkey, key))
        return float(self.bmax[at]) if at < len(self.bkey) and self.bkey[at] == key else 0.0

    def verified(self, item: int, grams: np.ndarray, whole: float, part: float) -> bool:
        mine = self.grams[self.gfirst[item] : self.gfirst[item + 1]]
        hit = np.isin(mine, grams)
        q = self.question[item]
        share = lambda x: x.mean() if len(x) else 1.0
        return bool(share(hit) >= whole and share(hit[:q]) >= part and share(hit[q:]) >= part)


def passages_hit(data: np.ndarray, off: np.ndarray, index: Index, span: int, retrieve: float, whole: float, part: float) -> dict[int, set[int]]:
    """The ids of the verified items of each row."""
    row, h, _, _ = words(data, off)
    out: dict[int, set[int]] = {}
    if not len(row):
        return out
    if index.short:
        few = np.bincount(row, minlength=len(off) - 1)[row] < 3
        for r, g in zip(*(x.tolist() for x in shingles(row[few], h[few], 3)), strict=True):
            if g in index.short:
                out[r] = set(index.short[g])
    if not index.n:
        return out
    begin = np.searchsorted(row, np.arange(len(off)))
    rank = np.arange(len(row)) - begin[row]
    step = span // 2
    steps = np.maximum(-(-np.diff(begin) // step) - 1, 1)  # passages of each row
    base = np.concatenate([[0], np.cumsum(steps)])
    place, pair_hash = pairs(row, h)
    at = np.minimum(np.searchsorted(index.terms, pair_hash), len(index.terms) - 1)
    hit = index.terms[at] == pair_hash
    known, at = place[hit], at[hit]
    half = rank[known] // step
    found = []
    for back in (0, 1):  # a pair lies in two passages, or one at either end
        p = half - back
        ok = (p >= 0) & (p < steps[row[known]]) & (rank[known] + 1 < (p * step + span))
        found.append((base[row[known]] + p)[ok] * len(index.terms) + at[ok])
    pair = np.unique(np.concatenate(found))
    passage, term = pair // len(index.terms), pair % len(index.terms)
    live, some = [], max(1, CELLS // index.blocks)
    for first in range(0, int(base[-1]), some):
        count = min(some, int(base[-1]) - first)
        lo, hi = np.searchsorted(passage, [first, first + count])
        live += (first + np.flatnonzero(index.bounds(passage[lo:hi] - first, term[lo:hi], count).max(axis=1) >= retrieve)).tolist()
    for p in live:
        r = int(np.searchsorted(base, p, side="right")) - 1
        lo, hi = np.searchsorted(passage, [p, p + 1])
        hits = index.retrieve(term[lo:hi].tolist(), retrieve)
        if not hits:
            continue
        a = int(begin[r]) + (p - int(base[r])) * step
        b = min(a + span, int(begin[r + 1]))
        grams = shingles(np.zeros(b - a, dtype=np.int64), h[a:b], 3)[1]
        if found := {index.ids[i] for i, _ in hits if index.verified(i, grams, whole, part)}:
            out.setdefault(r, set()).update(found)
    return out


def statistics(items: DataFrame) -> DataFrame:
    """(term, df) over all items of three words or more, and under no term their number, words and greatest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in runs(batch):
                row, h, _, _ = words(data, off)
                length = np.bincount(row, minlength=len(off) - 1)
                real = length[row] >= 3
                place, term = pairs(row[real], h[real])
                term = np.unique(np.rec.fromarrays([row[real][place], term], names="row,term"))["term"]
                key, df = np.unique(term, return_counts=True)
                long = length[length >= 3]
                # the lengths go under no term
                yield pa.RecordBatch.from_arrays([pa.array([*key.view(np.int64).tolist(), None], pa.int64()), pa.array([*df.tolist(), len(long)], pa.int64()), pa.array([0] * len(key) + [int(long.sum())], pa.int64()), pa.array([0] * len(key) + [int(long.max(initial=0))], pa.int64())], names=["term", "df", "words", "longest"])

    return items.where("item_id IS NOT NULL").select("text").mapInArrow(run, "term long, df long, words long, longest long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"), F.max("longest").alias("longest"))


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, off in runs(batch):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(pairs(*words(data, off)[:2])[1]).view(np.int64))], names=["term"])


def contaminated(docs: DataFrame, benchmark: DataFrame, retrieve: float = 0.35, whole: float = 0.5, part: float = 0.25, chunk_bytes: int = CHUNK_BYTES, name: str = "benchmark_items") -> DataFrame:
    """The documents with the item_ids found in each, in order, in a column of that name."""
    spark = docs.sparkSession
    checkpoints.ensure(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chunks = max(1, -(-X.text_size(items) // chunk_bytes))
    at = docs.columns.index("text")
    if name in docs.columns:
        raise ValueError(f"the documents have a column {name} already")
    counted = statistics(items).checkpoint()
    total = counted.where("term IS NULL").first()
    n, length, longest = (total["df"], total["words"], total["longest"]) if total else (0, 0, 0)
    span = max(128, 2 * longest)
    span += span % 2
    out = docs.withColumn(name, F.array().cast("array<long>"))
    for c in range(chunks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c)  # about chunk_bytes
        terms = counted.join(mine.select("text").mapInArrow(_terms_of, "term long").distinct(), "term").select("term", "df").toArrow()
        term, df = terms.column("term").to_numpy().view(np.uint64), terms.column("df").to_numpy()
        order = np.argsort(term)
        chosen = [(r["item_id"], r["text"]) for r in mine.collect()]
        shared = spark.sparkContext.broadcast(Index(chosen, Statistics(n, length / max(n, 1), longest, term[order], df[order])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found: list = batch.column(batch.num_columns - 1).to_pylist()
                for first, _, data, off in runs(batch, batch.schema.names[at]):
                    for r, hit in passages_hit(data, off, index, span, retrieve, whole, part).items():
                        found[first + r] = sorted({*found[first + r], *hit})
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, batch.schema.field(batch.num_columns - 1).type)], schema=batch.schema)

        out = out.mapInArrow(run, out.schema)
    return out


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("benchmark_items") > 0).alias("contaminated"), F.size("benchmark_items").cast("long").alias("n_items"), F.array_join("benchmark_items", ",").alias("item_ids"))
