"""Operator 10: language-model scoring by a weighted backoff automaton.

Training documents are those whose crc32(doc_id as text) modulo ``folds`` differs from ``held``.

*Model.* A trigram model of words, interpolated at each order, with every count taken over all training documents:

* ``p(w) = (c(w) + 1) / (N + V + 1)``, over the whole vocabulary and one unknown word;
* ``p(w | u) = (c(uw) + prior * p(w)) / (c(u) + prior)``;
* ``p(w | uv) = (c(uvw) - discount) / c(uv) + bow(uv) * p(w | v)`` for the trigrams that training holds ``least`` times
  or more, ``bow(uv) * p(w | v)`` for the rest; ``bow(uv)`` is what the kept ones leave, so that probabilities sum to one.

Nothing is bounded by a share, so the model grows with the corpus and rare words are in n-grams.

*Automaton.* Trigrams kept, bigrams and words are states; a state's failure arc leads to its longest known suffix with
the weight ``bow`` (``prior / (c(u) + prior)`` behind a single word). A left-to-right traversal carries the state and adds
up the logarithms. As the state depends on the last two tokens only, it is evaluated for all places of a run at once.

*Plan.* No task and no broadcast holds the model; it lies in buckets. Documents are dealt in chunks of some
``CHUNK`` bytes, known by a hash of their rows. (1) A chunk asks the buckets for its distinct words and bigrams, with its own training
counts; its trigrams go with the bigram that they begin with, so that a bucket knows all that follows it. Trigrams behind a
bigram of more than the share ``HOT`` of all (found in one pass over the texts; ``1 / HOT`` at most) are dealt on their own, and
only what the kept ones sum to is sent round. (2) A bucket adds the counts and answers each chunk. (3) The answers meet the chunk's
texts, which are read again, in its home bucket. A bucket gets one entry per chunk and distinct n-gram at most, so no word or
line is hot. Hashes go sorted, as differences, compressed.

N-grams are compared by hashes: 64 bits in a chunk, and in a bucket 40 bits beside the bucket's number (a trigram: 32
more beside those of its first two words). Defined results: null text counts as empty (one end token); a null
``doc_id`` counts as training and stays null; repeated rows each count and each give a row; very long texts are a chunk of their own
and need memory in proportion; other columns are ignored; an empty table gives no rows. Tables whose
rows come in another order each time they are read have to be written first: a chunk without its answers is an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import checkpoints
from lectern.llm import exchange as X
from lectern.llm.textkernel import runs, runs_of, splitmix, words

BUCKET_BYTES = 8 << 20
#: Bytes of text in a chunk.
CHUNK = 4 << 20
#: Bigrams of this share of all or more have their trigrams dealt on their own.
HOT = 1 / 1000
#: Bits of a hash that tell n-grams of a bucket apart.
BITS = 40
ASK, STATE, REPLY, SUMS = 0, 1, 2, 3
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
END = splitmix(np.array([0x656E64], dtype=np.uint64))
START = splitmix(np.array([0x7374617274], dtype=np.uint64))
NULL_ID = np.iinfo(np.int64).min


def ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def held_out(doc: np.ndarray, folds: int, held: int) -> np.ndarray:
    return np.array([d != NULL_ID and zlib.crc32(b"%d" % d) % folds == held for d in doc.tolist()], dtype=bool)


def summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not len(key):
        return key, count
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    at = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    return key[at], np.add.reduceat(count, at)


def find(sorted_keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each key, or -1."""
    if not len(sorted_keys):
        return np.full(len(key), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == key, at, -1)


def followed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of all its words but the last, and the last word's."""
    with np.errstate(over="ignore"):
        return splitmix(first * np.uint64(0x9E3779B97F4A7C15) + splitmix(second))


class Chunk:
    """The n-grams of a run of documents. Places are those of start, words and end of each document.

    ``word``, ``pair`` and ``triple`` hold distinct n-grams by rising hash (triples by pair, then word), ``*_at`` the n-gram that ends at
    each place or -1. Hot pairs, whose triples are dealt on their own, are those among ``hot``."""

    def __init__(self, data: np.ndarray, off: np.ndarray, hot: np.ndarray):
        n = len(off) - 1
        parts = [(i, words(d, o)) for i, _, d, o in runs_of(data, off)]
        row, h = (np.concatenate(x) for x in ([np.zeros(0, np.int64), *(i + w[0] for i, w in parts)], [np.zeros(0, np.uint64), *(w[1] for _, w in parts)]))
        counts = np.bincount(row, minlength=n)
        self.doc = np.repeat(np.arange(n), counts + 2)
        stream = np.empty(len(self.doc), dtype=np.uint64)
        stream[np.arange(len(row)) + 2 * row + 1] = h
        ends = np.cumsum(counts + 2) - 1
        self.lengths = counts + 1
        stream[ends], stream[ends - counts - 1] = END, START
        self.start = np.zeros(len(stream), dtype=bool)
        self.start[ends - counts - 1] = True
        self.word, self.word_at = np.unique(stream, return_inverse=True)
        self.pair, self.pair_at = self._longer(stream, np.concatenate([stream[:1], stream[:-1]]), ~self.start)
        behind = np.concatenate([[-1], self.pair_at[:-1]])
        ok = (behind >= 0) & (self.pair_at >= 0)
        size = np.uint64(max(len(self.word), 1))
        key, self.triple_at = self._distinct(behind.astype(np.uint64) * size + self.word_at.astype(np.uint64), ok)
        self.triple_pair = (key // size).astype(np.int64)
        self.triple_word = self.word[(key % size).astype(np.int64)]
        self.pair_hot = find(hot, self.pair)
        self.triple_hot = self.pair_hot[self.triple_pair] >= 0
        loose = np.flatnonzero(self.triple_hot)
        self.loose = followed(self.pair[self.triple_pair[loose]], self.triple_word[loose])
        order = np.argsort(self.loose, kind="stable")
        self.loose, self.loose_triple = self.loose[order], loose[order]

    @staticmethod
    def _distinct(key: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.full(len(key), -1, dtype=np.int64)
        distinct, at[ok] = np.unique(key[ok], return_inverse=True)
        return distinct, at

    def _longer(self, last: np.ndarray, before: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._distinct(np.where(ok, followed(before, last), np.uint64(0)), ok)

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often each word, pair and triple ends at a place in ``train``."""
        return tuple(np.bincount(at[train & (at >= 0)], minlength=n) for at, n in ((self.word_at, len(self.word)), (self.pair_at, len(self.pair)), (self.triple_at, len(self.triple_pair))))

    def dealt(self, buckets: int) -> Iterator[tuple[int, slice, slice, np.ndarray, slice]]:
        """(bucket, its words, its pairs, its triples by pair, its triples dealt alone) for buckets that have any."""
        edges = [np.searchsorted(X.bucket_of(h, buckets), np.arange(buckets + 1)) for h in (self.word, self.pair, self.loose)]
        close = np.flatnonzero(~self.triple_hot)
        first = np.searchsorted(self.triple_pair[close], edges[1])
        for b in np.flatnonzero((np.diff(edges[0]) > 0) | (np.diff(edges[1]) > 0) | (np.diff(edges[2]) > 0)).tolist():
            w, p, x = (slice(e[b], e[b + 1]) for e in edges)
            yield b, w, p, close[first[b] : first[b + 1]], x


def _home(chunk: int, buckets: int) -> int:
    return int(X.bucket_of(splitmix(np.array([chunk], dtype=np.uint64)), buckets)[0])


def name_of(doc: np.ndarray, data: np.ndarray, off: np.ndarray) -> int:
    """A hash of a chunk's rows in order."""
    h = hashlib.blake2b(digest_size=8)
    for part in (doc, off.astype(np.int64), data):
        h.update(np.ascontiguousarray(part))
    return int.from_bytes(h.digest(), "little")


def _hot_pairs(docs: DataFrame, folds: int, held: int) -> np.ndarray:
    """Hashes of bigrams of at least the share HOT of all. Which are found only moves work, never a result."""
    none = np.zeros(0, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, seen = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), 0
        for batch in batches:
            for _, _, data, off in runs(batch):
                c = Chunk(data, off, none)
                n = np.bincount(c.pair_at[c.pair_at >= 0], minlength=len(c.pair))
                total = int(n.sum())
                seen += total
                often = n >= max(8, HOT * total)
                key, count = summed(np.concatenate([key, c.pair[often]]), np.concatenate([count, n[often]]))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count), pa.array(np.full(len(key), seen))], names=["h", "c", "seen"])

    found = docs.mapInArrow(run, "h long, c long, seen long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen")).where(F.col("c") >= HOT * F.col("seen"))
    return np.sort(found.select("h").toArrow().column("h").to_numpy().view(np.uint64))


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2, least: int = 2, discount: float = 0.5, prior: float = 2.0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    spark = docs.sparkSession
    checkpoints.ensure(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = X.bucket_count(X.text_size(docs), bucket_bytes)
    cut = np.uint64(max(0, 64 - BITS - (buckets.bit_length() - 1)))
    hot = spark.sparkContext.broadcast(_hot_pairs(docs, folds, held))

    def chunks(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            doc_all = ids(batch.column(0))
            for i, j, data, off in runs(batch, most=CHUNK):
                yield name_of(doc_all[i:j], data, off), doc_all[i:j], data, off

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, doc, data, off in chunks(batches):
            c = Chunk(data, off, hot.value)
            ones, twos, threes = c.counts(~held_out(doc, folds, held)[c.doc])
            out = []
            for b, w, p, t, x in c.dealt(buckets):
                children = np.bincount(c.triple_pair[t] - p.start, minlength=p.stop - p.start)
                loose = c.loose_triple[x]
                parts = [
                    np.array([name], dtype=np.uint64), *X.differences(c.word[w] >> cut), *X.planes(ones[w]),
                    *X.differences(c.pair[p] >> cut), *X.planes(twos[p]), *X.planes(children),
                    (splitmix(c.triple_word[t]) >> np.uint64(32)).astype(np.uint32), *X.planes(threes[t]),
                    *X.differences(c.loose[x] >> cut), *X.planes(c.pair_hot[c.triple_pair[loose]]), *X.planes(threes[loose]),
                ]
                out.append((b, ASK, X.tight(X.pack(*parts))))
            yield X.rows(out)

    def count_up(table: pa.Table) -> pa.Table:
        """Answers with counts, 0 for triples not kept, and what the kept triples behind each pair sum to; sends round the sums of hot pairs and of words."""
        bucket = table.column("bucket")[0].as_py()
        names, parts = [], []
        for cell in table.column("cell"):
            a = X.unpack(X.loose(cell.as_py()))
            names.append(int(a[0][0]))
            word, ones, pair, twos, children = X.undiffer(a[1], a[2]), X.unplane(a[3]), X.undiffer(a[4], a[5]), X.unplane(a[6]), X.unplane(a[7])
            parts.append((word, ones, pair, twos, children, a[8].astype(np.uint64), X.unplane(a[9]), X.undiffer(a[10], a[11]), X.unplane(a[12]), X.unplane(a[13])))
        column = lambda k: np.concatenate([p[k] for p in parts])
        edges = lambda k: np.cumsum([len(p[k]) for p in parts])[:-1]

        def totals(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            distinct, at = np.unique(key, return_inverse=True)
            return distinct, at, np.bincount(at, count, len(distinct)).astype(np.int64)

        word, word_at, ones = totals(column(0), column(1))
        pair, pair_at, twos = totals(column(2), column(3))
        behind = np.repeat(pair_at, column(4))
        triple, triple_at, threes = totals(behind.astype(np.uint64) << np.uint64(32) | column(5), column(6))
        loose, loose_at, alone = totals(column(7), column(9))
        threes[threes < least] = 0
        alone[alone < least] = 0
        parent = (triple >> np.uint64(32)).astype(np.int64)
        mass = np.bincount(parent, threes, len(pair)).astype(np.int64)
        kinds = np.bincount(parent, threes > 0, len(pair)).astype(np.int64)
        out = []
        split = lambda values, k: np.split(values, edges(k))
        # of a pair's count and its kept triples' the difference, and theirs beyond the least, are small numbers
        answers = zip(names, split(ones[word_at], 0), split((twos - mass)[pair_at], 2), split(kinds[pair_at], 2), split((mass - least * kinds)[pair_at], 2), split(threes[triple_at], 5), split(alone[loose_at], 7), strict=True)
        for name, single, rest, kind, more, after, far in answers:
            values = (single, rest, kind, more[kind > 0], after, far)
            out.append((_home(name, buckets), REPLY, X.tight(X.pack(np.array([name, bucket], dtype=np.uint64), *(x for v in values for x in X.planes(v))))))
        real = (ones > 0) & (word != (START >> cut)[0])
        hot_of = np.zeros(len(loose), dtype=np.int64)
        hot_of[loose_at] = column(8)
        n_hot = len(hot.value)
        out.append((0, SUMS, X.pack(np.array([ones[real].sum(), real.sum()], dtype=np.int64), np.bincount(hot_of, alone, n_hot).astype(np.int64), np.bincount(hot_of, alone > 0, n_hot).astype(np.int64))))
        return pa.Table.from_batches([X.rows(out)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(hot.value) + 1), dtype=np.int64)
        for batch in batches:
            for cell in batch.column(0):
                head, mass, kinds = X.unpack(cell.as_py())
                total += np.stack([np.append(mass, head[0]), np.append(kinds, head[1])])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1])), *(pa.array(x) for x in total)], names=["k", "mass", "kinds"])

    def state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for name, doc, data, off in chunks(batches):
            yield X.rows([(_home(name, buckets), STATE, X.pack(np.array([name], dtype=np.uint64), doc, np.diff(off), np.frombuffer(z.compress(data.tobytes()), dtype=np.uint8)))])

    answers = docs.mapInArrow(ask, X.ROWS).groupBy("bucket").applyInArrow(count_up, X.ROWS).checkpoint()
    rows = answers.where(F.col("kind") == SUMS).select("cell").mapInArrow(sums, "k long, mass long, kinds long").groupBy("k").agg(F.sum("mass").alias("mass"), F.sum("kinds").alias("kinds")).orderBy("k").collect()  # 1 / HOT + 1 rows
    tokens, distinct = (int(rows[-1]["mass"]), int(rows[-1]["kinds"])) if rows else (0, 0)
    hot_mass, hot_kinds = (np.array([r[c] for r in rows[:-1]], dtype=np.int64) for c in ("mass", "kinds"))

    def score(table: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        replies = {}
        for kind, cell in zip(table.column("kind").to_pylist(), table.column("cell"), strict=True):
            if kind == REPLY:
                cell = cell.as_py()
                head = X.unpack(X.loose(cell))[0]
                replies[int(head[0]), int(head[1])] = cell
        out = []
        for name, doc, sizes, z in X.cells(table, STATE):
            data = np.frombuffer(unzip.decompress(z.tobytes()), dtype=np.uint8)
            c = Chunk(data, np.concatenate([[0], np.cumsum(sizes)]), hot.value)
            ones, twos, mass, kinds, threes = (np.zeros(n, dtype=np.int64) for n in (len(c.word), *[len(c.pair)] * 3, len(c.triple_pair)))
            for b, w, p, t, x in c.dealt(buckets):
                if (int(name[0]), b) not in replies:
                    raise RuntimeError("the documents were read in another order than before; write them to a table first")
                a = X.unpack(X.loose(replies[int(name[0]), b]))[1:]
                ones[w], rest, kinds[p], more, threes[t], threes[c.loose_triple[x]] = (X.unplane(v) for v in a)
                kept = np.flatnonzero(kinds[p])
                mass[p.start + kept] = more + least * kinds[p][kept]
                twos[p] = rest + mass[p]
            is_hot = c.pair_hot >= 0
            mass[is_hot], kinds[is_hot] = hot_mass[c.pair_hot[is_hot]], hot_kinds[c.pair_hot[is_hot]]
            at = np.flatnonzero(~c.start)
            base = (ones[c.word_at[at]] + 1.0) / (tokens + distinct + 1)
            seen = ones[c.word_at[at - 1]]
            two = (twos[c.pair_at[at]] + prior * base) / (seen + prior)
            behind = np.where(c.triple_at[at] >= 0, c.pair_at[at - 1], -1)
            count = np.where(behind >= 0, twos[behind], 0) if len(twos) else np.zeros(len(at))
            known = count > 0
            count = np.maximum(count, 1)
            kept = np.where(known, threes[c.triple_at[at]], 0) if len(threes) else np.zeros(len(at))
            left = np.where(known, 1 - (mass[behind] - discount * kinds[behind]) / count, 1.0) if len(twos) else np.ones(len(at))
            best = np.where(kept > 0, (kept - discount) / count, 0.0) + left * two
            place, m = c.doc[at], len(doc)
            out.append([doc, held_out(doc, folds, held), c.lengths, np.bincount(place[ones[c.word_at[at]] > 0], minlength=m), np.bincount(place, np.log10(base), m), np.bincount(place, np.log10(best), m)])
        doc, held_, size, n_known, base, best = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, t) for t in ("<i8", bool, "<i8", "<i8", "<f8", "<f8"))
        return pa.table({"doc_id": pa.array(doc, mask=doc == NULL_ID), "held_out": held_, "n_tokens": size, "n_known": n_known, "train_tokens": np.full(len(doc), tokens, dtype=np.int64), "base_score": base, "score": best})

    return docs.mapInArrow(state, X.ROWS).unionByName(answers.where(F.col("kind") == REPLY)).groupBy("bucket").applyInArrow(score, SCHEMA)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
