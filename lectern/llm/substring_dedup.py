"""Operator 3: removal of repeated ``depth``-byte strings by a depth-limited radix sort of suffixes.

Sorting every suffix to depth 100 would shuffle every byte's window. The passes below go from the most
significant digit to the full depth, and a pass sorts only what the last one left undecided:

1. *Digit of 40 bytes, at anchors.* An anchor is a place whose 40-byte hash is least in some window of 100
   bytes, so equal windows have equal anchors at equal places, and a text has about one anchor in 31 bytes.
   Anchors are dealt by this digit.
2. *Digit of the surroundings.* Within a digit, anchors whose surroundings (60 bytes before to 60 behind) are
   equal are repeats with all windows around them: all but the first are marked.
3. *Digits of 70 bytes.* A window around an anchor holds 30 more bytes on one side of it at least. The first anchor of
   each kind of surroundings goes on, with the windows of a side, only if that side's longer digit has other
   surroundings too.
4. *Full depth.* The windows around these are sorted by their whole content; all but the first of each group of
   equal windows are marked.

Groups are equal strings, so the results are exact but for collisions of hashes of 96 bits or more (a digit and
its surroundings, or two hashes of a window). Digits that very many documents share (found in one counting pass;
at most mean anchors / HOT of each length) are dealt by digit and surroundings together; their longer digits are
dealt on their own, or, if these are as common, go on to full depth unseen. Equal keys are combined in each
task before they are dealt, so no task gathers a hot string.

Defined results: a null text counts as empty; a null ``doc_id`` stays null and counts as the least; rows that
share a doc_id are ordered by a hash of their texts, and rows alike in both are one document and each give
its row; texts under 100 bytes keep all; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import checkpoints
from lectern.llm import exchange as X
from lectern.llm.lm_score import NULL_ID, ids, summed
from lectern.llm.textkernel import Polynomial, runs, splitmix

DIGIT = 40
HOT = 1 / 200
FIRST, SECOND = Polynomial(31), Polynomial(32)
_MARK = ("<i8", "<u4", "<u4", "<u4")
BUCKET_BYTES = 24 << 20
#: Bytes of texts that are compressed at a time.
TEXT_RUN = 4 << 20
_EMPTY = np.zeros(0, np.int64)


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every ``width`` neighbours."""
    span, out = 1, x
    while 2 * span <= width:
        out = best(out[:-span], out[span:])
        span *= 2
    return best(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


def anchors(data: np.ndarray, off: np.ndarray, depth: int, digit: int):
    """(row, place in the row, digit hash, hashes of what is near before, near behind, and around it all) of the anchors of a run."""
    if len(data) < depth:
        return _EMPTY, _EMPTY, _EMPTY.astype(np.uint64), *[_EMPTY.astype(np.uint32)] * 3
    width = depth - digit + 1
    gram = FIRST.grams(FIRST.prefix(data), digit)
    least = sliding(gram, width, np.minimum)  # of the window that begins at each place
    end = np.repeat(off[1:], np.diff(off))
    whole = np.arange(len(least)) + depth <= end[: len(least)]
    padded = np.zeros(len(least) + 2 * (width - 1), dtype=np.uint64)
    padded[width - 1 : width - 1 + len(least)] = np.where(whole, least, np.uint64(0))
    place = np.flatnonzero((sliding(padded, width, np.maximum) == gram) & (gram > 0))
    row = np.searchsorted(off, place, side="right") - 1
    a = np.maximum(off[row], place - (width - 1))
    b = np.minimum(off[row + 1], place + depth)
    prefix, near, last = SECOND.prefix(data), (width - 1) // 2, place + digit
    top = lambda h: (h >> np.uint64(32)).astype(np.uint32)
    before = top(SECOND.spans(prefix, np.maximum(place - near, a), place))
    behind = top(SECOND.spans(prefix, last, np.minimum(last + near, b)))
    around = top(splitmix(SECOND.spans(prefix, a, b) + (place - a).astype(np.uint64)))
    # 48 bits of the digit's hash are kept: with the three others, 144 tell surroundings apart
    return row, place - off[row], gram[place] & ~np.uint64(0xFFFF), before, behind, around


def longer(h: np.ndarray, side: np.ndarray, which: int) -> np.ndarray:
    """Hash of a digit with what is near on one side."""
    return splitmix(h ^ splitmix(side.astype(np.uint64) + np.uint64(which << 40)))


def first_of(*keys: np.ndarray) -> np.ndarray:
    """In sorted keys, whether each place begins a group."""
    out = np.zeros(len(keys[0]), dtype=bool)
    if len(out):
        out[0] = True
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def shared_by_several(key: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), dtype=bool)
    out[order] = np.append(same, False) | np.insert(same, 0, False)
    return out


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by the keys, first most significant; whether each place begins a group of equal keys)."""
    order = np.lexsort(keys[::-1])
    begins = np.zeros(len(order), dtype=bool)
    if len(order):
        begins[0] = True
        for k in keys:
            begins[1:] |= k[order][1:] != k[order][:-1]
    return order, begins


def merged(doc: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray, share: int = 0) -> list[np.ndarray]:
    """Intervals of each document, those that share ``share`` bytes or more as one (0: those that touch, too)."""
    if not len(doc):
        return [x[:0] for x in (doc, text, start, end)]
    order = np.lexsort((start, text, doc))
    doc, text, start, end = doc[order], text[order], start[order].astype(np.int64), end[order].astype(np.int64)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
    shift = (np.cumsum(new) - 1) << np.int64(33)  # documents follow each other on one line
    reach = np.maximum.accumulate(end + shift)
    new[1:] |= start[1:] + shift[1:] > reach[:-1] - share
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return [doc[at], text[at], start[at].astype(np.uint32), (reach[last] - shift[last]).astype(np.uint32)]


def name_of(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of each text, for rows that share a doc_id."""
    return (FIRST.spans(FIRST.prefix(data), off[:-1], off[1:]) >> np.uint64(32)).astype(np.uint32)


def owners(doc: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each entry's document as a place in the lists of distinct documents, and these lists."""
    owner, inverse = np.unique(np.rec.fromarrays([doc, text], names="doc,text"), return_inverse=True)
    return X.small(inverse.ravel()), np.ascontiguousarray(owner["doc"]), np.ascontiguousarray(owner["text"])


def disowned(parts: list[list[np.ndarray]], at: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse over several cells: owners' three arrays begin at ``at``."""
    return np.concatenate([p[at + 1][p[at]] for p in parts]), np.concatenate([p[at + 2][p[at]] for p in parts])


def _documents(doc: np.ndarray, buckets: int) -> np.ndarray:
    return X.bucket_of(splitmix(doc.view(np.uint64)), buckets)


def _marks(doc, text, start, end, buckets: int, depth: int) -> list[tuple[int, int, bytes]]:
    """Repeated stretches; they share all but a byte of a window where they are merged, so every window in one is a repeat."""
    cols = merged(doc, text, start, end, depth - 1)
    return [(b, 1, X.pack(*(c[at] for c in cols))) for b, at in X.by_bucket(_documents(cols[0], buckets))]


def _go_on(doc, text, place, sides, buckets: int) -> list[tuple[int, int, bytes]]:
    """Anchors whose windows go on to full depth; sides: 1 for those with more bytes before it, 2 behind, 3 both."""
    return [(x, 2, X.pack(doc[at], text[at], place[at].astype(np.uint32), sides[at].astype(np.uint8))) for x, at in X.by_bucket(_documents(doc, buckets))]


def remove_repeats(docs: DataFrame, depth: int = 100, digit: int = DIGIT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, kept_text (binary), n_bytes and ``spans``, an array of the removed (start, end)."""
    spark = docs.sparkSession
    checkpoints.ensure(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = X.bucket_count(X.text_size(docs), bucket_bytes)
    side = depth - digit

    def batch_anchors(batch, need_doc=True):
        doc = ids(batch.column(0)) if need_doc else None
        parts = []
        for i, _, data, off in runs(batch):
            row, place, h, *around_ = anchors(data, off, depth, digit)
            text = name_of(data, off) if need_doc else None
            parts.append((h, *around_, doc[row + i], text[row], place) if need_doc else (h, *around_))
        return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else None

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, seen = np.zeros(0, np.uint64), _EMPTY, 0
        for batch in batches:
            got = batch_anchors(batch, False)
            if got is None:
                continue
            order, begins = groups(*got)
            h, before, behind, _ = (x[order[begins]] for x in got)
            h = np.concatenate([h, longer(h, before, 0), longer(h, behind, 1)])
            k, c = summed(h, np.ones(len(h), dtype=np.int64))
            seen += batch.num_rows
            often = c >= max(8, HOT * batch.num_rows)
            key, count = summed(np.concatenate([key, k[often]]), np.concatenate([count, c[often]]))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count), pa.array(np.full(len(key), seen))], names=["h", "c", "seen"])

    counted = docs.select("text").withColumn("doc_id", F.lit(0)).select("doc_id", "text").mapInArrow(frequent, "h long, c long, seen long")
    hot_keys = counted.groupBy("h").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen")).where(F.col("c") >= HOT * F.col("seen")).select("h").toArrow()
    shared = spark.sparkContext.broadcast(np.sort(hot_keys.column("h").to_numpy().view(np.uint64)))

    def is_hot(h):
        keys = shared.value
        return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h if len(keys) else np.zeros(len(h), dtype=bool)

    def around(place):
        return np.maximum(place.astype(np.int64) - side, 0), place.astype(np.int64) + depth

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch_anchors(batch)
            if got is None:
                continue
            order, begins = groups(*got)
            h, before, behind, rest, doc, text, place = (x[order[begins]] for x in got)  # rows alike are one document
            first = first_of(h, before, behind, rest)
            a, b = around(place[~first])
            out = _marks(doc[~first], text[~first], a, b, buckets, depth)
            h, before, behind, rest, doc, text, place = (x[first] for x in (h, before, behind, rest, doc, text, place))
            hot = is_hot(h)
            key = np.where(hot, splitmix(h ^ longer(rest.astype(np.uint64), behind, 2)), h)
            for bucket, at in X.by_bucket(X.bucket_of(splitmix(key), buckets)):
                out.append((bucket, 0, X.pack((h[at] >> np.uint64(32)).astype(np.uint32), (h[at] >> np.uint64(16)).astype(np.uint16), before[at], behind[at], rest[at], *owners(doc[at], text[at]), X.small(place[at]))))
            around_ = splitmix(h ^ longer(rest.astype(np.uint64), before, 3) ^ behind.astype(np.uint64))
            for side_, k in ((1, longer(h, before, 0)), (2, longer(h, behind, 1))) if hot.any() else ():
                unseen = hot & is_hot(k)
                out += _go_on(doc[unseen], text[unseen], place[unseen], np.full(int(unseen.sum()), side_), buckets)
                seen = np.flatnonzero(hot & ~unseen)
                for x, at in X.by_bucket(X.bucket_of(splitmix(k[seen]), buckets)):
                    at = seen[at]
                    out.append((x, 6, X.pack(k[at], around_[at], np.full(len(at), side_, dtype=np.uint8), *owners(doc[at], text[at]), X.small(place[at]))))
            yield X.rows(out)

    def passed(table: pa.Table, kind: int) -> list:
        bucket = table.column("bucket")[0].as_py()
        return [(bucket, kind, c.as_py()) for k, c in zip(table.column("kind").to_pylist(), table.column("cell"), strict=True) if k == kind]

    def by_digit(table: pa.Table) -> pa.Table:
        """Marks (kind 1) and the anchors whose windows go on to full depth (kind 2)."""
        out = passed(table, 1) + passed(table, 2)

        if parts := X.cells(table, 0):
            doc, text = disowned(parts, 5)
            high, low, before, behind, rest, place = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 3, 4, 8))
            h = high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64) << np.uint64(16)
            order, begins = groups(h, before, behind, rest, doc, text, place)
            order = order[begins]
            h, before, behind, rest, doc, text, place = (x[order] for x in (h, before, behind, rest, doc, text, place))
            first = first_of(h, before, behind, rest)
            a, b = around(place[~first])
            out += _marks(doc[~first], text[~first], a, b, buckets, depth)
            h, before, behind, doc, text, place = (x[first] for x in (h, before, behind, doc, text, place))
            sides = shared_by_several(longer(h, before, 0)) + 2 * shared_by_several(longer(h, behind, 1))
            on = (sides > 0) & ~is_hot(h)
            out += _go_on(doc[on], text[on], place[on], sides[on], buckets)
        if parts := X.cells(table, 6):
            doc, text = disowned(parts, 3)
            k, c, sides, place = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 6))
            order = np.lexsort((place, text, doc, c, k))
            order = order[first_of(k[order], c[order])]
            on = order[shared_by_several(k[order])]
            out += _go_on(doc[on], text[on], place[on], sides[on], buckets)
        return pa.Table.from_batches([X.rows(out)])

    def send_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            doc, out = ids(batch.column(0)), []
            for first, end, data, off in runs(batch, most=TEXT_RUN):
                n = end - first
                text = name_of(data, off)
                for bucket, at in X.by_bucket(_documents(doc[first : first + n], buckets)):
                    raw = b"".join(data[off[k] : off[k + 1]].tobytes() for k in at)
                    out.append((bucket, 3, X.pack(doc[first : first + n][at], text[at], np.diff(off)[at], np.frombuffer(z.compress(raw), dtype=np.uint8))))
            yield X.rows(out)

    def texts_of(table: pa.Table):
        """(doc, text hash, bytes) of the texts of a bucket."""
        unzip = zstandard.ZstdDecompressor()
        for doc, text, n, z in X.cells(table, 3):
            raw = np.frombuffer(unzip.decompress(z.tobytes()), dtype=np.uint8) if len(z) else np.zeros(0, np.uint8)
            off = np.concatenate([[0], np.cumsum(n)])
            for k in range(len(doc)):
                yield int(doc[k]), int(text[k]), raw[off[k] : off[k + 1]]

    def by_key(cols: list[np.ndarray]) -> dict:
        """(doc, text hash) → the slices of the other columns."""
        order, begins = groups(cols[0], cols[1])
        at = np.append(np.flatnonzero(begins), len(order))
        cols = [c[order] for c in cols]
        return {(int(cols[0][a]), int(cols[1][a])): [c[a:b] for c in cols[2:]] for a, b in zip(at[:-1], at[1:], strict=True)}

    def windows(table: pa.Table) -> pa.Table:
        wanted = by_key(X.joined(X.cells(table, 2), ("<i8", "<u4", "<u4", "u1")))
        known = by_key(merged(*X.joined(X.cells(table, 1), _MARK), depth - 1)) if wanted else {}
        near = side // 2
        parts = []
        for doc, text, raw in texts_of(table) if wanted else ():
            if (doc, text) not in wanted:
                continue
            place, sides = wanted[doc, text]
            at = lambda flag, low, high: (place[(sides & flag) > 0].astype(np.int64)[:, None] - np.arange(low, high)).ravel()  # noqa: E731,B023
            start = np.unique(np.concatenate([at(2, 0, side - near + 1), at(1, side - near + 1, side + 1)]))
            start = start[(start >= 0) & (start + depth <= len(raw))]
            if (doc, text) in known:  # a window in a repeated stretch is no first one, and is marked
                a, b = known[doc, text]
                inside = np.searchsorted(a, start, side="right") - 1
                start = start[(inside < 0) | (b[inside] < start + depth)]
            w1 = FIRST.spans(FIRST.prefix(raw), start, start + depth)
            w2 = (SECOND.spans(SECOND.prefix(raw), start, start + depth) >> np.uint64(32)).astype(np.uint32)
            parts.append((w1, w2, np.full(len(start), doc, dtype=np.int64), np.full(len(start), text, dtype=np.uint32), start.astype(np.uint32)))
        if not parts:
            return pa.Table.from_batches([X.rows([])])
        w1, w2, doc, text, start, out = *(np.concatenate(c) for c in zip(*parts, strict=True)), []
        order, begins = groups(w1, w2, doc, text, start)
        order = order[begins]
        w1, w2, doc, text, start = (x[order] for x in (w1, w2, doc, text, start))
        first = np.ones(len(w1), dtype=bool)
        first[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
        out = _marks(doc[~first], text[~first], start[~first], start[~first].astype(np.int64) + depth, buckets, depth)
        w1, w2, doc, text, start = (x[first] for x in (w1, w2, doc, text, start))
        out += [(b, 0, X.pack(w1[at], w2[at], *owners(doc[at], text[at]), X.small(start[at]))) for b, at in X.by_bucket(X.bucket_of(w1, buckets))]
        return pa.Table.from_batches([X.rows(out)])

    def full_depth(table: pa.Table) -> pa.Table:
        out = passed(table, 1)
        if not (parts := X.cells(table, 0)):
            return pa.Table.from_batches([X.rows(out)])
        w1, w2, start = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 5))
        doc, text = disowned(parts, 2)
        order, begins = groups(w1, w2)
        again = np.ones(len(order), dtype=bool)
        if len(order):
            order = np.lexsort((start, text, doc, w2, w1))
            again = ~begins
            # the same window of rows alike is no repeat of itself
            again[1:] &= (doc[order][1:] != doc[order][:-1]) | (text[order][1:] != text[order][:-1]) | (start[order][1:] != start[order][:-1])
        at = order[again]
        out += _marks(doc[at], text[at], start[at], start[at].astype(np.int64) + depth, buckets, depth)
        return pa.Table.from_batches([X.rows(out)])

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(table: pa.Table) -> pa.Table:
        marks = by_key(merged(*X.joined(X.cells(table, 1), _MARK)))
        ids_, kept, sizes, spans = [], [], [], []
        for doc, text, raw in texts_of(table):
            start, end = marks.get((doc, text), (_EMPTY, _EMPTY))
            end = np.minimum(end, len(raw))
            keep = np.ones(len(raw), dtype=bool)
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                keep[a:b] = False
            ids_.append(None if doc == NULL_ID else doc)
            kept.append(raw[keep].tobytes() if len(start) else raw.tobytes())
            sizes.append(len(raw))
            spans.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        return pa.table({"doc_id": pa.array(ids_, pa.int64()), "kept_text": pa.array(kept, pa.binary()), "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(spans, span)})

    digits = docs.mapInArrow(deal, X.ROWS).groupBy("bucket").applyInArrow(by_digit, X.ROWS).checkpoint()
    texts = docs.mapInArrow(send_texts, X.ROWS)
    deep = digits.unionByName(texts).groupBy("bucket").applyInArrow(windows, X.ROWS).groupBy("bucket").applyInArrow(full_depth, X.ROWS)
    every = digits.where("kind = 1").unionByName(deep).unionByName(texts)
    return every.groupBy("bucket").applyInArrow(cut, "doc_id long, kept_text binary, n_bytes long, spans array<struct<start:long,end:long>>")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = (F.col("n_bytes") - F.octet_length("kept_text")).cast("long")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_text", 256).alias("kept_sha256"))
