"""Operator 6: an exact n-gram Jaccard join as a blocked sparse matrix product.

A document is the set of its distinct ``words``-word shingles (fewer words: the whole sequence); documents
of equal sets are one node, named by a hash of the set. Two nodes link at similarity ``per_cent`` or more.

1. *Candidates by size-derived bounds.* In any fixed order of shingles, linked sets of n shingles share one
   of their first ``n - ceil(t n) + 1``. Only these go to the shingle's bucket, shingles of many documents
   ordered last (found in one counting pass; at most ``mean size / HEAVY`` of them). A list there holds the
   sets with that shingle; it is cut where sizes differ too much, and pairs beyond the positional bound are
   discarded. All members of a list are assigned to the block of the list's least member.
2. *A bound by bits.* A set's bitmap holds, for each of about n places, the parity of the shingles hashed there. Bitmaps
   of two sets differ in no more places than the sets in shingles, so members whose bitmap is too far from
   every other in the block are discarded, exactly. Bitmaps are rows of their own, so no text moves for this.
3. *Blocks.* A block receives its members' texts once each and multiplies its document-by-shingle matrix row
   by row: a row's overlap counts are accumulated from the postings of sets not yet reached, those at the
   threshold are linked and reached, and reached sets leave the postings. Every pair that the bounds admit
   shares a block, and a pair is only skipped if a path of links already joins it.
4. *Large blocks* are split by a hash of the member, each part with the block's first set. Members not joined
   to that set in their part are compared with all parts in a second step; those joined need no more. There
   their bitmaps go to the parts first, and texts only where a bitmap is near enough.
5. Components of the links; each document takes the least doc_id of its component.

Shingles and sets are compared by 64-bit hashes.

Defined results: null or empty texts and texts of white space only have no shingles and are alone; a null
``doc_id`` stays null and counts as larger than any other in a component; repeated rows each give a row;
other columns are ignored; an empty table gives no rows.
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
from lectern.llm.components import connected
from lectern.llm.lm_score import summed
from lectern.llm.textkernel import runs, runs_of, shingles, splitmix, words

#: A shingle of this share of the documents or more is ordered last.
HEAVY = 1 / 2500
#: Longest list of which all pairs are held against the positional bound.
CLOSE = 24
#: Members of a block's part.
PART = 2048
#: Bytes of text whose entries share a bucket; a task holds one bucket at a time.
BUCKET_BYTES = 8 << 20
#: Bytes of text whose entries a task holds before it sends them.
FLUSH = 8 << 20
_EMPTY = np.zeros(0, dtype=np.uint64)


def sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle) of distinct shingles by row and hash; each row's size and the hash of its set."""
    row, h = shingles(*words(data, off)[:2], n)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[keep], h[keep]
    size = np.bincount(row, minlength=len(off) - 1)
    name = np.zeros(len(off) - 1, dtype=np.uint64)
    if len(row):
        at = np.flatnonzero(np.diff(row, prepend=-1))
        name[row[at]] = np.add.reduceat(splitmix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
    return row, h, size, splitmix(name + size.astype(np.uint64))


def admitted(a, b, pa_, pb, per_cent: int):
    """Whether sets of a and b shingles that first meet at places pa_ and pb can be similar enough."""
    most = np.minimum(a - pa_, b - pb)
    return (100 + per_cent) * most >= per_cent * (a + b)


def lists(h: np.ndarray, name: np.ndarray, size: np.ndarray, place: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (least member, member) of the lists of equal h."""
    order = np.lexsort((name, h))
    h, name, size, place = h[order], name[order], size[order], place[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (name[1:] != name[:-1])
    h, name, size, place = h[keep], name[keep], size[keep], place[keep]

    def together(h):
        same = h[1:] == h[:-1]
        return np.append(same, False) | np.insert(same, 0, False)

    many = together(h)
    h, name, size, place = h[many], name[many], size[many], place[many]
    if not len(h):
        return _EMPTY, _EMPTY
    by_size = np.lexsort((size, h))
    h, name, size, place = h[by_size], name[by_size], size[by_size], place[by_size]
    # similar sizes follow each other: a list falls apart where neighbours' sizes do
    part = np.cumsum(np.insert((h[1:] != h[:-1]) | (100 * size[:-1] < per_cent * size[1:]), 0, True))
    alive = np.zeros(len(h), dtype=bool)
    for d in range(1, CLOSE + 1):  # short lists: all pairs; long ones keep every member
        if len(h) <= d:
            break
        ok = (part[d:] == part[:-d]) & admitted(size[:-d], size[d:], place[:-d], place[d:], per_cent)
        alive[d:] |= ok
        alive[:-d] |= ok
    alive |= (np.bincount(part) > CLOSE)[part]
    part, name = part[alive], name[alive]
    if not len(part):
        return _EMPTY, _EMPTY
    order = np.lexsort((name, part))
    part, name = part[order], name[order]
    begin = np.insert(part[1:] != part[:-1], 0, True)
    least = name[np.flatnonzero(begin)][np.cumsum(begin) - 1]
    real = least != name
    pairs = np.unique(np.column_stack([least[real], name[real]]), axis=0) if real.any() else np.zeros((0, 2), np.uint64)
    return pairs[:, 0], pairs[:, 1]


def bitmap(h: np.ndarray) -> bytes:
    """Parities of a set's shingles by place; the places are the least power of two from 256 and from the set's size on."""
    bits = max(8, int(len(h) - 1).bit_length())
    return np.packbits((np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).astype(bool)).tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap with fewer places: neighbouring places share one, and their parities add up."""
    b = np.unpackbits(bits)
    return np.packbits(np.bitwise_xor.reduce(b.reshape(size * 8, -1), axis=1))


def within_bits(maps: list[np.ndarray], size: np.ndarray, per_cent: int, against: int | None = None, names: np.ndarray | None = None) -> np.ndarray:
    """The sets, by bitmap and size, that may be similar enough to another one; with the first set, if any is.
    With ``against``: those of the first ``against`` sets near one of the rest that has another name, and these."""
    m = len(maps)
    near = np.zeros(m, dtype=bool)
    width = np.array([len(x) for x in maps])
    levels = {int(w): {int(v): np.stack([_folded(maps[i], int(w)) if v > w else maps[i] for i in np.flatnonzero(width == v)]) for v in np.unique(width) if v >= w} for w in np.unique(width)}

    def close(a: int, others: np.ndarray) -> np.ndarray:
        """Those of the others within bounds of a."""
        out = np.zeros(len(others), dtype=bool)
        limit = (100 - per_cent) * (size[a] + size[others]) // (100 + per_cent)
        for w in np.unique(width[others]):
            at = np.flatnonzero(width[others] == w)
            low = int(min(w, width[a]))
            table, mine = levels[low][int(w)], levels[low][int(width[a])]
            row = mine[place[a]]
            out[at] = np.bitwise_count(table[place[others[at]]] ^ row).sum(axis=1, dtype=np.int64) <= limit[at]
        return out & (100 * np.minimum(size[a], size[others]) >= per_cent * np.maximum(size[a], size[others]))

    place = np.zeros(m, dtype=np.int64)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        place[at] = np.arange(len(at))
    if against is not None:
        rest = np.arange(against, m)
        for a in range(against):
            hit = close(a, rest) & (names[rest] != names[a])
            near[rest[hit]] = True
            near[a] = hit.any()
        return near
    hit = close(0, np.arange(1, m))
    near[1:] = hit
    for a in np.flatnonzero(~near[1:]) + 1:
        if not near[a]:
            others = np.delete(np.arange(m), [0, a])
            ok = others[close(a, others)]
            near[ok] = True
            near[a] = len(ok) > 0
    near[0] = near.any()
    return near


def linked(rows: list[np.ndarray], per_cent: int, start: int = 0, against: int | None = None) -> list[tuple[int, int]]:
    """Links that join all components of the sets, found from ``start`` on. With ``against``, all links of the first ``against`` sets with the rest instead."""
    m = len(rows)
    size = np.array([len(r) for r in rows], dtype=np.int64)
    every = np.concatenate(rows) if m else _EMPTY
    _, code = np.unique(every, return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    bounds = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(code, kind="stable")
    top = int(code.max()) + 1 if len(code) else 0

    def postings(alive):
        kept = order[alive[owner[order]]]
        return owner[kept], np.searchsorted(code[kept], np.arange(top + 1))

    def overlaps(a, posting, at):
        mine = code[bounds[a] : bounds[a + 1]]
        lo, n = at[mine], at[mine + 1] - at[mine]
        total = int(n.sum())
        if not total:
            return np.zeros(m, dtype=np.int64)
        place = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        return np.bincount(posting[place], minlength=m)

    similar = lambda a, count: (100 + per_cent) * count >= per_cent * (size[a] + size)
    links = []
    if against is not None:
        alive = np.arange(m) >= against
        posting, at = postings(alive)
        for a in range(against):
            links += [(a, int(b)) for b in np.flatnonzero(similar(a, overlaps(a, posting, at)) & alive & (size > 0))]
        return links
    left = np.ones(m, dtype=bool)
    posting, at = postings(left)
    built = m
    for seed in [start, *range(m)]:
        if not left[seed]:
            continue
        left[seed] = False
        todo = [seed]
        while todo and left.any():
            a = todo.pop()
            hit = np.flatnonzero(similar(a, overlaps(a, posting, at)) & left)
            links += [(a, int(b)) for b in hit]
            left[hit] = False
            todo += hit.tolist()
            if 2 * left.sum() < built:
                built = int(left.sum())
                posting, at = postings(left)
    return links


def _heavy(docs: DataFrame, n: int) -> np.ndarray:
    """Shingles of at least the share HEAVY of the documents, by count. Which are found only changes the order, never the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, seen = _EMPTY, np.zeros(0, dtype=np.int64), 0
        for batch in batches:
            for i, j, data, off in runs(batch, most=FLUSH):
                h = np.concatenate([sets(d, o, n)[1] for _, _, d, o in runs_of(data, off)])
                h.sort()
                at = np.flatnonzero(np.insert(h[1:] != h[:-1], 0, True)) if len(h) else np.zeros(0, np.int64)
                c = np.diff(np.append(at, len(h)))
                seen += j - i
                often = c >= max(4, HEAVY * (j - i))
                key, count = summed(np.concatenate([key, h[at][often]]), np.concatenate([count, c[often]]))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count), pa.array(np.full(len(key), seen))], names=["h", "c", "seen"])

    found = docs.mapInArrow(run, "h long, c long, seen long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen")).where(F.col("c") >= HEAVY * F.col("seen"))
    got = found.toArrow()
    h, c = got.column("h").to_numpy().view(np.uint64), got.column("c").to_numpy()
    return h[np.lexsort((h, c))]


def jaccard_components(docs: DataFrame, n: int = 5, per_cent: int = 75, bucket_bytes: int = BUCKET_BYTES, part: int = PART) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id (the hash of the document's set) and class_id (the least set_id of the component; null without shingles) for every row."""
    spark = docs.sparkSession
    checkpoints.ensure(spark)
    docs = _named(docs)
    buckets = X.bucket_count(X.text_size(docs), bucket_bytes)
    heavy = _heavy(docs.select("text"), n)
    shared = spark.sparkContext.broadcast((np.sort(heavy), np.argsort(heavy, kind="stable")))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = shared.value
        for batch in batches:
            doc_all, anon_all, seen = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), set()
            for first, end, data, off in runs(batch, most=FLUSH):
                yield flush(doc_all[first:end], anon_all[first:end].astype(np.uint8), [prefixes(d, o, i, keys, ranks, seen) for i, _, d, o in runs_of(data, off)])

    def prefixes(data, off, i, keys, ranks, seen):
        """What a run sends: (shingle, row, place) of prefixes, each row's size and set, and bitmaps."""
        row, h, size, name = sets(data, off, n)
        fresh = np.zeros(len(size), dtype=bool)
        for k, s in enumerate(name.tolist()):
            if s not in seen:
                seen.add(s)
                fresh[k] = True
        rank = np.zeros(len(h), dtype=np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            rank = np.where(keys[at] == h, ranks[at] + 1, 0)
        order = np.lexsort((h, rank, row))
        row, h = row[order], h[order]
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        place = np.arange(len(row)) - begin[row]
        keep = fresh[row] & (place <= size[row] - -(-per_cent * size[row] // 100))
        bits = [bitmap(x) for x in np.split(h, begin[1:])] if len(size) else []
        return h[keep], row[keep] + i, X.small(place[keep]), size, name, np.array(bits, dtype=object)

    def flush(doc, anon, parts):
        h, row, place, size, name, bits = (np.concatenate(c) for c in zip(*parts, strict=True))
        anywhere = splitmix(doc.view(np.uint64) ^ splitmix(np.arange(len(doc), dtype=np.uint64)))  # rows need no meeting place
        out = [(b, 1, X.pack(doc[at], name[at], size[at].astype(np.uint32), anon[at], np.frombuffer(b"".join(bits[at]), dtype=np.uint8))) for b, at in X.by_bucket(X.bucket_of(anywhere, buckets))]
        for b, at in X.by_bucket(X.bucket_of(h, buckets)):
            used, inverse = np.unique(row[at], return_inverse=True)
            out.append((b, 0, X.pack(h[at], X.small(inverse), X.small(place[at]), name[used], size[used].astype(np.uint32))))
        return X.rows(out)

    def candidates(table: pa.Table) -> pa.Table:
        parts = X.cells(table, 0)
        a = b = _EMPTY
        if parts:
            first = np.cumsum([0] + [len(p[3]) for p in parts])
            d = np.concatenate([p[1].astype(np.int64) + f for p, f in zip(parts, first, strict=False)])
            h, place, name, size = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3, 4))
            a, b = lists(h, name[d], size[d].astype(np.int64), place.astype(np.int64), per_cent)
        doc, name, size, anon, raw = X.joined(X.cells(table, 1), ("<i8", "<u8", "<u4", "u1", "u1"))
        width = np.array([1 << max(8, int(x - 1).bit_length()) >> 3 for x in size.tolist()], dtype=np.int64)
        ends = np.cumsum(width)
        edges = np.concatenate([np.zeros(len(a) + 1, dtype=np.int32), ends.astype(np.int32)])
        bits = pa.BinaryArray.from_buffers(pa.binary(), len(a) + len(doc), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw))])
        kind = np.concatenate([np.zeros(len(a), dtype=np.int32), 1 + anon.astype(np.int32)])
        return pa.table({"kind": kind, "x": np.concatenate([a.view(np.int64), doc]), "y": np.concatenate([b.view(np.int64), name.view(np.int64)]), "n": np.concatenate([np.zeros(len(a), np.int64), size.astype(np.int64)]), "bits": bits})

    found = docs.mapInArrow(entries, X.ROWS).groupBy("bucket").applyInArrow(candidates, "kind int, x long, y long, n long, bits binary").checkpoint()
    rows = found.where("kind > 0").select(F.col("x").alias("key"), (F.col("kind") == 2).alias("anon"), F.col("y").alias("set_id"), "n")
    pairs = found.where("kind = 0").select(F.col("x").alias("center"), F.col("y").alias("member")).distinct()
    named = rows.where("n > 0").groupBy("set_id").agg(F.min(F.struct("anon", "key")).alias("who"))
    maps = found.where("kind > 0 AND n > 0").groupBy(F.col("y").alias("member")).agg(F.max("n").alias("n"), F.max("bits").alias("bits"))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([z.compress((t.as_py() or "").encode()) for t in batch.column(2)], pa.binary())], names=["key", "anon", "z"])

    texts = docs.mapInArrow(compress, "key long, anon boolean, z binary")
    sizes = pairs.groupBy("center").agg(F.count("*").alias("m")).select("center", (1 + F.floor((F.col("m") - 1) / part)).cast("int").alias("k")).checkpoint()
    cut = sizes.where("k > 1")
    dealt = pairs.join(cut, "center", "left").select("center", F.coalesce("k", F.lit(1)).alias("k"), F.pmod(F.xxhash64("member"), F.coalesce("k", F.lit(1))).cast("int").alias("part"), "member")
    seats = dealt.unionByName(sizes.select("center", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"), F.col("center").alias("member")))

    def admissible(table: pa.Table) -> pa.Table:
        """Each block's members with ``near``: whether a bitmap there is near theirs. Asking members come first and are held against the rest."""
        c, p, asks, member, n_ = (table.column(x).to_numpy() for x in ("center", "part", "asks", "member", "n"))
        bits = table.column("bits").combine_chunks()
        order = np.lexsort((member, member != c, -asks, p, c))
        edge = np.concatenate([[0], np.flatnonzero((c[order][1:] != c[order][:-1]) | (p[order][1:] != p[order][:-1])) + 1, [len(c)]])
        near = np.zeros(len(c), dtype=bool)
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            at = order[a:b]
            if b - a > 1:
                asking = int(asks[at].sum())
                near[at] = within_bits([np.frombuffer(bits[int(i)].as_buffer(), dtype=np.uint8) for i in at], n_[at], per_cent, asking or None, member[at])
        return table.select(["center", "k", "part", "member", "asks"]).append_column("near", pa.array(near))

    def judged(seats: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("center", "part"), F.lit(buckets * 4))
        return seats.join(maps, "member").withColumn("bucket", block).groupBy("bucket").applyInArrow(admissible, "center long, k int, part int, member long, asks int, near boolean").checkpoint()

    seats = judged(seats.withColumn("asks", F.lit(0)))

    def with_text(seats: DataFrame) -> DataFrame:
        one = seats.select("member").distinct().join(named, F.col("member") == F.col("set_id")).select("member", "who.anon", "who.key")
        text = one.join(texts, ["anon", "key"]).select("member", "z")
        blocks = F.pmod(F.xxhash64("center", "part"), F.lit(buckets * 16)).alias("bucket")
        return seats.join(text, "member").select(blocks, "center", "part", "k", "asks", "member", "z")

    def multiply(table: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        cols = {c: table.column(c).to_numpy() for c in ("center", "part", "k", "asks", "member")}
        order = np.lexsort((cols["member"], cols["member"] != cols["center"], -cols["asks"], cols["part"], cols["center"]))
        c, p = cols["center"][order], cols["part"][order]
        edge = np.concatenate([[0], np.flatnonzero((c[1:] != c[:-1]) | (p[1:] != p[:-1])) + 1, [len(c)]])
        out_a, out_b, out_kind, known = [], [], [], {}
        z = table.column("z")
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            names, rows_, asks = [], [], 0
            for i in order[lo:hi]:
                name, ask = int(cols["member"][i]), int(cols["asks"][i])
                if names and name in names[-1:] and asks in (0, len(names)) and not ask:
                    continue
                if name not in known:
                    raw = np.frombuffer(unzip.decompress(z[int(i)].as_py()), dtype=np.uint8)
                    _, h, _, set_name = sets(raw, np.array([0, len(raw)]), n)
                    if int(set_name.view(np.int64)[0]) != name:
                        continue  # another row of the same key
                    known[name] = h
                names.append(name)
                rows_.append(known[name])
                asks += ask
            known = {} if sum(map(len, known.values())) > 4_000_000 else known
            if len(names) < 2:
                continue
            if asks:
                for a, b in linked(rows_, per_cent, against=asks):
                    out_a.append(names[a])
                    out_b.append(names[b])
                    out_kind.append(0)
                continue
            links = linked(rows_, per_cent)
            out_a += [names[a] for a, _ in links]
            out_b += [names[b] for _, b in links]
            out_kind += [0] * len(links)
            if cols["k"][order[lo]] > 1:
                joined_ = {0}
                for a, b in links:  # in the order of the search, so one pass is enough
                    if a in joined_:
                        joined_.add(b)
                for i in range(len(names)):
                    if i not in joined_:
                        out_a.append(int(c[lo]))
                        out_b.append(names[i])
                        out_kind.append(1)
        return pa.table({"kind": pa.array(out_kind, pa.int32()), "a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    first = with_text(seats.where("near")).groupBy("bucket").applyInArrow(multiply, "kind int, a long, b long").checkpoint()
    links = first.where("kind = 0").select("a", "b")
    alone = seats.where("k > 1 AND NOT near AND member <> center").select("center", "member")
    apart = first.where("kind = 1").select(F.col("a").alias("center"), F.col("b").alias("member")).unionByName(alone)
    if apart.head(1):
        asking = apart.join(cut, "center").select("center", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"), "member", F.lit(1).alias("asks"))
        again = seats.join(apart.select("center").distinct(), "center", "left_semi").select("center", "k", "part", "member", "asks").unionByName(asking)
        again = judged(again).where("near")
        links = links.unionByName(with_text(again).groupBy("bucket").applyInArrow(multiply, "kind int, a long, b long").select("a", "b"))
    groups = connected(links)
    labelled = named.join(groups, named["set_id"] == groups["node"], "left").select("set_id", F.coalesce("component", "set_id").alias("class_id"), "who")
    least = labelled.groupBy("class_id").agg(F.min("who").alias("who"))
    classes = labelled.drop("who").join(least, "class_id").select(F.col("set_id").alias("s"), "class_id", F.expr("CASE WHEN NOT who.anon THEN who.key END").alias("component_id"))
    out = rows.join(classes, (F.col("set_id") == F.col("s")) & (F.col("n") > 0), "left")
    own = F.when(~F.col("anon"), F.col("key"))
    return out.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(own).alias("component_id"), "set_id", "class_id")


def _named(docs: DataFrame) -> DataFrame:
    """(key, anon, text): the doc_id, or without one a hash of the text, so that such rows share no key."""
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.coalesce(doc, F.xxhash64(text)).alias("key"), doc.isNull().alias("anon"), text.alias("text"))


def set_ids(docs: DataFrame, n: int = 5) -> DataFrame:
    """The documents with ``set_id`` as ``jaccard_components`` gives it, null for sets without shingles."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sets(data, off, n)[2:] for _, _, data, off in runs(batch, batch.schema.names[at])]
            size, name = (np.concatenate([np.zeros(0, t), *c]) for t, c in zip((np.int64, np.uint64), zip(*got, strict=True), strict=True)) if got else (np.zeros(0, np.int64), _EMPTY)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name.astype(np.uint64).view(np.int64), mask=size == 0)], names=[*batch.schema.names, "set_id"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `set_id` long")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
