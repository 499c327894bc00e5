"""Operator 4: near-duplicate vectors by NN-descent.

Equal vectors are one node with a count. Nodes are numbered along the order of a first random tree, and stretches of
``NODES_PER_BUCKET`` of that order share a bucket, so that most neighbours of a node lie in its bucket or in few others.
Each node keeps a list of its ``k`` nearest nodes found so far.

1. *Start.* For each of ``trees`` random trees, nodes are range-partitioned and sorted by a code of hyperplane
   signs and a projection (one sort for all trees), and each takes neighbours from its block of that order. The order has no
   ties to speak of, so that a very common direction is spread over tasks.
2. *Rounds.* A node sends its vector (a byte for each component) to the nodes on its list and to up to ``k``
   nodes that list it, once to each of their buckets; each node compares the vectors it got with each other, but for those that
   were both there before, and sends a pair to either
   end whose list it betters. This is the neighbours-of-neighbours join; it ends when few lists change.
3. *Links.* Listed pairs near the threshold are computed in double precision; those at or above it are links.
4. *Enlarging.* Where a list is full of links there may be more, in its component of links or in others. A link
   between components that no list holds has a full list at either end; so nodes of full lists get a second list,
   of the nearest nodes of other components, by the same rounds. Links found there join components, and this is repeated
   until there is none. Then each component is compared in blocks of ``BLOCK``, each pair of blocks once, which makes its lists as long as they need to
   be; only counts leave a task, never the pairs.
5. *Audit.* ``audit`` nodes of all and as many of the linked ones (or the root of their number, if that is more, 8,192 at most), those
   least by hash, are compared with all; if the mean over nodes of the share of links found is less than ``recall``,
   lists are made twice as long and more rounds follow. The recall is logged; below ``LEAST_RECALL`` there is no result.

Defined results: vectors that are null, empty or zero or hold null or non-finite components have no links and are
alone; vectors of different lengths don't link; repeated rows are vectors of their own and link with
each other; a null ``vec_id`` stays null, counts as larger than any other, and is kept only in a component of nulls; other columns are
ignored; an empty table gives no rows. Equal vectors are recognised by a 64-bit hash.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import checkpoints
from lectern.llm import exchange as X
from lectern.llm.components import connected
from lectern.llm.lm_score import find
from lectern.llm.textkernel import splitmix

NODES_PER_BUCKET = 4096
SORT_BLOCK = 96
BLOCK = 4096
#: Rows of a block that are multiplied at a time.
STRIP = 256
LEAST_RECALL = 0.9
#: Linked nodes of an audit at most; their vectors are sent to all tasks.
MOST_AUDITED = 8192
_LOG = logging.getLogger(__name__)


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of a list column for each length of vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False))
    out = []
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        x = np.asarray(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(at), int(d))
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares of extreme components stay finite
        out.append((at, x / np.linalg.norm(x, axis=1, keepdims=True)))
    return out


def _quantised(x: np.ndarray) -> np.ndarray:
    """A byte for each component."""
    return np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)


def _in_bytes(column: pa.Array) -> pa.Array:
    out = np.empty(len(column), dtype=object)
    for at, x in _matrix(column):
        out[at] = [row.tobytes() for row in _quantised(x)]
    return pa.array(out.tolist(), pa.binary())


def _of_bytes(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The inverse of ``_in_bytes``, as ``_matrix`` gives it."""
    raw = column.to_pylist()
    size, out = np.array([len(r) for r in raw]), []
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        x = np.frombuffer(b"".join(raw[i] for i in at), dtype=np.int8).reshape(len(at), int(d)).astype(np.float32)
        out.append((at, x / np.linalg.norm(x, axis=1, keepdims=True)))
    return out


def _bucket(node: np.ndarray) -> np.ndarray:
    return node // NODES_PER_BUCKET


def _best(node: np.ndarray, other: np.ndarray, sim: np.ndarray, apart: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct others of each node in its own component and the k best apart from it, by node and then falling similarity."""
    order = np.lexsort((other, -sim, apart, node))
    node, other, sim, apart = node[order], other[order], sim[order], apart[order]
    pair = np.lexsort((np.arange(len(node)), other, node))
    first = np.ones(len(node), dtype=bool)
    first[pair[1:]] = (node[pair][1:] != node[pair][:-1]) | (other[pair][1:] != other[pair][:-1])
    node, other, sim, apart = node[first], other[first], sim[first], apart[first]
    start = np.flatnonzero(np.insert((node[1:] != node[:-1]) | (apart[1:] != apart[:-1]), 0, True)) if len(node) else np.zeros(0, np.int64)
    rank = np.arange(len(node)) - np.repeat(start, np.diff(np.append(start, len(node))))
    return node[rank < k], other[rank < k], sim[rank < k], apart[rank < k]


def _codes(column: pa.Array, tree: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A tree's codes: hyperplane signs, and a projection."""
    key, along = np.zeros(len(column), np.int64), np.zeros(len(column))
    for at, x in _matrix(column):
        side = x @ np.random.RandomState(1000 * tree + 7 * x.shape[1]).randn(x.shape[1], bits + 1)
        key[at] = (side[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
        along[at] = side[:, bits]
    return key, along


def _bits(count: int) -> int:
    return max(1, int(np.ceil(np.log2(max(count / SORT_BLOCK, 2)))))


def numbered_nodes(named: DataFrame, count: int) -> DataFrame:
    """``named`` (with a vector ``v``) with the number ``node`` along the order of a tree."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, along = _codes(batch.column(batch.schema.get_field_index("v")), trees_seed, _bits(count))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key), pa.array(along)], names=[*batch.schema.names, "code", "along"])

    trees_seed = 10_000
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema)
    coded = named.mapInArrow(code, f"{schema}, code long, along double")
    placed = coded.repartitionByRange(max(1, -(-count // NODES_PER_BUCKET)), "code", "along").sortWithinPartitions("code", "along", "name")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(np.arange(at, at + batch.num_rows))], names=[*batch.schema.names[:-2], "node"])
            at += batch.num_rows

    return placed.mapInArrow(number, f"{schema}, node long")


def _tree_edges(nodes: DataFrame, trees: int, bits: int, k: int) -> DataFrame:
    """Offers (kind 3) from the blocks of all trees' orders, in one sort."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in range(trees):
                key, along = _codes(batch.column(1), tree, bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, tree)), batch.column(0), _in_bytes(batch.column(1)), pa.array(key), pa.array(along), batch.column(2)], names=["tree", "node", "q", "code", "along", "comp"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for i in range(0, batch.num_rows, SORT_BLOCK):
                part = batch.slice(i, SORT_BLOCK)
                node, comp = part.column(1).to_numpy(), part.column(5).to_numpy()
                for at, x in _of_bytes(part.column(2)):
                    sims, own = x @ x.T, comp[at][:, None] == comp[at][None, :]
                    own_too = own & (node[at][:, None] != node[at][None, :])  # a node may stand in a block for two trees
                    for apart, fits in ((0, own_too), (1, ~own)):
                        if not fits.any():
                            continue
                        some = np.where(fits, sims, -2.0)
                        top = np.argsort(-some, axis=1, kind="stable")[:, : min(k, len(at) - 1)]
                        sim = np.take_along_axis(some, top, 1).ravel()
                        real = sim > -2
                        got.append((np.repeat(node[at], top.shape[1])[real], node[at][top].ravel()[real], sim[real].astype(np.float32), np.full(int(real.sum()), apart, dtype=np.uint8)))
            if got:
                a, b, s, d = _best(*(np.concatenate(c) for c in zip(*got, strict=True)), k)
                yield X.rows([(bucket, 3, X.tight(X.pack(a[at], b[at], s[at], d[at]))) for bucket, at in X.by_bucket(_bucket(a))])

    coded = nodes.select("node", "v", "comp").mapInArrow(code, "tree long, node long, q binary, code long, along double, comp long")
    return coded.repartitionByRange("tree", "code", "along").sortWithinPartitions("tree", "code", "along").mapInArrow(near, X.ROWS)


def nearest_lists(nodes: DataFrame, count: int, k: int, trees: int, rounds: int, before: DataFrame | None = None) -> DataFrame:
    """Cells (kind 4) of (node, other, similarity, whether of another ``comp``): the lists after NN-descent from the trees, or from lists found before."""
    bits = _bits(count)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, comp = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            out = []
            for at, x in _matrix(batch.column(1)):
                q = _quantised(x)
                out += [(b, 0, X.tight(X.pack(node[at][p], comp[at][p], np.ascontiguousarray(q[p]).view(np.uint8).ravel()))) for b, p in X.by_bucket(_bucket(node[at]))]
            yield X.rows(out)

    def cells(table: pa.Table, kind: int) -> list[list[np.ndarray]]:
        return [X.unpack(X.loose(c.as_py())) for x, c in zip(table.column("kind").to_pylist(), table.column("cell"), strict=True) if x == kind]

    def passed(table: pa.Table, *kinds: int) -> list:
        bucket = table.column("bucket")[0].as_py()
        return [(bucket, x, c.as_py()) for x, c in zip(table.column("kind").to_pylist(), table.column("cell"), strict=True) if x in kinds]

    def own_vectors(table: pa.Table) -> list[list[np.ndarray]]:
        """The bucket's vectors, one cell for each length."""
        by_dim: dict[int, list] = {}
        for part in cells(table, 0):
            by_dim.setdefault(len(part[2]) // max(len(part[0]), 1), []).append(part)
        return [[np.concatenate(c) for c in zip(*parts, strict=True)] for _, parts in sorted(by_dim.items())]

    def merge(table: pa.Table) -> pa.Table:
        """Lists (kind 4: node, other, similarity, apart, whether new) from offers (3) and lists; tells each listed node who lists it (kind 1)."""
        bucket = table.column("bucket")[0].as_py()
        old = X.joined(cells(table, 4), ("<i8", "<i8", "<f4", "u1", "u1"))
        offers = X.joined(cells(table, 3), ("<i8", "<i8", "<f4", "u1"))
        node, other, sim, apart = _best(*(np.concatenate(c) for c in zip(offers, old[:4], strict=True)), k)
        pair = lambda a, b: np.rec.fromarrays([a, b], names="a,b")
        fresh = (~np.isin(pair(node, other), pair(old[0], old[1]))).astype(np.uint8)
        out = [(bucket, 0, X.tight(X.pack(*c))) for c in own_vectors(table)] + [(bucket, 4, X.tight(X.pack(node, other, sim, apart, fresh)))]
        order = np.lexsort((node, other))
        node, other, fresh = node[order], other[order], fresh[order]
        out += [(b, 1, X.tight(X.pack(other[at], node[at], fresh[at]))) for b, at in X.by_bucket(_bucket(other))]
        return pa.Table.from_batches([X.rows(out)])

    def send(table: pa.Table) -> pa.Table:
        """Each node's vector (kind 2) to the nodes on its list and to k of those that list it, once to each bucket, with the similarities that its two lists are open to."""
        bucket = table.column("bucket")[0].as_py()
        node, other, sim, apart, fresh = X.joined(cells(table, 4), ("<i8", "<i8", "<f4", "u1", "u1"))
        asked, asker, new = X.joined(cells(table, 1), ("<i8", "<i8", "u1"))
        order = np.lexsort((splitmix(asked.view(np.uint64) ^ splitmix(asker.view(np.uint64))), asked))
        asked, asker, new = asked[order], asker[order], new[order]
        start = np.flatnonzero(np.insert(asked[1:] != asked[:-1], 0, True)) if len(asked) else np.zeros(0, np.int64)
        few = np.arange(len(asked)) - np.repeat(start, np.diff(np.append(start, len(asked)))) < k
        src, to, new = (np.concatenate(c) for c in ((node, asked[few]), (other, asker[few]), (fresh, new[few])))
        order = np.lexsort((1 - new, src, to))  # of the two ways to the same node one is enough, the new one
        src, to, new = src[order], to[order], new[order]
        first = np.ones(len(src), dtype=bool)
        first[1:] = (src[1:] != src[:-1]) | (to[1:] != to[:-1])
        src, to, new = src[first], to[first], new[first]
        open_of = []
        for which in (0, 1):
            mine = apart == which
            members, length = np.unique(node[mine], return_counts=True)
            worst = np.full(len(members), -2, dtype=np.float32)
            full = length == k
            worst[full] = np.minimum.reduceat(sim[mine], np.cumsum(length) - length)[full] if mine.any() else worst[full]
            open_of.append((members, worst))

        def open_(which: int, ids_: np.ndarray) -> np.ndarray:
            members, worst = open_of[which]
            at = find(members, ids_)
            return np.where(at >= 0, worst[at], np.float32(-2)).astype(np.float32) if len(members) else np.full(len(ids_), -2, dtype=np.float32)

        out = passed(table, 4)
        for ids_, comp, raw in cells(table, 0):
            out.append((bucket, 0, X.tight(X.pack(ids_, comp, raw))))
            x, order = raw.reshape(len(ids_), -1), np.argsort(ids_)
            at = find(ids_[order], src)
            mine = np.flatnonzero(at >= 0)
            place, own, away = order[at[mine]], open_(0, ids_), open_(1, ids_)
            for b, p in X.by_bucket(_bucket(to[mine])):
                used, where = np.unique(place[p], return_inverse=True)
                parts = ids_[used], comp[used], own[used], away[used], np.ascontiguousarray(x[used]).ravel()
                out.append((b, 2, X.tight(X.pack(*parts, to[mine][p], X.small(where), new[mine][p]))))
        return pa.Table.from_batches([X.rows(out)])

    def join(table: pa.Table) -> pa.Table:
        """Compares the vectors that met at each node, if one of them is new there; offers (kind 3) the pairs that better a list."""
        out, offers, by_dim = passed(table, 0, 4), [], {}
        for ids_, comp, own, away, raw, to, where, new in cells(table, 2):
            by_dim.setdefault(len(raw) // max(len(ids_), 1), []).append((ids_, comp, own, away, raw.view(np.int8).reshape(len(ids_), -1), to, where.astype(np.int64), new))
        for parts in by_dim.values():
            shift = np.cumsum([0] + [len(p[0]) for p in parts])
            ids_, comp, own, away, x, to, _, new = (np.concatenate(c) for c in zip(*parts, strict=True))
            where = np.concatenate([p[6] + s for p, s in zip(parts, shift, strict=False)])
            x = x.astype(np.float32)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            order = np.argsort(to, kind="stable")
            to, where, new = to[order], where[order], new[order].astype(bool)
            edge = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]])
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if not new[a:b].any():
                    continue
                w = where[a:b]
                sims = x[w] @ x[w].T
                apart = comp[w][:, None] != comp[w][None, :]
                better = sims > np.where(apart, away[w][:, None], own[w][:, None]) + 1e-6
                i, j = np.nonzero(better & (new[a:b][:, None] | new[a:b][None, :]))
                real = ids_[w][i] != ids_[w][j]
                i, j = i[real], j[real]
                offers.append((ids_[w][i], ids_[w][j], sims[i, j], apart[i, j].astype(np.uint8)))
        if offers:
            node, other, sim, apart = _best(*(np.concatenate(c) for c in zip(*offers, strict=True)), k)
            out += [(b, 3, X.tight(X.pack(node[at], other[at], sim[at], apart[at]))) for b, at in X.by_bucket(_bucket(node))]
            out.append((table.column("bucket")[0].as_py(), 5, X.pack(np.array([len(node)], dtype=np.int64))))
        return pa.Table.from_batches([X.rows(out)])

    def offered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(X.unpack(c.as_py())[0][0]) for c in batch.column(0)], pa.int64())], names=["n"])

    state = nodes.select("node", "v", "comp").mapInArrow(vectors, X.ROWS)
    if trees:
        state = state.unionByName(_tree_edges(nodes, trees, bits, k))
    if before is not None:
        state = state.unionByName(before)
    for _ in range(rounds):
        merged_ = state.groupBy("bucket").applyInArrow(merge, X.ROWS)
        sent = merged_.groupBy("bucket").applyInArrow(send, X.ROWS)
        state = sent.groupBy("bucket").applyInArrow(join, X.ROWS).checkpoint()
        offers = state.where("kind = 5").select("cell").mapInArrow(offered, "n long").agg(F.sum("n")).first()[0] or 0
        if offers < 0.002 * k * count:
            break
    return state.groupBy("bucket").applyInArrow(merge, X.ROWS).where("kind = 4").checkpoint()


def near_duplicates(table: DataFrame, threshold: float = 0.9, k: int = 12, trees: int = 8, rounds: int = 6, audit: int = 512, recall: float = 0.97) -> tuple[DataFrame, float]:
    """(vec_id, n_links, component_id, kept for every row, the measured recall)."""
    spark = table.sparkSession
    checkpoints.ensure(spark)
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), good.alias("good")).withColumn("name", F.when(F.col("good"), F.xxhash64(F.transform("v", lambda x: x + F.lit(0.0)))))
    named = rows.where("good").groupBy("name").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v")).checkpoint()
    count = named.count()
    nodes = numbered_nodes(named, count).withColumn("comp", F.col("node")).checkpoint()
    measured, lists = 1.0, None
    while True:
        lists = nearest_lists(nodes, count, k, trees if lists is None else 0, rounds, lists.where("kind = 4") if lists is not None else None)

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cell in batch.column(0):
                    node, other, sim, apart, _ = X.unpack(X.loose(cell.as_py()))
                    at = (sim >= threshold - 0.04) & (apart == 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node, other)[at]), pa.array(np.maximum(node, other)[at])], names=["a", "b"])

        def full(batches: Iterator[pa.RecordBatch], k=k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cell in batch.column(0):
                    node, _, sim, _, _ = X.unpack(X.loose(cell.as_py()))
                    member, n = np.unique(node[sim >= threshold - 0.04], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(member[n >= k])], names=["node"])

        one, two = (nodes.select(F.col("node").alias(n), F.col("v").alias(f"v{n}")) for n in "ab")

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = np.zeros(batch.num_rows, dtype=bool)
                for at, x in _matrix(batch.column(2)):
                    for at2, y in _matrix(batch.column(3).take(pa.array(at))):
                        if x.shape[1] == y.shape[1]:
                            ok[at[at2]] = np.einsum("ij,ij->i", x[at2], y) >= threshold
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

        def links_of(lists: DataFrame) -> DataFrame:
            listed = lists.where("kind = 4").select("cell").mapInArrow(close, "a long, b long").distinct()
            return listed.join(one, "a").join(two, "b").select("a", "b", "va", "vb").mapInArrow(exact, "a long, b long").checkpoint()

        links = links_of(lists)
        groups = connected(links).checkpoint()
        saturated = nodes.drop("comp").join(lists.where("kind = 4").select("cell").mapInArrow(full, "node long"), "node", "left_semi").checkpoint()
        while True:
            parted = saturated.join(groups, "node", "left").select("node", "v", F.coalesce("component", "node").alias("comp")).checkpoint()
            many = parted.agg(F.count("*"), F.min("comp"), F.max("comp")).first()
            if not many[0] or many[1] == many[2]:
                break
            across = links_of(nearest_lists(parted, many[0], k, trees, rounds))
            if not across.head(1):
                break
            links = links.unionByName(across)
            groups = connected(links).checkpoint()
        sizes = groups.groupBy("component").agg(F.count("*").alias("m")).select("component", (1 + F.floor((F.col("m") - 1) / BLOCK)).cast("int").alias("parts"))
        member = groups.join(sizes, "component").join(nodes, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        # a member meets every part of its component, in the block of the two parts, in order; x is the side of the first
        both = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
            "component", "node", "copies", "v", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), (F.col("part") <= F.col("other")).alias("first")
        )
        block_bucket = F.pmod(F.xxhash64("component", "x", "y"), F.lit(max(32, count // 512)))

        def enlarge(t: pa.Table) -> pa.Table:
            cols = {c: t.column(c).to_numpy() for c in ("component", "x", "y", "first", "node", "copies")}
            order = np.lexsort((cols["node"], ~cols["first"], cols["y"], cols["x"], cols["component"]))
            change = np.zeros(len(order), dtype=bool)
            for c in ("component", "x", "y"):
                change[1:] |= cols[c][order][1:] != cols[c][order][:-1]
            edge = np.concatenate([[0], np.flatnonzero(change), [len(order)]])
            nodes_, found = [], []
            vectors = t.column("v").combine_chunks()
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                at = order[a:b]
                same = cols["x"][at[0]] == cols["y"][at[0]]
                one, two = (at, at) if same else (at[cols["first"][at]], at[~cols["first"][at]])
                for ix, mx in _matrix(vectors.take(pa.array(one))):
                    for iy, my in _matrix(vectors.take(pa.array(two))):
                        if mx.shape[1] != my.shape[1]:
                            continue
                        of_x, of_y = one[ix], two[iy]
                        counted = np.zeros(len(iy), dtype=np.int64)
                        for k_ in range(0, len(ix), STRIP):
                            strip = slice(k_, k_ + STRIP)
                            near = (mx[strip] @ my.T >= threshold) & (cols["node"][of_x[strip]][:, None] != cols["node"][of_y][None, :])
                            nodes_.append(cols["node"][of_x[strip]])
                            found.append(near @ cols["copies"][of_y])
                            counted += cols["copies"][of_x[strip]] @ near
                        if not same:
                            nodes_.append(cols["node"][of_y])
                            found.append(counted)
            return pa.table({"node": np.concatenate(nodes_) if nodes_ else np.zeros(0, np.int64), "found": np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)})

        near = both.withColumn("bucket", block_bucket).groupBy("bucket").applyInArrow(enlarge, "node long, found long").groupBy("node").agg(F.sum("found").alias("found"))
        least = groups.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
        classes = groups.join(least, "component").select("node", "component_id").join(near, "node", "left").select("node", "component_id", F.coalesce("found", F.lit(0)).alias("found")).checkpoint()
        # the audit: a bounded number of nodes against all of them
        by_hash = [F.xxhash64("node"), F.col("node")]
        linked = nodes.join(classes, "node", "left_semi")
        least_by_hash = lambda df, n: df.select("node", "v").orderBy(*by_hash).limit(n)
        some = least_by_hash(nodes, audit).union(least_by_hash(linked, min(MOST_AUDITED, max(audit, math.isqrt(classes.count())))))
        asked = some.dropDuplicates(["node"]).collect()
        shared = spark.sparkContext.broadcast(pa.table({"node": pa.array([r["node"] for r in asked], pa.int64()), "v": pa.array([r["v"] for r in asked], pa.list_(pa.float64()))}))

        def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ask = shared.value
            node, asked_ = ask.column("node").to_numpy(), _matrix(ask.column("v"))
            total = np.zeros(len(node), dtype=np.int64)
            for batch in batches:
                for at, x in asked_:
                    for at2, y in _matrix(batch.column(1)):
                        if x.shape[1] == y.shape[1]:
                            near_ = (x @ y.T >= threshold) & (node[at][:, None] != batch.column(0).to_numpy()[at2][None, :])
                            total[at] += near_ @ batch.column(2).to_numpy()[at2]
            # one row for each audited node and task
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(total)], names=["node", "true"])

        true = nodes.select("node", "v", "copies").mapInArrow(truth, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
        share = F.coalesce("found", F.lit(0)) / F.col("true")
        got = true.where(F.col("true") > 0).join(classes, "node", "left").agg(F.avg(share)).first()[0]
        measured = 1.0 if got is None else got
        _LOG.info("near_duplicates: recall %.4f of audited nodes with lists of %d", measured, k)
        if measured >= recall or k >= count:
            break
        k, rounds = 2 * k, rounds + 2
    if measured < LEAST_RECALL:
        raise RuntimeError(f"only {measured:.3f} of the audited nodes' links were found")
    per_node = nodes.select("node", "name", "least", "copies").join(classes, "node", "left").select("name", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.select("vec_id", "name").join(per_node, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")), measured


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]
