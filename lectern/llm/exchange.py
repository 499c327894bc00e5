"""Exchanges of packed arrays.

A mapper packs its entries by bucket into binary cells, so that a shuffle moves few, large rows
without per-entry overhead in the JVM; ``groupBy("bucket").applyInArrow`` then sees a bucket whole.
The number of buckets follows the input's bytes, so a bucket's size doesn't grow with the data.
Keys that may be hot are combined before they are packed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "bucket long, kind int, cell binary"
ROWS_ARROW = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("cell", pa.binary())])
#: Bytes of text whose entries share a bucket.
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 16

_CODES = {np.dtype(t): i for i, t in enumerate(("<u8", "<i8", "<u4", "<i4", "<f8", "<u2", "u1", "<f4"))}
_TYPES = {i: t for t, i in _CODES.items()}


def pack(*arrays: np.ndarray) -> bytes:
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<BI", _CODES[a.dtype], len(a)) for a in arrays)
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def small(a: np.ndarray) -> np.ndarray:
    """The same numbers, none negative, in the narrowest type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<i8")


def unpack(cell: bytes) -> list[np.ndarray]:
    n, at = cell[0], 1
    heads = []
    for _ in range(n):
        heads.append(struct.unpack_from("<BI", cell, at))
        at += 5
    out = []
    for code, size in heads:
        t = _TYPES[code]
        out.append(np.frombuffer(cell, dtype=t, count=size, offset=at))
        at += size * t.itemsize
    return out


def planes(a: np.ndarray) -> list[np.ndarray]:
    """Numbers, none negative, as one array of their bytes by significance: those of most numbers are zeros, which compress."""
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return [np.concatenate([np.array([width], dtype=np.uint8), np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).ravel()])]


def unplane(b: np.ndarray) -> np.ndarray:
    out = np.zeros(((len(b) - 1) // int(b[0]), 8), dtype=np.uint8)
    out[:, : int(b[0])] = b[1:].reshape(int(b[0]), -1).T
    return out.view("<i8").ravel()


def differences(a: np.ndarray) -> list[np.ndarray]:
    """Rising numbers as the first one and the differences."""
    return [a[:1].astype(np.uint64), *planes(np.diff(a))]


def undiffer(first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([first, unplane(steps).view(np.uint64)]), dtype=np.uint64)


def tight(cell: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(cell)


def loose(cell: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(cell)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its entries' places, in order) for each bucket that occurs."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    dealt = bucket[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(dealt)) + 1, [len(dealt)]])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(dealt[a]), order[a:b]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket from the high bits of well mixed keys."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def rows(items: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    if not items:
        return pa.RecordBatch.from_pylist([], schema=ROWS_ARROW)
    b, k, c = zip(*items, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(k, pa.int32()), pa.array(c, pa.binary())], schema=ROWS_ARROW)


def cells(table: pa.Table, kind: int) -> list[list[np.ndarray]]:
    return [unpack(c.as_py()) for k, c in zip(table.column("kind").to_pylist(), table.column("cell"), strict=True) if k == kind]


def joined(parts: list[list[np.ndarray]], dtypes: tuple[str, ...]) -> list[np.ndarray]:
    """Column-wise concatenation of cells; empty arrays of the given types where there are none."""
    if not parts:
        return [np.zeros(0, dtype=t) for t in dtypes]
    return [np.concatenate([p[i] for p in parts]) for i in range(len(dtypes))]


def text_size(docs: DataFrame, column: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0)


def bucket_count(size: int, per_bucket: int = BUCKET_BYTES) -> int:
    return max(LEAST_BUCKETS, -(-size // per_bucket))


def collect_cells(df: DataFrame) -> list[tuple[int, bytes]]:
    """(kind, cell) of a frame of ROWS whose size the caller has bounded."""
    return [(r["kind"], bytes(r["cell"])) for r in df.select("kind", "cell").collect()]
