"""Vectorised helpers over Arrow text columns, shared by the operators of this subpackage.

Everything works on UTF-8 bytes. A batch is cut into runs of whole documents of about
``CHUNK`` bytes (one longer document is a run of its own), so that the temporary arrays stay
in cache and memory is bounded by the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

#: \x20 and \x09-\x0D separate words.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Only A-Z are lower-cased.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64, copy=True)
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z


class Polynomial:
    """Rolling hashes modulo 2**64 of byte strings, by prefix sums of value[byte] * base**i."""

    def __init__(self, seed: int):
        rng = np.random.RandomState(seed)
        self.value = rng.randint(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.randint(2**62, 2**63 - 1)) | 5
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, base: int, n: int) -> np.ndarray:
        out = np.ones(n, dtype=np.uint64)
        done = 1
        with np.errstate(over="ignore"):
            while done < n:
                step = min(done, n - done)
                out[done : done + step] = out[:step] * np.uint64(pow(base, done, 2**64))
                done += step
        return out

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) < len(data) + 1:
            self.up = self._powers(self.base, len(data) + 1)
            self.down = self._powers(self.inverse, len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.value[data] * self.up[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A well mixed hash of each [start, end); its length counts."""
        with np.errstate(over="ignore"):
            raw = (prefix[end] - prefix[start]) * self.down[start]
            return splitmix(raw + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """The hash of every window of k bytes."""
        n = len(prefix) - 1 - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return splitmix((prefix[k:] - prefix[:n]) * self.down[:n])


WORDS = Polynomial(20240229)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    if len(off) == 0:
        return data[:0], np.zeros(1, np.int64)
    return data[off[0] : off[-1]], off - off[0]


def runs(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``most`` bytes: (first row, end row, bytes, offsets)."""
    if batch.num_rows == 0:
        return
    data, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def runs_of(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about CHUNK bytes of a longer run."""
    i = 0
    while i < len(off) - 1:
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, side="right")) - 1), len(off) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, start, end) of each word ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    low = _LOWER[data]
    word = ~_SPACE[low]
    if not len(word):
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z
    first = np.zeros(len(word) + 1, dtype=bool)
    first[off] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | first[1:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | first[1:-1]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(stop) + 1
    row = np.searchsorted(off, start, side="right") - 1
    prefix = WORDS.prefix(low)
    return row, WORDS.spans(prefix, start, end), start, end


def shingles(row: np.ndarray, h: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the windows of n words of each row, in order; a row with fewer words gives its whole sequence as one."""
    mul = [np.uint64(x) for x in splitmix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)]
    size = np.uint64(0x9E3779B97F4A7C15)
    parts_row, parts_hash = [], []
    with np.errstate(over="ignore"):
        if len(h) >= n:
            m = len(h) - n + 1
            whole = row[:m] == row[n - 1 :]
            total = np.zeros(m, dtype=np.uint64)
            for k in range(n):
                total += splitmix(h[k : k + m]) * mul[k] if k else h[:m] * mul[0]
            parts_row.append(row[:m][whole])
            parts_hash.append(splitmix(total[whole] + np.uint64(n) * size))
        if len(row):
            change = np.flatnonzero(np.diff(row)) + 1
            lo = np.concatenate([[0], change])
            hi = np.concatenate([change, [len(row)]])
            for a, b in zip(lo[hi - lo < n], hi[hi - lo < n], strict=True):
                s = np.uint64(0)
                for k in range(b - a):
                    v = h[a + k : a + k + 1]
                    s = s + (splitmix(v) * mul[k] if k else v * mul[0])[0]
                parts_row.append(row[a : a + 1])
                parts_hash.append(splitmix(np.array([s + np.uint64(b - a) * size], dtype=np.uint64)))
    if not parts_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(parts_row), np.concatenate(parts_hash)


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
