"""Operator 8: cost-balanced packing of documents into token sequences.

Each task tokenizes its own documents (no shuffle) and packs them in windows of about
``WINDOW`` tokens, so memory does not depend on the size of the partition. In a window,

* a document is cut into whole pieces of ``length`` tokens, each a sequence of its own, and a tail;
* the tails' tokens fix the sequences to fill: as many full ones as they need, and for the rest
  sequences whose capacities are the powers of two that sum to it, which need no padding;
* the tails, in descending estimated cost ``linear * n + quadratic * n**2`` (attention within a
  piece), each go to the sequence of lowest cost with room for them. A tail that fits nowhere is cut:
  what the roomiest sequence can take goes there, and the rest is placed anew.

Capacities sum to the tokens, so every sequence ends exactly full. Sequence ids are made of the
task's partition number and a counter: a repeated task gives the same rows again.

Defined results: a null text counts as empty; an empty text is a single end id; a null ``doc_id``
stays null; repeated rows are packed as often as they occur; tails of equal cost go in the order of their rows; a very
long text is a window of its own and needs memory in proportion; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens that a task holds at a time.
WINDOW = 1 << 20
END_ID = 1
#: Runs of white space that are cut out of a text that the pattern gives up on.
_LONG_SPACE = re.compile("[\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")

SCHEMA = "doc_id long, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long, capacity long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("token_ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("capacity", pa.int64())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_level_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(ranks by bytes, special tokens) of a byte-level BPE file whose ids follow the order of its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return ranks, special


def encoder(ranks: dict[bytes, int], special: dict[str, int]):
    """A function from text to an array of ids."""
    import public_tokenizers
    import tiktoken

    make = lambda pattern, more: tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=more)
    whole, unbroken = make(public_tokenizers.PATTERN, special), make(r"\s+|\S+", {})
    ids = lambda text: np.asarray(whole.encode_to_numpy(text, allowed_special="all"), dtype="<u4")
    marks = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def in_parts(text: str) -> Iterator[np.ndarray]:
        for part in marks.split(text) if marks else [text]:
            at = 0
            for m in _LONG_SPACE.finditer(part) if part not in special else ():
                # a run of white space is a word of its own; its last character goes to what follows it
                end = m.end() - (m.end() < len(part))
                yield ids(part[at : m.start()])
                yield np.asarray(unbroken.encode_to_numpy(part[m.start() : end]), dtype="<u4")
                at = end
            yield ids(part[at:])

    def encode(text: str) -> np.ndarray:
        try:
            return ids(text)
        except ValueError:  # the pattern looks ahead from every place of a run of white space, and gives up on very long ones
            return np.concatenate(list(in_parts(text)))

    return encode


def capacities(total: int, length: int) -> list[int]:
    """Capacities of sequences that ``total`` tokens fill exactly: full ones, then powers of two."""
    rest = total % length
    return [length] * (total // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def place(tails: list[tuple[int, int]], length: int, linear: float, quadratic: float) -> tuple[list[int], list[tuple[int, int, int, int, int]]]:
    """(capacities, pieces as (tail, first token in the tail, tokens, sequence, offset)) for tails given as (tail, tokens)."""
    room = np.array(capacities(sum(n for _, n in tails), length), dtype=np.int64)
    sizes = room.copy()
    cost = np.zeros(len(room))
    pieces = []
    for tail, n in sorted(tails, key=lambda x: (-(linear * x[1] + quadratic * x[1] ** 2), x[0])):
        at = 0
        while at < n:
            want = n - at
            fits = np.where(room >= want, cost, np.inf)
            best = int(fits.argmin())
            if not np.isfinite(fits[best]):
                best = int(np.lexsort((cost, -room))[0])
                want = int(room[best])
            pieces.append((tail, at, want, best, int(sizes[best] - room[best])))
            room[best] -= want
            cost[best] += linear * want + quadratic * want**2
            at += want
    return sizes.tolist(), pieces


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 2048, window: int = WINDOW) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers in ``token_ids``."""
    shared = docs.sparkSession.sparkContext.broadcast(byte_level_vocabulary(tokenizer or default_tokenizer()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*shared.value)
        sequence = TaskContext.get().partitionId() << 36
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            rows: list[tuple] = []
            tails = []
            for k, (doc, ids) in enumerate(held):
                whole = len(ids) // length * length
                for start in range(0, whole, length):
                    rows.append((doc, start, length, ids[start : start + length].tobytes(), len(ids), sequence, 0, length))
                    sequence += 1
                if len(ids) > whole:
                    tails.append((k, len(ids) - whole))
            sizes, pieces = place(tails, length, linear, quadratic)
            for k, first, n, seq, offset in pieces:
                doc, ids = held[k]
                start = len(ids) // length * length + first
                rows.append((doc, start, n, ids[start : start + n].tobytes(), len(ids), sequence + seq, offset, sizes[seq]))
            sequence += len(sizes)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                held.append((doc, ids))
                tokens += len(ids)
                if tokens >= window:
                    yield flush()
                    tokens = 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "capacity")
