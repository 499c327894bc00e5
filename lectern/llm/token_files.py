"""Operator 13: token ids in files of independent zstandard frames with a trailing seek table.

A file is a run of zstandard frames, one for each document (more for one of over ``FRAME_IDS`` ids), then two skippable
frames: the documents (id, tokens, frames), and the seek table of the public seekable format: for each frame its
compressed size, its size and a checksum (the low half of XXH64 of what it holds). Any zstandard tool
reads the whole file; a reader that seeks takes the table from the file's end and opens only the frames it is asked for.

Writing: documents are dealt by range of (doc_id, hash of the text, row), so that equal ids and equal rows split as
well, sorted in each task, encoded there and written as they come; a task holds a few megabytes of ids and one file's
table. A file is written under a name of its attempt and then renamed: a lost or repeated task leaves the same file.
The list of files is a Parquet table beside them, written last.

A word's ids are found once for each run of documents: no rule of the tokenizer looks across white space, so a text's
ids are those of its words between ASCII white space, in order. Tests hold this against whole texts.

Defined results: a null text counts as empty, an empty text is a single end id; null ids come first; rows of one
``doc_id`` are in order of a hash of their text; a very long text needs memory in proportion; other columns are
ignored; an empty table gives no files.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import checkpoints

END_ID = 1
#: Ids of a frame at most, bytes of a file about, bytes of text encoded together, words kept with their ids.
FRAME_IDS = 1 << 20
FILE_BYTES = 128 << 20
RUN_BYTES = 4 << 20
WORDS = 1 << 18
LEVEL = 3

#: Marks that end words.
MARKS = ".,;:!?"

# Fixed values of the seekable format: skippable frames, the table's end, and the flag for checksums.
DOCUMENTS_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
END_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

_DOCUMENT = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("tokens", "<u8"), ("frames", "<u4")])
_FRAME = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
_FILE_SCHEMA = "file string, documents long, tokens long, bytes long"
_PLACE_SCHEMA = "doc_id long, start long, n_tokens long, file string, offset long, packed array<long>, checksums array<long>"
_IDS_SCHEMA = "doc_id long, start long, n_tokens long, token_ids binary"
_IDS_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.binary())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def gathered(values: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the lists ``at`` joined, the ends of each) of lists laid end to end."""
    size = ends[at + 1] - ends[at]
    after = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(ends[at] - after[:-1], size) + np.arange(after[-1])], after


class Encoder:
    """Ids of texts, by words.

    A word of letters with at most one mark behind it, all below U+0300, where composing changes nothing, is what the
    tokenizer cuts in two itself; its letters, lower-cased, are encoded many words to a text without the steps that
    would do nothing (each one's last id ends a word, so the ids tell where words end), its mark once for all.
    All other words are encoded whole, one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.ids, self.ends = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        marks = self._learned(list(MARKS), self.known[1], self._one_by_one)
        self.mark = np.zeros(256, dtype=np.int64)
        self.mark[[ord(c) for c in MARKS]] = marks

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter((i for f in found for i in f), dtype="<u4", count=int(size.sum())), size

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.letters.encode_batch_fast([" ".join(words[k : k + 64]) for k in range(0, len(words), 64)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in found])
        size = np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0)
        return (ids, size) if len(size) == len(words) and size.sum() == len(ids) else self._one_by_one(words)

    def _learned(self, words: list[str], known: dict[str, int], encode) -> np.ndarray:
        """Places of the words' lists of ids."""
        if new := [w for w in words if w not in known]:
            ids, size = encode(new)
            known |= {w: k for k, w in enumerate(new, len(self.ends) - 1)}
            self.ids, self.ends = np.append(self.ids, ids), np.append(self.ends, self.ends[-1] + np.cumsum(size))
        return np.fromiter((known[w] for w in words), dtype=np.int64, count=len(words))

    def _parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(places of lists of ids, ends for each word) of different words."""
        _, at, data = words.buffers()
        at, data = np.frombuffer(at, dtype=np.int32)[words.offset : words.offset + len(words) + 1], np.frombuffer(data or b"", dtype=np.uint8)
        core = pc.utf8_rtrim(words, MARKS)
        marks = np.diff(at) - pc.binary_length(core).to_numpy()
        far = data >= 0xCC  # the first byte of what is beyond U+02FF, or U+0130, which falls apart when it is lower-cased
        far[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)
        far = np.concatenate([[0], np.cumsum(far)])
        plain = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False) & (marks <= 1) & (far[at[1:]] == far[at[:-1]])
        mask = pa.array(plain)
        coded = pc.utf8_lower(core.filter(mask)).dictionary_encode()
        letters = self._learned(coded.dictionary.to_pylist(), self.known[0], self._together)[coded.indices.to_numpy()]
        other = self._learned(words.filter(pc.invert(mask)).to_pylist(), self.known[1], self._one_by_one)
        size = np.where(plain, 1 + marks, 1)
        ends = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(ends[-1], dtype=np.int64)
        out[ends[:-1][plain]], out[ends[:-1][~plain]] = letters, other
        marked = plain & (marks == 1)
        out[ends[:-1][marked] + 1] = self.mark[data[at[1:][marked] - 1]]
        return out, ends

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        if sum(map(len, self.known)) > WORDS:
            self._forget()
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        parts, ends = self._parts(coded.dictionary)
        part, after_word = gathered(parts, ends, coded.indices.to_numpy().astype(np.int64))
        ids, after = gathered(self.ids, self.ends, part)
        cuts = after[after_word[words.offsets.to_numpy() - words.offsets[0].as_py()]]
        return [np.append(ids[a:b], np.uint32(END_ID)).astype("<u4") for a, b in zip(cuts, cuts[1:], strict=False)]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One for each process, so that words that tasks have in common are encoded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def file_system(folder: str):
    """(file system, path) of a folder; a path without scheme is local."""
    from pyarrow import fs

    if folder.startswith("file:") or "://" not in folder:
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


@dataclass
class TokenFile:
    """A file being written."""

    folder: str
    name: str
    documents: list[tuple] = field(default_factory=list)
    frames: list[tuple] = field(default_factory=list)
    tokens: int = 0
    bytes: int = 0

    def __post_init__(self):
        self.system, self.path = file_system(self.folder)
        self.attempt = f"{self.path}/.{self.name}.{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.attempt)
        self.packer = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        for k in range(0, len(ids), FRAME_IDS):
            raw = ids[k : k + FRAME_IDS].tobytes()
            packed = self.packer.compress(raw)
            self.stream.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.bytes += len(packed)
        self.documents.append((doc or 0, doc is not None, len(ids), -(-len(ids) // FRAME_IDS)))
        self.tokens += len(ids)

    def close(self) -> tuple[str, int, int, int]:
        documents = self.packer.compress(np.array(self.documents, dtype=_DOCUMENT).tobytes())
        table = np.array(self.frames, dtype=_FRAME).tobytes() + struct.pack("<IBI", len(self.frames), CHECKSUMS, END_MAGIC)
        self.stream.write(_skippable(DOCUMENTS_MAGIC, documents) + _skippable(TABLE_MAGIC, table))
        self.stream.close()
        self.system.move(self.attempt, f"{self.path}/{self.name}")
        return self.name, len(self.documents), self.tokens, self.bytes + len(documents) + len(table) + 16


def read_tables(stream) -> tuple[np.ndarray, np.ndarray]:
    """(documents, frames) of an open file, from its end."""
    size = stream.size()
    stream.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", stream.read(9))
    if magic != END_MAGIC or flags != CHECKSUMS:
        raise ValueError("not a token file: no seek table with checksums at its end")
    table = count * _FRAME.itemsize + 9
    stream.seek(size - table - 8)
    head = struct.unpack("<II", stream.read(8))
    if head != (TABLE_MAGIC, table):
        raise ValueError("not a token file: the seek table has no frame")
    frames = np.frombuffer(stream.read(table - 9), dtype=_FRAME)
    at = int(frames["packed"].sum(dtype=np.int64))
    stream.seek(at)
    magic, length = struct.unpack("<II", stream.read(8))
    if magic != DOCUMENTS_MAGIC:
        raise ValueError("not a token file: no table of documents")
    return np.frombuffer(zstandard.decompress(stream.read(length)), dtype=_DOCUMENT), frames


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None) -> None:
    """Files of the documents' ids in ascending order of ``doc_id``, and the table of files."""
    path = tokenizer or default_tokenizer()
    system, place = file_system(folder)
    system.create_dir(place, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    dealt = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, file, files = encoder_of(path), TaskContext.get().partitionId(), None, 0
        for batch in batches:
            text = batch.column(1)
            sizes = np.cumsum(pc.binary_length(text).to_numpy())
            cuts = [0, *np.flatnonzero(np.diff(sizes // RUN_BYTES, prepend=0)), len(text)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for doc, ids in zip(batch.column(0)[a:b].to_pylist(), encode(text[a:b]) if b > a else (), strict=True):
                    if file is None:
                        file = TokenFile(folder, f"{part:08d}-{files:06d}.zst")
                        files += 1
                    file.add(doc, ids)
                    if file.bytes >= FILE_BYTES:
                        yield _row(file)
                        file = None
        if file is not None:
            yield _row(file)

    dealt.select("doc_id", "text").mapInArrow(run, _FILE_SCHEMA).write.parquet(f"{folder}/files")


def _row(file: TokenFile) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("file", "documents", "tokens", "bytes"), file.close(), strict=True))])


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """Where each document lies: its first id's place in the whole run, its file, offset and frames. Only the files' ends are read."""
    files = spark.read.parquet(f"{folder}/files")
    # one row for each file; names sort as the files follow each other
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(f"{path}/{name}") as stream:
                    documents, frames = read_tables(stream)
                tokens, count = documents["tokens"].astype(np.int64), documents["frames"].astype(np.int64)
                cuts, offset = np.append(0, np.cumsum(count)).astype(np.int32), np.append(0, np.cumsum(frames["packed"], dtype=np.int64))
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(frames[n].astype(np.int64))) for n in ("packed", "checksum")]
                ids = pa.array(documents["doc_id"], mask=documents["known"] == 0)
                columns = [ids, pa.array(start + np.cumsum(tokens) - tokens), pa.array(tokens), pa.array([name] * len(tokens), pa.string()), pa.array(offset[cuts[:-1]]), *lists]
                whole = pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PLACE_SCHEMA.split(", ")])
                yield from (whole.slice(k, 10_000) for k in range(0, len(tokens), 10_000))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", before.alias("start")).repartition(parts).mapInArrow(run, _PLACE_SCHEMA)


def read_frames(places: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, token_ids) of rows of ``token_index``, and of no other documents; a wrong checksum is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        unpacker = zstandard.ZstdDecompressor()
        name, stream = None, None
        for batch in batches:
            held, rows = 0, []
            for row in batch.to_pylist():
                if row["file"] != name:
                    if stream:
                        stream.close()
                    name, stream = row["file"], system.open_input_file(f"{path}/{row['file']}")
                data, at, ids = memoryview(stream.read_at(sum(row["packed"]), row["offset"])), 0, []
                for size, checksum in zip(row["packed"], row["checksums"], strict=True):
                    raw = unpacker.decompress(data[at : at + size])
                    if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
                        raise ValueError(f"wrong checksum in {name} at byte {row['offset'] + at}")
                    ids.append(raw)
                    at += size
                rows.append({"doc_id": row["doc_id"], "start": row["start"], "n_tokens": row["n_tokens"], "token_ids": b"".join(ids)})
                held += row["n_tokens"]
                if held > FRAME_IDS:
                    yield pa.RecordBatch.from_pylist(rows, _IDS_ARROW)
                    held, rows = 0, []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _IDS_ARROW)
        if stream:
            stream.close()

    return places.mapInArrow(run, _IDS_SCHEMA)


def read_tokens(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """All documents, or those whose ``doc_id`` is in ``wanted``; only their frames are opened."""
    places = token_index(spark, folder)
    if wanted is not None:
        names = wanted.select(F.col("doc_id").cast("long").alias("w"))
        places = places.join(names, F.col("doc_id").eqNullSafe(F.col("w")), "left_semi").sortWithinPartitions("file", "offset")
    return read_frames(places, folder)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoints.ensure(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))
