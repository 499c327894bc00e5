"""Operator 13: round trips, ids against the tokenizer over whole texts, and damaged files."""

import glob
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import token_files

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = ["The", "quick", "don't", "ÉTÉ", "x1y2", "…", "<|endoftext|>", "́a", "ΣΑΣ", "\x1c", " ", "\xa0wide", "中文", "ạ̀", "İ"]
    text = lambda: rng.choice([" ", "\n", "\t", "　"]).join(rng.choice(words) for _ in range(rng.randrange(40)))
    out = [(rng.randrange(100_000), text()) for _ in range(300)]
    return out + [(5, None), (6, ""), (7, "   "), (None, "no id"), (None, None), (-3, "below"), (8, "long " * 40_000)] + [out[0]] * 30 + [(out[0][0], "another text")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA + ", hash string, file int").repartition(4)


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_round_trip(spark, rows, whole, tmp_path):
    token_files.write_tokens(frame(spark, rows), str(tmp_path / "a"))
    got = sorted(map(tuple, token_files.read_tokens(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [r[0] for r in by_id(rows)]
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert all(len(r[3]) == 4 * r[2] for r in got)
    want = sorted((r[0] is not None, r[0] or 0, np.array(whole(r[1]), dtype="<u4").tobytes()) for r in rows)
    assert sorted((r[0] is not None, r[0] or 0, bytes(r[3])) for r in got) == want


def test_files_are_plain_zstandard(spark, rows, whole, tmp_path, monkeypatch):
    folder = str(tmp_path / "b")
    token_files.write_tokens(frame(spark, rows).coalesce(1), folder)
    ids = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(p, "rb").read()), read_across_frames=True).read() for p in sorted(glob.glob(f"{folder}/*.zst")))
    assert len(ids) == 4 * sum(len(whole(r[1])) for r in rows)
    got = token_files.read_tokens(spark, folder).orderBy("start").collect()
    assert ids == b"".join(bytes(r[3]) for r in got)


def test_only_requested_frames_are_opened(spark, rows, tmp_path):
    folder = str(tmp_path / "c")
    token_files.write_tokens(frame(spark, rows), folder)
    index = token_files.token_index(spark, folder).collect()
    target = next(r for r in index if r["doc_id"] == -3)
    other = next(r for r in index if r["doc_id"] == 8)
    with open(f"{folder}/{other['file']}", "r+b") as f:
        f.seek(other["offset"] + other["packed"][0] - 4)
        f.write(b"\xff\xfe\xfd\xfc")
    asked = spark.createDataFrame([(-3,), (None,), (123456789,)], "doc_id long")
    got = token_files.read_tokens(spark, folder, asked).collect()
    assert sorted((r[0] is not None, r[0] or 0) for r in got) == [(False, 0), (False, 0), (True, -3)]
    assert target["start"] in [r[1] for r in got]
    with pytest.raises(Exception, match="wrong checksum|ZstdError"):
        token_files.read_tokens(spark, folder, spark.createDataFrame([(8,)], "doc_id long")).collect()


def test_checksums_and_tables():
    stream = io.BytesIO(b"no token file at all")
    stream.size = lambda: 20
    with pytest.raises(ValueError, match="seek table"):
        token_files.read_tables(stream)


def test_long_documents_have_several_frames(spark, whole, tmp_path, monkeypatch):
    file_ = token_files.FRAME_IDS
    try:
        token_files.FRAME_IDS = 100
        made = token_files.TokenFile(str(tmp_path), "x.zst")
        made.add(4, np.arange(250, dtype="<u4"))
        made.add(None, np.arange(3, dtype="<u4"))
        made.close()
    finally:
        token_files.FRAME_IDS = file_
    with pa.fs.LocalFileSystem().open_input_file(str(tmp_path / "x.zst")) as stream:
        documents, frames = token_files.read_tables(stream)
    assert documents["frames"].tolist() == [3, 1] and documents["known"].tolist() == [1, 0] and frames["size"].tolist() == [400, 400, 200, 12]


def test_small_files_keep_the_order(spark, rows, tmp_path):
    folder = str(tmp_path / "d")
    token_files.write_tokens(frame(spark, rows), folder)
    files = spark.read.parquet(f"{folder}/files").collect()
    assert sorted(f["file"] for f in files) == sorted(p.rpartition("/")[2] for p in glob.glob(f"{folder}/*.zst"))
    assert sum(f["documents"] for f in files) == len(rows)


def test_empty(spark, tmp_path):
    folder = str(tmp_path / "e")
    token_files.write_tokens(spark.createDataFrame([], SCHEMA), folder)
    assert token_files.read_tokens(spark, folder).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n'stdm\x85\xa0ΣǺ̧<|>")), max_size=60), min_size=1, max_size=5))
def test_words_equal_whole_texts(whole, texts):
    encode = ENCODER[0] if ENCODER else ENCODER.append(token_files.Encoder(token_files.default_tokenizer())) or ENCODER[0]
    assert [i.tolist() for i in encode(pa.array(texts, pa.string()))] == [whole(t) for t in texts]


ENCODER = []


def test_query(spark, whole):
    sf = "/root/testdata/sf0.001"
    got = token_files.op13_token_files(spark, sf).orderBy("doc_id").collect()
    start = 0
    for r, (doc, text) in zip(got, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect(), strict=True):
        ids = whole(text)
        assert tuple(r) == (doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
