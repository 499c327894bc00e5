import hashlib
import random

import pytest
from lectern.llm import substring_dedup as sd
from pyspark.sql import functions as F


def brute(rows, depth=100):
    docs = sorted({(d if d is not None else -(2**63), t or "") for d, t in rows})
    seen, out = set(), {}
    for d, t in docs:
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - depth + 1):
            w = raw[i : i + depth]
            if w in seen:
                gone[i : i + depth] = b"\1" * depth
            seen.add(w)
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d, t] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return sorted(((d, *out[d if d is not None else -(2**63), t or ""]) for d, t in rows), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.choice([12, 20, 40])) for _ in range(6)]
    line = text(18)
    rows = []
    for _ in range(120):
        parts = [text(rng.randint(0, 30)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        if rng.random() < 0.7:
            parts.insert(rng.randrange(len(parts) + 1), line)
        rows.append(rng.choice(["", " "]).join(parts))
    rows += [rows[3], rows[3], "ab" * 200, "a" * 500, "a" * 99, "a" * 100, shared[0][:99], shared[0]]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(900, None), (901, ""), (902, rows[5]), (902, rows[5]), (None, rows[7])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(docs_of, seed):
    rows = corpus(seed)
    got = sd.remove_repeats(docs_of(rows).repartition(3), bucket_bytes=1000)
    got = got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept_text")).alias("r"), F.size("spans").alias("s"), F.sha2("kept_text", 256).alias("k"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_empty_table(docs_of):
    assert sd.remove_repeats(docs_of([])).collect() == []


def test_query_columns_and_a_long_text(spark, tmp_path):
    """All columns; a text of a megabyte beside short ones, with a passage of its own that others hold."""
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_000_000))
    rows = [*corpus(9)[:60], (5000, long), (5001, "before X" + long[500_000:500_300] + "X behind"), (None, None), (7, "")]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_spans int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sd.op3_substring_dedup(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    got = {(r[0], r[1]): tuple(r) for r in got.collect()}
    small = brute([(d, t) for d, t in rows if d not in (5000, 5001)])
    assert sorted((v for k, v in got.items() if k[0] not in (5000, 5001)), key=str) == sorted(set(small), key=str)
    assert got[5000, len(long)] == (5000, len(long), 0, 0, hashlib.sha256(long.encode()).hexdigest())
    assert got[5001, 316][2:4] == (300, 1)
