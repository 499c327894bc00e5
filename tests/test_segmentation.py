"""The folds against plain loops over one transcript, and their laws."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import segmentation as seg


def chunks_model(words, gap_ms, least, most, starts=None):
    out, first = [], 0
    for i, (s, e) in enumerate(words):
        covered = e - words[first][0]
        last = i == len(words) - 1
        cut = covered >= most or (not last and words[i + 1][0] - e > gap_ms and covered >= least)
        if starts is not None and i + 1 not in starts:
            cut = False
        if cut or last:
            out.append((first, i + 1))
            first = i + 1
    return out


def passages_model(chunks, least, most, overlap):
    n, out, first = len(chunks), [], 0
    while True:
        total, best, wide = 0, None, -1
        for p in range(first, n):
            total += chunks[p][0]
            if total < least:
                continue
            if p == n - 1:
                best = p if best is None or total <= most else best
                break
            if chunks[p][1] > wide:
                best, wide = p, chunks[p][1]
            if total >= most:
                break
        best = n - 1 if best is None else best
        out.append((first, best))
        if best == n - 1:
            break
        back = best + 1 - overlap
        first = back if back > first else best + 1
    if len(out) > 1 and sum(c[0] for c in chunks[out[-2][1] + 1 : out[-1][1] + 1]) * 2 < least:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def timed(rng, n):
    t, out = 0, []
    for _ in range(n):
        t += rng.choice([50, 100, 400, 401, 1500])
        out.append((t, t + rng.randint(100, 900)))
        t = out[-1][1]
    return out


@pytest.mark.parametrize("starts", [False, True])
def test_chunks_equal_the_model_and_cover_every_word_once(spark, starts):
    rng = random.Random(1)
    words = {k: timed(rng, rng.choice([1, 2, 60, 200])) for k in range(8)}
    df = spark.createDataFrame([(k, i, s, e) for k, w in words.items() for i, (s, e) in enumerate(w)], "transcript long, idx long, start_ms long, end_ms long")
    allowed = list(range(0, 200, 7))
    how = {"starts": F.array(*(F.lit(x) for x in allowed))} if starts else {}
    for parts in (1, 8):
        got = {}
        for r in seg.plan_chunks(df.repartition(parts), "transcript", gap_ms=400, least_ms=5000, most_ms=12000, **how).collect():
            got.setdefault(r["transcript"], []).append((r["word_start"], r["word_end"]))
        for k, w in words.items():
            assert sorted(got[k]) == chunks_model(w, 400, 5000, 12000, allowed if starts else None)


@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_passages_equal_the_model(spark, overlap):
    rng = random.Random(overlap)
    chunks = {k: [(rng.choice([5, 20, 60, 100, 350]), rng.choice([0, 10, 500, 2000, -3])) for _ in range(rng.choice([1, 2, 3, 12, 40]))] for k in range(25)}
    chunks[100] = [(100, g) for g in (10, 500, 2000, 100, 3000, 0)]
    df = spark.createDataFrame([(k, i, w, g) for k, c in chunks.items() for i, (w, g) in enumerate(c)], "transcript long, idx long, words long, gap long")
    got = {}
    for r in seg.plan_passages(df, "transcript", 150, 300, overlap).collect():
        got.setdefault(r["transcript"], []).append((r["passage"], r["chunk_start"], r["chunk_end"]))
    for k, c in chunks.items():
        assert [x[1:] for x in sorted(got[k])] == passages_model(c, 150, 300, overlap)


def test_subtitle_lines_equal_the_model(spark):
    rng = random.Random(3)
    words = timed(rng, 120)
    texts = ["w" * rng.randint(1, 14) for _ in words]
    df = spark.createDataFrame([(1, i, t, s, e) for i, (t, (s, e)) in enumerate(zip(texts, words, strict=True))], "transcript long, idx long, text string, start_ms long, end_ms long")
    want, line, n, letters, last = [], -1, 0, 0, 0
    for t, (s, e) in zip(texts, words, strict=True):
        s, e = (s + 5) // 10, (e + 5) // 10
        if n == 0 or n >= 6 or letters + 1 + len(t) > 28 or s - last > 80:
            line, n, letters = line + 1, 1, len(t)
        else:
            n, letters = n + 1, letters + 1 + len(t)
        last = e
        want.append(line)
    got = {r["idx"]: r["line"] for r in seg.subtitle_lines(df, "transcript").collect()}
    assert [got[i] for i in range(len(want))] == want


def test_clamped_alignment_and_boundaries(spark):
    df = spark.createDataFrame([([(0, 10), (5, 7), (20, 20)],)], "s array<struct<start_ms:long,end_ms:long>>")
    row = df.select(seg.clamp_alignment(F.col("s")).alias("c"), seg.boundaries(F.lit(0), F.lit(10), F.lit(3)).alias("b")).first()
    assert [tuple(x) for x in row["c"]] == [(0, 10), (10, 11), (20, 21)]
    assert row["b"] == [0, 3, 6, 10]
