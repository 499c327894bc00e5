"""Passages built from chunks against plain loops over the same plan."""

import hashlib

from pyspark.sql import functions as F

from lectern.operators import corpus, segmentation, smart


def test_passages_hold_their_chunks(spark):
    chunks = [(t, i, " ".join(f"w{t}x{i}x{k}" for k in range(4 + (i * 7 + t) % 9)), i * 10_000, i * 10_000 + 9000 - (i % 4) * 500) for t in (1, 2, 3) for i in range(25 if t < 3 else 1)]
    df = spark.createDataFrame(chunks, "transcript long, idx long, text string, start_ms long, end_ms long")
    headers = spark.createDataFrame([(t, f"title {t}") for t in (1, 2, 3)], "transcript long, header string")
    got = corpus.build_passages(df, headers, 20, 40).collect()
    words = {(t, i): x.split() for t, i, x, _, _ in chunks}
    times = {(t, i): (a, b) for t, i, _, a, b in chunks}
    gaps = [(t, i, len(words[t, i]), times[t, i + 1][0] - times[t, i][1] if (t, i + 1) in times else 0) for t, i, *_ in chunks]
    plan = segmentation.plan_passages(spark.createDataFrame(gaps, "transcript long, idx long, words long, gap long"), "transcript", 20, 40).collect()
    want = {}
    for t, p, a, b in plan:
        text = " ".join(w for i in range(a, b + 1) for w in words[t, i])
        want[t, p] = (a, b, text, len(text.split()), times[t, a][0], times[t, b][1], hashlib.sha256(f"title {t}\n{text}".encode()).hexdigest())
    assert {(r["transcript"], r["passage"]): (r["chunk_start"], r["chunk_end"], r["text"], r["word_count"], r["start_ms"], r["end_ms"], r["content_hash"]) for r in got} == want
    assert len(want) > 10 and {t for t, _ in want} == {1, 2, 3}


def test_unchanged_transcripts_are_found(spark):
    one = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "transcript int, passage int, content_hash string")
    two = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "d"), (3, 0, "e")], "transcript int, passage int, content_hash string")
    assert [r["transcript"] for r in corpus.unchanged(one, two).collect()] == [1]


def test_anchored_passages_by_position_and_by_nearness(spark):
    p = spark.createDataFrame([(1, 9, 0, 2, 1, 5), (2, 8, 1, 2, 3, 9), (3, 8, 0, 2, 4, 4), (4, 1, 0, 3, 1, 9), (5, 1, 0, 2, None, None)], "id long, segment long, ordinal int, surah int, ayah_start int, ayah_end int")
    ranks = lambda df: [r["id"] for r in sorted(df.collect(), key=lambda r: r["rank"])]
    assert ranks(smart.anchored(p, [(2, 4), (2, 3), (2, 4)])) == [3, 2, 1]
    near = spark.createDataFrame([(1, 0.2), (2, 0.1), (4, 0.0)], "id long, distance double")
    assert ranks(smart.anchored(p, [(2, 4)], nearness=near)) == [2, 1]
    assert ranks(smart.anchored(p, [(2, 4)], 1)) == [3]


def test_passages_of_a_source(spark):
    p = spark.createDataFrame([(1, 10, 2), (2, 11, 2), (3, 12, 3)], "id long, segment long, surah int")
    s = spark.createDataFrame([(10, 5), (11, 6), (12, 5)], "segment long, source int")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(smart.filtered(p, 2)) == [1, 2] and ids(smart.filtered(p, None, 5, s)) == [1, 3] and ids(smart.filtered(p, 2, 5, s)) == [1]
    assert ids(smart.filtered(p.withColumn("source", F.col("surah")), source=3)) == [3]
