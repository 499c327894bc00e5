import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from lectern.llm import quality


def corpus(rng, n):
    vocab = ["the", "of", "and", *(f"{a}{b}" for a in ("tion", "ing", "er", "es") for b in ("th", "nd", "on", "ha"))]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(15, 80))]
        good = rng.random() < 0.7
        junk = rng.choice(["caps", "pipe", "again"])
        t = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words) if junk == "caps" else " | ".join(words) if junk == "pipe" else " ".join(w for x in words[:9] for w in [x] * 6)
        rows.append((i, t))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_contract(spark, docs_of):
    rng = random.Random(5)
    rows, labels = corpus(rng, 900)
    docs = docs_of([*rows, (5000, None), (5001, ""), (None, "the of and"), (7, rows[7][1])])
    lab = spark.createDataFrame([*labels, labels[3], (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, lab)
    scored = quality.score_quality(docs, *model).select("doc_id", quality.held_out(4, 2).alias("held"), "quality_score", "quality_predicted").collect()
    truth = {d: q for d, q, _ in labels}
    held = [r for r in scored if r["held"] and r["doc_id"] in truth]
    assert len(scored) == 904 and all(0 <= r["quality_score"] <= 1 for r in scored)
    assert np.mean([r["quality_predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(r["quality_predicted"] == (r["quality_score"] >= 0.7) for r in scored)
    again = quality.score_quality(docs.repartition(5), *quality.fit(docs.repartition(5), lab)).select("doc_id", "quality_score").collect()
    score = lambda rows: np.array([r["quality_score"] for r in sorted(rows, key=lambda r: str(r["doc_id"]))])
    assert np.allclose(score(again), score(scored), atol=1e-3)


def test_no_labels_and_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of([(1, "a b"), (2, None)])
    assert [r["quality_score"] for r in quality.score_quality(docs, *quality.fit(docs, none)).collect()] == [0.5, 0.5]
    empty = docs_of([])
    assert quality.score_quality(empty, *quality.fit(empty, none)).collect() == []


def plain_tokens(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t-\r]+", (text or "").encode())


def hashed(token):
    row, h = quality.tokens(np.frombuffer(token, dtype=np.uint8), np.array([0, len(token)]))
    assert row.tolist() == [0]
    return int(h[0])


def test_vectors_and_pools_equal_plain_loops(docs_of):
    """Counts, the choice of words, sums of neighbours and the three pools, against dictionaries."""
    rng = random.Random(3)
    vocab = ["the", "The", "of", "...", "é7", "x", "zygote", "{}", "qu", "lo"]
    texts = [" ".join(rng.choice(vocab) + rng.choice(["", "", "!", str(rng.randrange(30))]) for _ in range(rng.randint(0, 60))) for _ in range(120)] + [None, "", "the"]
    docs = docs_of(list(enumerate(texts))).repartition(3)
    most = 9
    words, vectors = quality.word_vectors(docs, most)
    lists = [[hashed(w) for w in plain_tokens(t)] for t in texts]
    count = Counter(h for x in lists for h in x)
    by_count = sorted(count.values(), reverse=True)
    least = min(c for c in by_count if sum(x >= c for x in by_count) <= most)
    assert words.tolist() == sorted(h for h, c in count.items() if c >= least)
    place = {h: k for k, h in enumerate(words.tolist())}
    slot = lambda h: place.get(h, len(words) + (h >> 40) % quality.SHARED)
    every = np.concatenate([words, quality.splitmix(np.arange(quality.SHARED, dtype=np.uint64))])
    places, signs = quality.index_vectors(every)
    table = np.zeros((len(every), quality.DIMS + 1))
    for x in lists:
        for i, h in enumerate(x):
            table[slot(h), -1] += 1
            for j in range(max(0, i - quality.WINDOW), min(len(x), i + quality.WINDOW + 1)):
                for c, g in zip(places[slot(x[j])], signs[slot(x[j])], strict=True):
                    table[slot(h), c] += g * (i != j)
    assert np.allclose(quality.normalised(table), vectors, atol=1e-6)
    raw = [(t or "").encode() for t in texts]
    got = quality.pooled(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), (words, vectors))
    for x, row in zip(lists, got, strict=True):
        v = np.array([vectors[slot(h)] for h in x]).reshape(len(x), quality.DIMS)
        want = np.concatenate([v.sum(axis=0), (v * v).sum(axis=0), (v[1:] * v[:-1]).sum(axis=0)]) / max(len(x), 1)
        assert np.allclose(row, want, atol=1e-5)


def test_network_equals_plain_formulas():
    rng = np.random.RandomState(2)
    x = rng.randn(200, 5)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = quality.Network(x, y)
    for row, score in zip(x[:20], net.scores(x[:20]), strict=True):
        z = [max(-6.0, min(6.0, (a - m) / s)) for a, m, s in zip(row, net.mean, net.scale, strict=True)]
        hidden = [np.tanh(sum(z[i] * net.p[0][i, j] for i in range(5)) + net.p[1][j]) for j in range(quality.HIDDEN)]
        logit = sum(h * w for h, w in zip(hidden, net.p[2], strict=True)) + net.p[3][0]
        assert abs(score - 1 / (1 + np.exp(-logit / net.temperature))) < 1e-9
    kept = np.arange(len(y)) % 6 == 5
    loss = lambda t: np.mean(np.logaddexp(0, net._logits(x[kept]) / t) - y[kept] * net._logits(x[kept]) / t)
    assert all(loss(net.temperature) <= loss(t) + 1e-12 for t in np.geomspace(0.25, 8, 61))


def test_names_that_clash(docs_of, spark):
    from pyspark.sql import functions as F

    docs = docs_of([(1, "a b"), (2, None)]).withColumn("quality_score", F.lit("mine")).withColumn("quality_predicted", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none)
    with pytest.raises(ValueError):
        quality.score_quality(docs, *model)
    got = quality.score_quality(docs, *model, names=("s", "p"))
    assert got.columns == [*docs.columns, "s", "p"] and {r["quality_score"] for r in got.collect()} == {"mine"}


def test_query_columns(spark, tmp_path):
    rows, labels = corpus(random.Random(1), 60)
    rows += [(None, "the of"), (None, None), (7, rows[7][1])]
    spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.op2_quality(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = got.collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    assert sorted((str(r[0]), r[1]) for r in got) == sorted((str(d), held(d)) for d, _ in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
