"""Operator 12 against plain products, and against its SQL."""

import math

import duckdb
import numpy as np
import pytest

from lectern.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows):
    """The contract in plain Python."""
    taken = []
    for id_, v, label in rows:
        if id_ is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        taken.append((id_, (label + 1) % 10 if id_ % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    score = lambda v, w: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(v, w, strict=False))))
    out = []
    for id_, label, v in taken:
        if id_ % 100:
            continue
        best = sorted((-score(v, w), i) for i, other, w in taken if other == label and i != id_)[:5]
        for p, positive in best:
            fit = sorted((-s, i) for i, other, w in taken if other != label and 80 * -p <= 100 * (s := score(v, w)) <= 100 * -p)[:5]
            out += [(id_, positive, k + 1, i, -p, -s) for k, (s, i) in enumerate(fit)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, hard_negatives.hard_negatives(df).collect()))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(30, 12))
    out = []
    for i in range(900):
        v = (centre[rng.integers(30)] + 0.4 * rng.normal(size=12)) / 4
        out.append((i, [float(x) for x in np.round(v, 1)], int(rng.integers(3) if i % 3 else 1)))
    odd = [(None, out[0][1], 1), (901, None, 2), (902, out[2][1], None), (903, [None] * 12, 1), (904, [math.nan] * 12, 1), (905, [math.inf] + [0.0] * 11, 1), (1000, [], 1), (1100, [0.5, 0.25], 2), (906, [1.0] * 20, 0), (1200, [0.0] * 12, 0), (-100, out[5][1], -3)]
    return out + odd + out[300:320]  # repeated rows, among them an anchor


def test_equals_products(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], SCHEMA + ", anchor int, score double").repartition(4)
    assert found(df) == plain(rows) != []


def test_chunks_and_small_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CHUNK_BYTES", 400)
    got = found(spark.createDataFrame(rows[:450], SCHEMA).repartition(3))
    assert got == plain(rows[:450])


def test_extreme_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 10.0 ** rng.choice([0, 6, 12, 30])], int(rng.integers(2))) for i in range(301)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_blocks_drop_pairs_but_no_result():
    rng = np.random.default_rng(5)
    a, c = np.floor(rng.normal(size=(7, 16)) * 40), np.floor(rng.normal(size=(500, 16)) * 40)
    whole = a @ c.T
    least = np.sort(whole, axis=1)[:, -20]
    seen = []

    def still(i, j, low, high):
        assert (low <= whole[i, j]).all() and (high >= whole[i, j]).all()
        seen.append(len(i))
        return high >= least[i]

    i, j, s = hard_negatives.interval_products(a, c, lambda low, high: high >= least[:, None], still)
    assert (s == whole[i, j]).all() and len(s) == (whole >= least[:, None]).sum()
    assert seen and seen[-1] < whole.size / 10


def test_empty(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)) == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    df = hard_negatives.op12_hard_negatives(spark, sf)
    want = c.sql(hard_negatives.SQL)
    assert want.columns == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
