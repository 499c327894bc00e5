"""Nearest rows from cells against all products, with filters and models, and budgets in rounds against a loop."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import search
from lectern.operators.semantic import VectorCells


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 16))
    out = [(i, [float(x) for x in centre[rng.integers(40)] + rng.normal(size=16)], "a" if i % 4 else "b", int(rng.integers(100))) for i in range(3000)]
    odd = [(5000, None, "a", 1), (5001, [0.0] * 16, "a", 1), (5002, [math.nan] * 16, "a", 1), (5003, [1.0] * 3, "a", 1), (5004, [1.0] * 16, None, 1), (5005, [None] * 16, "b", 1), (5006, [1e300] * 16, "a", 1)]
    return out + odd


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    df = spark.createDataFrame(rows, "id long, vector array<double>, model string, kind int").repartition(4)
    return VectorCells.create(df, "id", "vector", "model", str(tmp_path_factory.mktemp("cells") / "x"), ("kind",), 32)


def exact(rows, model, q, k, keep=lambda r: True):
    out = []
    for r in rows:
        v = np.array([np.nan if x is None else x for x in r[1] or []], dtype=float)
        if r[2] == model and len(v) == 16 and np.isfinite(v).all() and v.any() and keep(r):
            v = v / np.abs(v).max()
            out.append((round(1 - float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 6), r[0]))
    return sorted(out)[:k]


def recall(spark, rows, index, model, k, condition=None, keep=lambda r: True):
    asked = [r for r in rows[:3000] if r[0] % 50 == 0]
    df = spark.createDataFrame([(f"q{r[0]}", r[1]) for r in asked], "question string, vector array<double>")
    got = {}
    for r in index.nearest(df, "question", "vector", model, k, condition).collect():
        got.setdefault(r["question"], []).append((r["place"], r["id"]))
    hits = want = 0
    for r in asked:
        true = {i for _, i in exact(rows, model, np.array(r[1]), k, keep)}
        found = got.get(f"q{r[0]}", [])
        assert [p for p, _ in sorted(found)] == list(range(1, len(true) + 1))  # always full
        hits, want = hits + len(true & {i for _, i in found}), want + len(true)
    return hits / want


def test_recall_without_and_with_filters(spark, rows, index):
    assert recall(spark, rows, index, "a", 10) >= 0.95
    assert recall(spark, rows, index, "b", 10, F.col("kind") < 30, lambda r: r[3] < 30) >= 0.95
    assert recall(spark, rows, index, "a", 10, F.col("kind") == 7, lambda r: r[3] == 7) >= 0.95


def test_fewer_cells_are_read_where_that_is_enough(index):
    assert 1 <= index.models["a"]["probes"][10] <= len(index.models["a"]["centroids"])
    assert sorted(index.models) == ["a", "b"] and index.models["a"]["rows"] == 2251


def test_opened_again_and_odd_questions(spark, index):
    again = VectorCells.open(spark, index.path)
    q = spark.createDataFrame([(1, None), (2, [0.0] * 16), (3, [1.0]), (4, [1.0] * 16)], "question int, vector array<double>")
    got = again.nearest(q, "question", "vector", "a", 3).collect()
    assert {r["question"] for r in got} == {4} and len(got) == 3
    assert again.nearest(q, "question", "vector", "none", 3).collect() == []


def test_questions_in_chunks(spark, rows, index, monkeypatch):
    from lectern.operators import semantic

    monkeypatch.setattr(semantic, "CHUNK_BYTES", 1000)
    q = spark.createDataFrame([(i, rows[i][1]) for i in range(40)], "question int, vector array<double>")
    one = index.nearest(q, "question", "vector", "a", 2).collect()
    assert len(one) == 80 and {r["question"] for r in one} == set(range(40))


@pytest.mark.parametrize("long,rounds", [(10, 40), (10, 2), (1000, 40)])
def test_budget_in_rounds_equals_a_loop(spark, monkeypatch, long, rounds):
    monkeypatch.setattr(search, "MOST_ROUNDS", rounds)
    rng = random.Random(4)
    rows = [(run, rng.randrange(50), k, rng.choice([0, 1, 3, 8, 50, 200, None]) if run else 200 - k) for run in (0, 1, 2, None) for k in range(200 if run != 2 else 5)]
    want = []
    for run in (0, 1, 2, None):
        left = 300
        for _, _, k, words in sorted((r for r in rows if r[0] == run), key=lambda r: r[1:3]):
            if words is not None and words <= left:
                left, want = left - words, [*want, (run, k)]
    df = spark.createDataFrame(rows, "run int, priority int, id long, words int").repartition(3)
    assert sorted(map(tuple, search.spend_budget(df, 300, long).collect()), key=str) == sorted(want, key=str)


def test_nearest_are_exact_with_few_probes(spark, rows, index):
    few = VectorCells(spark, index.path, {"a": index.models["a"] | {"probes": {"10": 1, "100": 1, "1000": 1}}})
    asked = [r for r in rows[:3000] if r[0] % 50 == 0]
    df = spark.createDataFrame([(r[0], r[1]) for r in asked], "question long, vector array<double>")
    got = {}
    for r in few.nearest(df, "question", "vector", "a", 10).collect():
        got.setdefault(r["question"], []).append((r["distance"], r["id"]))
    assert {q: sorted(v) for q, v in got.items()} == {r[0]: exact(rows, "a", np.array(r[1]), 10) for r in asked}
