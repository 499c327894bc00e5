"""Points in spans and nearest marks against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import joins


@pytest.mark.parametrize("width", [None, 1, 7, 10_000])
def test_points_in_spans(spark, width):
    rng = random.Random(1)
    points = [(rng.randrange(4), rng.randrange(-50, 300), k) for k in range(200)] + [(None, 5, 999)]
    spans = [(rng.randrange(4), a := rng.randrange(-60, 300), a + rng.choice([0, 1, 5, 80, -3]), k) for k in range(80)] + [(None, 0, 10, 99), (1, None, 5, 98)]
    got = joins.points_in_spans(spark.createDataFrame(points, "k int, at int, p int"), spark.createDataFrame(spans, "k int, low int, high int, s int"), "k", "at", "low", "high", width)
    want = sorted((p, s) for k, at, p in points for sk, a, b, s in spans if k is not None and k == sk and a is not None and a <= at < b)
    assert sorted((r["p"], r["s"]) for r in got.collect()) == want != []
    assert set(got.columns) == {"k", "at", "p", "low", "high", "s"}


def test_nearest_chunk(spark):
    rng = random.Random(2)
    points = [(rng.randrange(4), rng.randrange(120)) for _ in range(150)]
    chunks = [(rng.randrange(3), k, a := rng.randrange(110), a + rng.choice([0, 2, 6, 30])) for k in range(25)] + [(0, 77, None, None)]
    got = joins.nearest_chunk(spark.createDataFrame(points, "k int, idx int"), spark.createDataFrame(chunks, "k int, pos int, word_start int, word_end int"), "k", "idx")
    want = []
    for k, i in points:
        mine = [(max(a - i, i - b, 0), pos) for ck, pos, a, b in chunks if ck == k and a is not None]
        want.append((k, i, min(mine)[1] if mine else None))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_nearest_mark(spark):
    rng = random.Random(3)
    points = [(rng.randrange(3), rng.randrange(500), k) for k in range(100)]
    marks = [(rng.randrange(2), rng.randrange(500)) for _ in range(15)]
    got = joins.nearest_mark(spark.createDataFrame(points, "k int, at long, p int"), spark.createDataFrame(marks, "k int, mid long"), "k", "at", "mid", 30)
    want = []
    for k, at, p in points:
        near = sorted((abs(m - at), m) for mk, m in marks if mk == k and abs(m - at) <= 30)
        want.append((k, at, p, near[0][1] if near else at))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_divisions(spark):
    verses = spark.createDataFrame([(1, 1), (2, 5), (2, 6), (9, 1)], "surah int, ayah int")
    marks = spark.createDataFrame([(1, 1, 1), (2, 2, 6)], "number int, surah int, ayah int")
    assert [r["division"] for r in joins.division_of(verses, marks).orderBy("surah", "ayah").collect()] == [1, 1, 2, 2]
    with pytest.raises(Exception, match="before the first marker"):
        joins.division_of(spark.createDataFrame([(0, 1)], "surah int, ayah int"), marks).collect()
    with pytest.raises(ValueError, match="order"):
        joins.division_of(verses, marks.withColumn("number", -F.col("number")))


def test_covering_asks_each_place_once(spark):
    points = [(p, p % 2, p % 5) for p in range(4000)] + [(9000, None, 1), (9001, 0, 99), (-5, 0, 77)]
    spans = [(s, s % 2, s % 4, s % 4 + s % 3) for s in range(60)] + [(900, 0, None, 4), (901, None, 0, 9)]
    v, s = spark.createDataFrame(points, "p int, k int, at int"), spark.createDataFrame(spans, "s int, k int, a int, b int")
    held = {p: sorted(i for i, sk, a, b in spans if k is not None and k == sk and a is not None and a <= at <= b) for p, k, at in points}

    def records():
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = records()
    got = joins.covering_first(v, s, "k", "at", "a", "b", ["s"], "p", "s").collect()
    assert {r["p"]: (r["total"], r["first_ids"]) for r in got} == {p: (len(h), ",".join(map(str, h[:5]))) for p, h in held.items()} and len(got) == len(points)
    one = joins.covering_least(v, s, "k", "at", "a", "b", "p").collect()
    first = min(p for p, h in held.items() if h)
    assert sorted((r["p"], r["s"]) for r in one) == [(first, i) for i in held[first]]
    assert records() - before < 5 * len(points) < sum(map(len, held.values()))
