import numpy as np
from lectern.llm import near_vectors as nv


def brute(rows, threshold=0.9):
    n = len(rows)
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    link = np.zeros((n, n), dtype=bool)
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], dtype=np.float64), np.array(rows[j][1], dtype=np.float64)
                link[i, j] = link[j, i] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
    comp = list(range(n))
    for i in range(n):
        for j in np.flatnonzero(link[i]):
            a, b = comp[i], comp[j]
            comp = [min(a, b) if c in (a, b) else c for c in comp]
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[comp[i]] = min(least.get(comp[i], rows[i][0]), rows[i][0])
    return sorted(((d, int(link[i].sum()), least.get(comp[i]) if good[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def test_links_and_components_equal_brute_force(spark):
    rng = np.random.RandomState(3)
    rows = []
    for size in [1] * 300 + [2] * 30 + [5] * 8 + [40, 120]:
        centre = rng.randn(24)
        for _ in range(size):
            rows.append((len(rows), (centre + 0.15 * rng.randn(24)).astype(np.float32).tolist()))
    chain = rng.randn(24)
    for _ in range(12):
        chain = chain + 0.4 * rng.randn(24)
        rows.append((len(rows), chain.astype(np.float32).tolist()))
    rows += [(len(rows) + i, rows[5][1]) for i in range(30)]
    rows += [(9001, None), (9002, []), (9003, [0.0] * 24), (9004, [float("nan")] * 24), (9005, [None] + [1.0] * 23), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (None, rows[7][1]), (3, rows[3][1]), (9008, [float("inf")] * 24)]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "vec_id long, embedding array<float>, label int, bucket int")
    out, recall = nv.near_duplicates(df)
    assert recall >= 0.97
    got = sorted((tuple(r)[:3] for r in out.collect()), key=str)
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    found = sum(min(g[1], w[1]) for g, w in zip(got, want, strict=True))
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and found >= 0.97 * sum(w[1] for w in want)
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.98 * len(want)


def test_empty_table(spark):
    out, recall = nv.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert out.collect() == [] and recall == 1.0


def test_clumps_whose_lists_are_full_are_linked_across(spark):
    """Every list is full of its own clump; no audited node of all sees it."""
    rng = np.random.RandomState(8)
    unit = lambda x: x / np.linalg.norm(x)
    a = unit(rng.randn(64))
    b = unit(0.945 * a + np.sqrt(1 - 0.945**2) * unit(rng.randn(64) - a * (a @ rng.randn(64))))
    rows = [(i, unit(rng.randn(64)).tolist()) for i in range(300)]
    rows += [(1000 + i, (c + 0.17 * unit(rng.randn(64))).tolist()) for c in (a, b) for i in range(30)]
    rows = [(i, v) for i, (_, v) in enumerate(rows)]
    want = brute(rows)
    assert len({w[2] for w in want if w[0] >= 300}) == 1 and sum(w[1] for w in want) > 2 * 2 * 30 * 29 * 0.9
    out, _ = nv.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), audit=0)
    assert sorted((tuple(r)[:3] for r in out.collect()), key=str) == want


def test_query_columns(spark, tmp_path):
    rng = np.random.RandomState(5)
    rows = [(i, (c + 0.1 * rng.randn(16)).tolist()) for i, c in enumerate(np.repeat(rng.randn(60, 16), 3, axis=0))] + [(900, None), (None, [1.0] * 16), (901, [1.0] * 16)]
    spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, node int, comp int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = nv.op4_near_vectors(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert [r[:3] for r in got] == brute(rows) and all(r[3] == (r[0] == r[2]) for r in got)
