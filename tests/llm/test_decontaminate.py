import math
import random
import re
from collections import Counter

import numpy as np
from lectern.llm import decontaminate as dc

RNG = random.Random(4)
VOCAB = [f"w{i}" for i in range(300)]
ITEMS = [(i, " ".join(RNG.choice(VOCAB[: 40 if RNG.random() < 0.4 else 300]) for _ in range(RNG.randint(1, 60)))) for i in range(90)] + [(200, None), (None, "w1 w2 w3"), (201, ""), (202, "Is w1 the w2? w3 it is w4 w5"), (203, "w1"), (204, "w2 w3"), (205, "w2 w3"), (206, "?")]


def low(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def whole_statistics(items):
    lists = [low(t) for i, t in items if i is not None and len(low(t)) >= 3]
    df = Counter(h for v in lists for h in {*hashes(v)})
    terms = np.array(sorted(df), dtype=np.uint64)
    return dc.Statistics(len(lists), sum(map(len, lists)) / len(lists), max(map(len, lists)), terms, np.array([df[t] for t in terms.tolist()]))


def hashes(v):
    row, h, *_ = dc.words(np.frombuffer(" ".join(v).encode(), dtype=np.uint8), np.array([0, len(" ".join(v).encode())]))
    return dc.pairs(row, h)[1].tolist()


def test_wand_retrieves_what_scoring_every_item_does():
    index = dc.Index(ITEMS, whole_statistics(ITEMS))
    for _ in range(60):
        terms = sorted(RNG.sample(range(len(index.terms)), RNG.randint(1, 120)))
        score = np.zeros(index.n)
        for t in terms:
            score[index.item[index.first[t] : index.first[t + 1]]] += index.weight[index.first[t] : index.first[t + 1]]
        for least in (0.1, 0.35, 0.7):
            got = sorted(i for i, _ in index.retrieve(terms, least))
            assert got == [i for i in range(index.n) if score[i] >= least - 1e-12 and score[i] >= least]


def brute(rows, items=ITEMS, retrieve=0.35, whole=0.5, part=0.25):
    """Every item against every passage from plain dictionaries: BM25 over pairs, then trigrams of the whole, the question and the answer."""
    real = [(i, t, low(t)) for i, t in items if i is not None and low(t)]
    long = [x for x in real if len(x[2]) >= 3]
    two = lambda v: [*zip(v, v[1:], strict=False)]
    three = lambda v: [*zip(v, v[1:], v[2:], strict=False)]
    df, n = Counter(g for x in long for g in {*two(x[2])}), len(long)
    mean = sum(len(x[2]) for x in long) / max(n, 1)
    span = max(128, 2 * max((len(x[2]) for x in long), default=0))
    span += span % 2
    weights = []
    for _, _, v in long:
        w = {g: math.log(1 + (n - df[g] + 0.5) / (df[g] + 0.5)) * tf * (dc.K1 + 1) / (tf + dc.K1 * (1 - dc.B + dc.B * len(v) / mean)) for g, tf in Counter(two(v)).items()}
        weights.append({g: x / sum(w.values()) for g, x in w.items()})
    out = []
    for d, t in rows:
        w, hit = low(t), set()
        hit |= {i for i, _, v in real if len(v) < 3 and v == w}
        for p in range(max(-(-len(w) // (span // 2)) - 1, 1)):
            window = w[p * span // 2 : p * span // 2 + span]
            pairs, grams = {*two(window)}, {*three(window)}
            for (i, text, v), weight in zip(long, weights, strict=True):
                if sum(x for g, x in weight.items() if g in pairs) < retrieve:
                    continue
                mark = text.encode().find(b"?")
                q = sum(m.start() <= mark for m in re.finditer(rb"[^ \t-\r]+", text.encode())) if 0 <= mark < len(text.encode()) - 1 else -(-len(v) // 2)
                found = [g in grams for g in three(v)]
                share = lambda x: sum(x) / len(x) if x else 1.0
                if share(found) >= whole and share(found[:q]) >= part and share(found[q:]) >= part:
                    hit.add(i)
        out.append((d, sorted(hit)))
    return out


def test_finds_items_that_texts_hold_and_no_others(spark, docs_of):
    fill = lambda n: " ".join(f"x{RNG.randrange(5000)}" for _ in range(n))
    long = [x for x in ITEMS if x[0] is not None and len((x[1] or "").split()) >= 6]
    rows = [(k, f"{fill(RNG.randint(0, 700))} {RNG.choice(long)[1].upper()}\n{fill(RNG.randint(0, 300))}") for k in range(60)]
    rows += [(100 + k, fill(RNG.randint(0, 300))) for k in range(20)] + [(500, None), (501, ""), (None, long[0][1]), (7, long[1][1]), (7, long[1][1])]
    rows.append((600, " ".join(long[3][1].split()[: len(long[3][1].split()) // 3])))
    for k in range(80):  # parts of items, with words changed
        v = RNG.choice(long)[1].split()
        v = [w if RNG.random() < 0.9 else "other" for w in v[RNG.randint(0, 3) : len(v) - RNG.randint(0, len(v) // 2)]]
        rows.append((700 + k, f"{fill(RNG.randint(0, 200))} {' '.join(v)} {fill(RNG.randint(0, 200))}"))
    rows += [(900 + i, t) for i, t in enumerate(["w1", "W2  w3", "w2 w3 w4", " ".join(VOCAB) * 3])]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for size in (1 << 24, 3000):
        got = dc.contaminated(docs_of(rows), bench, chunk_bytes=size).select("doc_id", "benchmark_items").collect()
        assert sorted(((r[0], r[1]) for r in got), key=str) == sorted(brute(rows), key=str)


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r["benchmark_items"] for r in dc.contaminated(docs_of([(1, "a b c")]), bench).collect()] == [[]]
    assert dc.contaminated(docs_of([]), spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []


def test_bounds_are_summed_in_slices(monkeypatch):
    """A text of very many passages asks for no more than CELLS at a time, and gives the same."""
    index = dc.Index(ITEMS, whole_statistics(ITEMS))
    text = " ".join(RNG.choice(ITEMS[:90])[1] + " " + " ".join(f"x{RNG.randrange(5000)}" for _ in range(90)) for _ in range(300)).encode()
    data, off = np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)])
    want = dc.passages_hit(data, off, index, 128, 0.35, 0.5, 0.25)
    monkeypatch.setattr(dc, "CELLS", 7)
    assert dc.passages_hit(data, off, index, 128, 0.35, 0.5, 0.25) == want and len(want[0]) > 50


def test_query_columns(spark, tmp_path):
    rows = [(1, "see: is w1 the w2? w3 it is w4 w5 now"), (2, None), (None, "w1"), (1, "nothing here")]
    spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n_items int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = dc.op7_decontaminate(spark, str(tmp_path))
    assert got.columns == ["doc_id", "contaminated", "n_items", "item_ids"]
    want = [(d, bool(hit), len(hit), ",".join(map(str, hit))) for d, hit in brute(rows)]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
