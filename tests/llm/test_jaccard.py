import random
import re

import pytest
from lectern.llm import jaccard


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    comp = {}
    for i, (d, _) in enumerate(rows):
        comp.setdefault(find(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in comp.items()}
    return sorted(((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 6, 9, 30, 60, 90]))]
        for _ in range(rng.choice([1, 2, 3, 8, 20])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w = w[: max(1, int(len(w) * rng.uniform(0.7, 1)))]
            rows.append((" ".join(w)))
    line = " ".join(vocab[:30])
    rows += [line + " " + " ".join(rng.choice(vocab) for _ in range(rng.choice([4, 8, 9, 10, 40]))) for _ in range(60)]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "One two"), (9004, "one  TWO"), (None, "one two"), (3, "repeated id"), (3, "repeated id"), (None, "lone null id here")]


@pytest.mark.parametrize("seed,part", [(1, 2048), (2, 4)])
def test_components_equal_brute_force(docs_of, seed, part):
    rows = corpus(seed)
    got = sorted(((r[0], r[1], r[2]) for r in jaccard.jaccard_components(docs_of(rows), part=part, bucket_bytes=2000).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(docs_of):
    assert jaccard.jaccard_components(docs_of([])).collect() == []


def test_query_columns_with_hot_nulls_and_a_long_text(spark, tmp_path):
    """A third of the rows without an id, many of them alike; a text of 300,000 words and a near copy of it."""
    rng = random.Random(6)
    long = [f"w{rng.randrange(50_000)}" for _ in range(300_000)]
    rows = [(i, t) for i, t in corpus(5)[:120]] + [(None, f"null copy number {i % 4} of a text with words") for i in range(60)] + [(7000, " ".join(long)), (7001, " ".join(long[:-3] + ["x"]))]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int").write.parquet(f"{tmp_path}/documents.parquet")
    got = jaccard.op6_jaccard(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert [r for r in got if r[0] is None or r[0] < 7000] == brute(rows[:-2])
    assert [r[2] for r in got if r[0] is not None and r[0] >= 7000] == [7000, 7000]
