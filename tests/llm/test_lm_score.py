import math
import re
import zlib
from collections import Counter

import pytest
from lectern.llm import lm_score


def brute(rows):
    toks = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, (_, t) in enumerate(rows)}
    out = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    c = Counter(w for i, ws in toks.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((d if d is not None else -1, out[i], len(toks[i]), sum(c[w] > 0 for w in toks[i]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks[i]), 6)) for i, (d, _) in enumerate(rows))


ROWS = [(i, f"The cat {i % 7} sat\non THE mat éÀ word{i % 40} tail{i}") for i in range(300)] + [(5000, None), (5001, ""), (None, "null id"), (7, "a " * 4000), (7, "a " * 4000), (7, "other text of the same id")]


def test_base_scores_equal_brute_force(docs_of):
    got = sorted((r[0] if r[0] is not None else -1, r[1], r[2], r[3], r[4], round(r[5], 6)) for r in lm_score.score_documents(docs_of(ROWS), bucket_bytes=500).collect())
    assert got == brute(ROWS)


def test_model_beats_the_base_on_held_out_documents(docs_of):
    rows = lm_score.score_documents(docs_of(ROWS)).collect()
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_empty_table(docs_of):
    assert lm_score.score_documents(docs_of([])).collect() == []


class Model:
    """The model from plain dicts."""

    def __init__(self, streams, least=2, discount=0.5, prior=2.0):
        self.c = Counter(tuple(s[i : i + n]) for s in streams for n in (1, 2, 3) for i in range(len(s) - n + 1))
        self.words = {g[0] for g in self.c if len(g) == 1} - {"<s>"}
        self.total = sum(self.c[(w,)] for w in self.words) + len(self.words) + 1
        self.least, self.discount, self.prior = least, discount, prior
        self.after = {}
        for g, n in self.c.items():
            if len(g) == 3 and n >= least:
                self.after.setdefault(g[:2], []).append(n)

    def p(self, g):
        if len(g) == 1:
            return (self.c[g] + 1) / self.total
        if len(g) == 2:
            return (self.c[g] + self.prior * self.p(g[1:])) / (self.c[g[:1]] + self.prior)
        if not self.c[g[:2]]:
            return self.p(g[1:])
        left = 1 - sum(n - self.discount for n in self.after.get(g[:2], ())) / self.c[g[:2]]
        own = (self.c[g] - self.discount) / self.c[g[:2]] if self.c[g] >= self.least else 0.0
        return own + left * self.p(g[1:])


def streams_of(rows):
    return [["<s>", *re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "</s>"] for _, t in rows]


def brute_scores(rows):
    out = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    streams = streams_of(rows)
    model = Model([s for s, o in zip(streams, out, strict=True) if not o])
    return sorted((str(d), round(sum(math.log10(model.p(tuple(s[max(0, i - 2) : i + 1]))) for i in range(1, len(s))), 6)) for (d, _), s in zip(rows, streams, strict=True))


def test_probabilities_sum_to_one():
    """Of the model that the operator is held against: over the vocabulary and one unknown word, behind any history."""
    model = Model(streams_of(ROWS[:60]))
    for history in (("<s>",), ("<s>", "the"), ("the", "cat"), ("cat", "3"), ("sat", "on"), ("never", "seen"), ("never",)):
        assert abs(sum(model.p((*history, w)) for w in [*model.words, "unknown"]) - 1) < 1e-9, history


@pytest.mark.parametrize("hot,bucket_bytes", [(1 / 1000, 50_000), (1 / 20, 2000), (1.0, 8 << 20)])
def test_scores_equal_the_plain_model(docs_of, monkeypatch, hot, bucket_bytes):
    """Whatever the buckets and the bigrams that are dealt apart; with ties, repeated rows, nulls and rare words of a larger corpus."""
    monkeypatch.setattr(lm_score, "HOT", hot)
    monkeypatch.setattr(lm_score, "CHUNK", 4000)
    rows = ROWS + [(6000 + i, "a b c d e f g h " * 1250) for i in range(6)]
    rows += [(7000 + i, f"quod erat demonstrandum ipso facto v{i}") for i in range(4)] + [(7100 + i, f"x y z{i % 2} a") for i in range(9)]
    frame = docs_of(rows).repartition(3).sortWithinPartitions("doc_id", "text").checkpoint()
    got = sorted((str(r["doc_id"]), round(r["score"], 6)) for r in lm_score.score_documents(frame, bucket_bytes=bucket_bytes).collect())
    want = brute_scores(rows)
    assert [g[0] for g in got] == [x[0] for x in want]
    assert max(abs(g[1] - x[1]) / max(1, abs(x[1])) for g, x in zip(got, want, strict=True)) < 1e-6


def test_query_columns(spark, tmp_path):
    rows = ROWS[:40] + ROWS[300:303]
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lm_score.op10_lm_score(spark, str(tmp_path))
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == ["doc_id bigint", "held_out boolean", "n_tokens bigint", "n_known bigint", "train_tokens bigint", "base_score double", "score double"]
    got = got.collect()
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == brute(rows)
    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in got) == brute_scores(rows)
