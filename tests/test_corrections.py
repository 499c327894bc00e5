"""A log of corrections against a loop that applies one after the other to lists."""

import random

from lectern.operators.corrections import replay_corrections

WORDS = "transcript long, idx long, text string, start_ms long, end_ms long, confidence double"
CHUNKS = "transcript long, idx long, start_ms long, end_ms long"
LOG = "correction long, seq long, status string, transcript long, chunk long, word_start long, word_end long, suggested_text string"


def loop(words, chunks, log):
    """(edits, words, transcripts, chunks)."""
    now = {}
    for t, i, x, s, e, c in sorted(words):
        now.setdefault(t, []).append([i, x, s, e, c])
    span = {(t, i): (s, e) for t, i, s, e in chunks}
    edits, versions, hit = {}, {}, set()
    for cid, _, status, t, chunk, a, b, new in sorted(log, key=lambda r: (r[1], r[0])):
        new, rows = (new or "").split(), now.get(t, [])
        inside = [w[0] for w in rows if (t, chunk) in span and span[t, chunk][0] <= w[2] < span[t, chunk][1]]
        if status != "pending":
            problem = f"already {status}"
        elif not new:
            problem = "no words"
        elif b < a:
            problem = "end before start"
        elif not inside:
            problem = "chunk without words"
        elif a < min(inside) or b > max(inside):
            problem = "outside the chunk"
        elif sum(a <= w[0] <= b for w in rows) != b - a + 1:
            problem = "words missing"
        else:
            old = [w for w in rows if a <= w[0] <= b]
            s, e, n = old[0][2], old[-1][3], len(new)
            if n == len(old):
                made = [[w[0], x, w[2], w[3], None] for w, x in zip(old, new, strict=True)]
            else:
                marks = [s + (e - s) * k // n for k in range(n)] + [e]
                made = [[a + k, x, marks[k], marks[k + 1], None] for k, x in enumerate(new)]
            now[t] = [w for w in rows if w[0] < a] + made + [[w[0] + n - len(old), *w[1:]] for w in rows if w[0] > b]
            versions[t] = versions.get(t, 0) + 1
            hit |= {(t, i) for (u, i), (cs, ce) in span.items() if u == t and cs <= e and ce >= s}
            edits[cid] = (t, None, versions[t], len(old), n, s, e)
            continue
        edits[cid] = (t, problem, None, None, None, None, None)
    return edits, now, versions, {k: " ".join(w[1] for w in now[k[0]] if span[k][0] <= w[2] < span[k][1]) for k in hit}


def make(rng, transcripts, n_words, n_edits):
    words, chunks, log = [], [], []
    for t in range(transcripts):
        at = 0
        for i in range(n_words):
            at += rng.choice([0, 100, 300])
            words.append((t, i, f"w{t}.{i}", at, at + rng.choice([90, 400]), 0.5))
        mine = words[-n_words:]
        chunks += [(t, k, mine[10 * k][3], mine[min(10 * k + 10, n_words - 1)][3] + (k == (n_words - 1) // 10)) for k in range(-(-n_words // 10))]
    for c in range(n_edits):
        t, chunk = rng.randrange(transcripts + 1), rng.randrange(-(-n_words // 10) + 1)
        a = 10 * chunk + rng.randrange(-2, 12)
        log.append((c, c // 2, rng.choice(["pending"] * 9 + ["approved"]), t, chunk, a, a + rng.choice([-1, 0, 0, 1, 2, 3]), " ".join(f"n{c}.{k}" for k in range(rng.choice([0, 1, 1, 2, 3, 5]))) or rng.choice(["", None, "  "])))
    return words, chunks, log


def test_a_thousand_edits_equal_a_loop(spark):
    words, chunks, log = make(random.Random(6), 12, 60, 1000)
    edits, now, versions, rebuilt = loop(words, chunks, log)
    frames = [spark.createDataFrame(r, s).repartition(3) for r, s in ((words, WORDS), (chunks, CHUNKS), (log, LOG))]
    got = replay_corrections(*frames)
    assert {r["correction"]: (r["transcript"], r["problem"], r["version"], r["replaced"], r["written"], r["start_ms"], r["end_ms"]) for r in got["edits"].collect()} == edits
    assert {e[1] for e in edits.values()} >= {None, "already approved", "no words", "end before start", "chunk without words", "outside the chunk"}
    assert sorted(map(tuple, got["words"].collect()), key=str) == sorted(((t, *w) for t, rows in now.items() for w in rows), key=str)
    assert {r["transcript"]: (r["raw_text"], r["word_count"], r["version"]) for r in got["transcripts"].collect()} == {t: (" ".join(w[1] for w in now[t]), len(now[t]), v) for t, v in versions.items()}
    assert {(r["transcript"], r["idx"]): r["text"] for r in got["chunks"].collect()} == rebuilt


def test_no_log_changes_nothing(spark):
    words, chunks, _ = make(random.Random(7), 2, 12, 0)
    got = replay_corrections(spark.createDataFrame(words, WORDS), spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame([], LOG))
    assert sorted(map(tuple, got["words"].collect())) == sorted(words)
    assert got["edits"].count() == got["transcripts"].count() == got["chunks"].count() == 0
