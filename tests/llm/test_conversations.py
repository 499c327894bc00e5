"""Operator 11 against a search over edits, and against its SQL."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from lectern.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
ROLE = {"u": "user:", "a": "assistant:"}
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(turns, faults):
    """(cost, audit, lines) by Dijkstra over (cost, audit)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(turns) and state in ("", "a"):
            return cost, audit, lines
        if (i, state) in done:
            continue
        done.add((i, state))
        changes = [r for r in NEXT[state] if r in ROLE]
        for r in changes:
            heapq.heappush(heap, (cost + 2, audit + "I", i, r, (*lines, ROLE[r])))
        if i == len(turns):
            continue
        _, role, text = turns[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
        if faults[i] in ("blank", "duplicate"):
            continue
        more = faults[i] == "truncated"
        if role and role[0] in NEXT[state]:
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*lines, f"{role}:{text}")))
        for r in changes:
            heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, r, (*lines, ROLE[r] + text)))


def plain(rows):
    """The contract in plain Python."""
    groups, out = {}, {}
    for conv, turn, role, text in rows:
        group = groups.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        fate = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        group += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        faults, seen = [], set()
        for _, role, text in turns:
            shown = re.sub("[ \t-\r]", "", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, lines = cheapest(turns, faults)
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(df):
    return {r[0]: tuple(r[1:]) for r in conversations.repair(conversations.damage(df)).collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for conv in [*range(250), None]:
        for t in range(rng.choice([1, 2, 3, 5, 8, 12])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "", "umpire"])
            out.append((conv, rng.choice([t, t, t, t, t + 1, None]), role, rng.choice(["a.", "b?", "c", "d!", "", "  ", "\n", None, "e. ", "f. ", "a.", "ü!"])))
    return out + out[:40] + out[:1] * 5


def test_equals_search(spark, rows):
    # extra columns of names that the operator uses itself
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n int, digest string").repartition(5)
    assert repaired(df) == plain(rows)


@pytest.mark.parametrize("block,fan", [(1, 2), (3, 2)])
def test_long_conversations_in_blocks(spark, rows, monkeypatch, block, fan):
    monkeypatch.setattr(conversations, "LONG", 6)
    monkeypatch.setattr(conversations, "BLOCK", block)
    monkeypatch.setattr(conversations, "FAN", fan)
    assert repaired(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_long_texts_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(conversations, "LONG_BYTES", 100_000)
    rows = [(1, t, ("user", "assistant")[t % 2], "word " * 30_000 + ".") for t in range(4)] + [(2, 1, "user", "hi.")] * 3000 + [(3, None, None, None)] * 3
    assert repaired(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_empty(spark):
    assert repaired(spark.createDataFrame([], SCHEMA)) == {}


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    df = conversations.op11_conversations(spark, sf)
    want = c.sql(conversations.SQL)
    assert want.columns == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
