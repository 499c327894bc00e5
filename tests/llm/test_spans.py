"""Personal data and secrets: base spans against whole-text regular expressions; packing against a round trip."""

import random
import re
import zlib

import numpy as np
import pytest
from lectern.llm import packing, pii, secret_scan
from pyspark.sql import functions as F

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_pii(t):
    out = [("email", *m.span()) for m in _EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in _IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(t):
        d = re.sub("[ -]", "", m.group())
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in _PHONE.finditer(t) if 8 <= len(re.sub(r"\D", "", m.group())) <= 15]


def base_secrets(t):
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(secret_scan.KINDS[k], a, b) for a, k, b in sorted(out)]


def texts(parts, n, seed):
    rng = random.Random(seed)
    return [None, "", "é" * 500, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 50))) for _ in range(n))]


def test_pii_base_spans(docs_of):
    rows = list(enumerate(texts(["1", "2", "25", ".", "-", " ", "+", "(", ")", "a", "@", "b.c", "@x.y", "é", "255", "4111111111111111", "account no. 1234567", "http://u:p@h.com"], 1500, 1)))
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find_pii(docs_of([*rows, (None, "a@b.c")])).collect()}
    assert got.pop(None) == [("email", 0, 5)]
    for d, t in rows:
        assert [s for s in got[d] if s[0] in pii.KINDS[: pii.BASE]] == base_pii(t or "")


def test_pii_extra_spans_and_redaction(docs_of):
    t = "See http://me:pw@host.org/x, account no. 12345678, mail a.b@c.de now"
    df = docs_of([(1, t), (2, "clean"), (3, None)])
    kinds = [s["kind"] for s in pii.find_pii(df).where("doc_id = 1").first()["spans"]]
    assert {"url", "account", "email"} <= set(kinds)
    out = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert out[1]["text"] == "See <EMAIL>/x, account no. <ACCOUNT>, mail <EMAIL> now" or "<URL>" in out[1]["text"]
    assert "12345678" not in out[1]["text"] and "a.b@c.de" not in out[1]["text"] and "me:pw" not in out[1]["text"]
    assert out[1]["n_chars"] == len(out[1]["text"]) and out[2]["text"] == "clean" and out[3]["text"] is None
    assert pii.redact(df).columns == df.columns


def test_secret_base_spans(docs_of):
    parts = ["password", "TOKEN", "secret", "api_key", "apikey", "ſecret", ":", "=", " ", '"', "'", "a", "f00d" * 3, "é", "AKIA", "ABCDEF0123456789", "\n", ",", "0123456789abcdef"]
    rows = list(enumerate(texts(parts, 1500, 2)))
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secret_scan.find_secrets(docs_of([*rows, (None, "f" * 24)])).collect()}
    assert got.pop(None) == [("hex", 0, 24)]
    for d, t in rows:
        assert [s for s in got[d] if s[0] in secret_scan.KINDS[: secret_scan.BASE]] == base_secrets(t or "")


def test_secret_extra_spans_and_empty(docs_of):
    t = "-----BEGIN RSA PRIVATE KEY-----\nghp_" + "A1b2" * 9 + " xoxb-123456789-abcdef"
    kinds = {s["kind"] for s in secret_scan.find_secrets(docs_of([(1, t)])).first()["spans"]}
    assert kinds == {"private_key", "forge_token", "chat_token"}
    assert secret_scan.find_secrets(docs_of([])).collect() == [] and pii.find_pii(docs_of([])).collect() == []


_MORE = (re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----"), re.compile("gh[opsu]_[A-Za-z0-9]{36}"), re.compile("xox[abpr]-[0-9]{6,}(?:-[A-Za-z0-9]+)+"))


def all_secrets(t):
    found = [(a, secret_scan.KINDS.index(k), b) for k, a, b in base_secrets(t)]
    found += [(m.start(), secret_scan.BASE + k, m.end()) for k, e in enumerate(_MORE) for m in e.finditer(t) if m.end() - m.start() >= secret_scan.RULES[secret_scan.BASE + k][3]]
    return [(secret_scan.KINDS[k], a, b) for a, k, b in sorted(found)]


def test_all_secret_spans_equal_whole_text_expressions():
    """Every kind, in texts with and without reset bytes, longer than a piece, and with states that are carried over many."""
    rng = random.Random(7)
    parts = ["token", "secret", "pass", "word", "passwd", "=", ":", " ", "  ", '"', "a", "f0", "0123456789abcdef" * 2, "AKIA", "ABCDEFGH23456789", "ghp_", "A1b2" * 9, "xoxb-", "1234567", "-", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "é", ",", "\n"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 120))) for _ in range(3000)]
    bare = [p for p in parts if p not in (",", "\n", "é")]
    cases += ["".join(rng.choice(bare) for _ in range(rng.randint(500, 4000))) for _ in range(60)]
    cases += ["token" + " " * 40_000 + "= abcdefgh tail", "x" * 5000 + "secret:" + " " * 9000 + "zzzzzz", "a" * 20_000, "token=token:abcdefgh", "token=token=abcdef", "AKIA" * 10 + " AKIA" + "B" * 15]
    scanner = secret_scan.Scanner(*secret_scan.compiled())
    raw = [c.encode() for c in cases]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = scanner.spans(np.frombuffer(b"".join(raw), dtype=np.uint8), off)
    for k, c in enumerate(cases):
        assert got.get(k, []) == all_secrets(c), c[:200]


def test_long_lines_without_reset_bytes_take_linear_time():
    import time

    scanner = secret_scan.Scanner(*secret_scan.compiled())
    for text in ("abc def \"x\" 123 " * 400_000, "token" + " " * 4_000_000 + "= abcdefgh", "b" * 4_000_000, "token token= " * 400_000):
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        begun = time.process_time()
        got = scanner.spans(raw, np.array([0, len(raw)]))
        assert time.process_time() - begun < 40
        assert got.get(0, []) == all_secrets(text)


def test_span_query_columns(spark, tmp_path):
    """All columns of both queries, for nulls, repeated rows, offsets behind wide letters, and columns that clash."""
    import hashlib

    rows = [(1, "é token=abcdef1 mail a.b@c.de, 10.0.0.1"), (2, None), (2, ""), (None, "x" * 3), (1, "é token=abcdef1 mail a.b@c.de, 10.0.0.1"), (3, "card 4111 1111 1111 1111 tel +49 30 1234567 key " + "ab01" * 8)]
    spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, spans string, kind int").write.parquet(f"{tmp_path}/documents.parquet")
    line = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    sha = lambda spans: hashlib.sha256(line(spans).encode()).hexdigest()
    for query, kinds, base, key in ((pii.op5_pii, pii.KINDS[: pii.BASE], base_pii, None), (secret_scan.op9_secrets, secret_scan.KINDS[: secret_scan.BASE], base_secrets, None)):
        got = query(spark, str(tmp_path))
        assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), *((f"n_{k}", "bigint") for k in kinds), ("base_sha256", "string"), ("spans", "string")]
        want = [(d, *(sum(s[0] == k for s in base(t or "")) for k in kinds), sha(base(t or ""))) for d, t in rows]
        got = got.collect()
        assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted(want, key=str)
        for r in got:
            spans = [tuple(x.split(":")) for x in r["spans"].split(",")] if r["spans"] else []
            text = next((t or "") for d, t in rows if d == r["doc_id"] and sha(base(t or "")) == r["base_sha256"])
            assert set(base(text)) <= {(k, int(a), int(b)) for k, a, b in spans}


@pytest.mark.parametrize("window", [1 << 20, 3000])
def test_packing_round_trip(docs_of, window):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    rows = [(i, " ".join(f"word{rng.randrange(900)}é" for _ in range(rng.choice([0, 1, 30, 400, 3000])))) for i in range(60)] + [(900, None), (901, "a<|endoftext|> b"), (None, "null id"), (5000, "\n\n  x")]
    pieces = packing.pack_documents(docs_of(rows).repartition(3), window=window).collect()
    ids = {d: [*Tokenizer.from_file(packing.default_tokenizer()).encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    seen, sequences = {}, {}
    for p in pieces:
        part = np.frombuffer(p["token_ids"], dtype="<u4")
        assert len(part) == p["length"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        assert part.tolist() == ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        seen.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], p["capacity"]))
    for d, parts in seen.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == len(ids[d])
    assert set(seen) == set(ids)
    for parts in sequences.values():
        at = 0
        for o, n, _ in sorted(parts):
            assert o == at
            at += n
        assert at == parts[0][2] <= 2048 and at & (at - 1) == 0  # full: a power of two, 2048 among them
    crc = packing.pack_documents(docs_of([(1, "abc")])).select(F.crc32("token_ids").alias("c"), "token_ids").first()
    assert crc["c"] == zlib.crc32(bytes(crc["token_ids"]))


def test_packing_balances_cost():
    """Each tail, by falling cost, is in the sequence that was cheapest among those with room; no sequence stays far behind."""
    rng = random.Random(8)
    tails = [(i, rng.randint(1, 2000)) for i in range(300)]
    cost = lambda n: n + n * n / 2048
    sizes, pieces = packing.place(tails, 2048, 1.0, 1 / 2048)
    assert sum(sizes) == sum(n for _, n in tails) and all(n & (n - 1) == 0 for n in sizes)
    room, spent, last = list(sizes), [0.0] * len(sizes), 5000
    for tail, first, n, seq, offset in pieces:
        whole = dict(tails)[tail]
        left = whole - first
        fits = [k for k, r in enumerate(room) if r >= left]
        assert n == left and spent[seq] == min(spent[k] for k in fits) if fits else n == room[seq] == max(room)
        assert offset == sizes[seq] - room[seq] and (first > 0 or whole <= last)
        last = whole
        room[seq] -= n
        spent[seq] += cost(n)
    assert not any(room)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, " \n\t" * 600_000 + "end", "x" + " " * 900_000 + "<|endoftext|>" + "\n" * 900_000 + "don't stop\x1f " + "\u2003" * 700_000 + "\u0301é"])
def test_very_long_runs_are_encoded_as_the_contract_says(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    got = packing.encoder(*packing.byte_level_vocabulary(path))(text)
    assert got.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_packing_query_with_a_very_long_text(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(1, "short"), (2, " " * 1_200_000), (2, "short"), (None, None)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op8_packing(spark, str(tmp_path))
    want = {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    assert {f.name: f.dataType.simpleString() for f in got.schema if f.name in want} == want
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows]
    crc = lambda part: zlib.crc32(np.array(part, dtype="<u4").tobytes())
    got = got.collect()
    assert sum(r["length"] for r in got) == sum(map(len, ids))
    for (d, _), x in zip(rows, ids, strict=True):
        assert sum(r["doc_id"] == d and r["doc_tokens"] == len(x) and r["ids_crc32"] == crc(x[r["start"] : r["start"] + r["length"]]) for r in got) >= -(-len(x) // 2048)


def test_empty_table(docs_of):
    assert packing.pack_documents(docs_of([])).collect() == []
