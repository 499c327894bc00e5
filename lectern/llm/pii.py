"""Operator 5: personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, ``+digit``, digit pairs
(adjacent or with one separator), ``scheme://`` with a user part, and identifier cues such as
``account``. A deterministic local parser then expands each anchor to the boundaries of its kind
and validates it. Since a span holds only characters of its kind, an anchor's maximal region of those
characters holds all spans through it, so results are those of a scan of the whole text.

Kinds, in order: email, ip, card, phone (the base), then url (credentials in a link) and account
(an identifier of at least six characters, five of them digits, behind a cue).

Offsets are code points, ends exclusive. Defined results: a null text counts as empty and has no spans;
a null ``doc_id`` stays null; repeated rows each give a row; other columns are kept by ``redact`` and
ignored by ``find_pii``; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_IP_REGION = re.compile(r"[0-9.]*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_CARD_REGION = re.compile(r"[0-9 -]*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s/?#@:\"'<>]+:[^\s/?#@\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
_ACCOUNT = re.compile(r"(?:s|\.)?(?:[ ]+(?:no\.?|number|id))?[ ]*[:#=]?[ ]*([A-Za-z]{0,4}[0-9][A-Za-z0-9-]*[A-Za-z0-9])")
_CUES = ("account", "acct", "iban", "passport", "ssn")
_SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "redis://", "mongodb://")
_DIGITS = "0123456789"


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    for x in _DIGITS:
        a.add_word("+" + x, ("phone", 2))
        for y in _DIGITS:
            a.add_word(x + y, ("card", 2))
            a.add_word(x + " " + y, ("card", 3))
            a.add_word(x + "-" + y, ("card", 3))
            a.add_word(x + "." + y, ("ip", 3))
    for s in _SCHEMES:
        a.add_word(s, ("url", len(s)))
    for c in _CUES:
        for form in {c, c.capitalize(), c.upper()}:
            a.add_word(form, ("account", len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d)
        if i % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _left(text: str, at: int, low: int, allowed) -> int:
    while at > low and text[at - 1] in allowed:
        at -= 1
    return at


def spans_of(text: str, machine) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind as listed, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in machine.iter(text):
        first = last + 1 - size
        if first < done[kind] and kind not in ("email", "account"):
            continue
        if kind == "email":
            m = _DOMAIN.match(text, last + 1)
            if m:
                start = _left(text, last, done["email"], _LOCAL)
                if start < last:
                    found["email"].append((start, m.end()))
                    done["email"] = m.end()
        elif kind == "ip":
            low = _left(text, first, done["ip"], "0123456789.")
            high = _IP_REGION.match(text, first).end()
            for m in _IP.finditer(text, low, high):
                if all(len(p) <= 3 and int(p) <= 255 or len(p) > 3 and len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m.groups()):
                    found["ip"].append(m.span())
            done["ip"] = high
        elif kind == "card":
            low = _left(text, first, done["card"], "0123456789 -")
            high = _CARD_REGION.match(text, first).end()
            for m in _CARD.finditer(text, low, high):
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
            done["card"] = high
        elif kind == "phone":
            m = _PHONE.match(text, first)
            if m:
                if 8 <= sum(c in _DIGITS for c in m.group()) <= 15:
                    found["phone"].append(m.span())
                done["phone"] = m.end()
        elif kind == "url":
            m = _URL.match(text, last + 1)
            if m:
                found["url"].append((first, m.end()))
                done["url"] = m.end()
        else:
            before = first == 0 or not text[first - 1].isalnum()
            m = _ACCOUNT.match(text, last + 1)
            if before and m and m.start(1) >= done["account"] and m.start(1) > last + 1 and len(m.group(1)) >= 6 and sum(c in _DIGITS for c in m.group(1)) >= 5:
                found["account"].append(m.span(1))
                done["account"] = m.end(1)
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``, an array of (kind, start, end)."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t.as_py() or "", machine)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=span)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by ``<KIND>``; of overlapping spans the hull is replaced under the first one's kind. ``n_chars`` follows the text if it is there."""
    at = docs.columns.index("text")
    counts = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            texts, lengths = [], batch.column(counts).to_pylist() if counts is not None else None
            for i, cell in enumerate(batch.column(at)):
                text = cell.as_py()
                spans = sorted((a, -b, k) for k, a, b in spans_of(text or "", machine))
                if spans:
                    out, end = [], 0
                    for a, b, k in spans:
                        if a >= end:
                            out += [text[end:a], f"<{k.upper()}>"]
                        end = max(end, -b)
                    text = "".join(out) + text[end:]
                    if lengths is not None:
                        lengths[i] = len(text)
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, type=batch.schema.field(at).type)
            if counts is not None:
                columns[counts] = pa.array(lengths, type=batch.schema.field(counts).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:BASE]))
    return found.select("doc_id", *(count(k) for k in KINDS[:BASE]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
