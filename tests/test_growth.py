"""Steps whose disk, memory or time grew faster than their input."""

import unicodedata

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import alignment, arabic
from lectern.operators import answers, ask, smart


def test_composed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(arabic, "PIECE", 16)
    texts = ["plain", None, "", "é", "é" * 30, "آ", "x" * 40, "å b"]
    want = [t if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert arabic._composed(pa.array(texts)).to_pylist() == want
    assert arabic._composed(pa.array([], pa.string())).to_pylist() == []
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [r["t"] for r in rows.select(arabic.composed(F.col("t")).alias("t")).collect()] == want
    lists = spark.createDataFrame([(0, texts), (1, None), (2, []), (3, ["é"])], "i int, t array<string>").orderBy("i")
    assert [r["t"] for r in lists.select(arabic.composed_each(F.col("t")).alias("t")).collect()] == [want, None, [], ["é"]]


def test_plain_text_is_not_sent_to_python(spark):
    sent = spark.createDataFrame([("plain é",), ("é",)], "t string").select(F.when(F.col("t").rlike(arabic.MAY_COMPOSE), F.col("t")).alias("t"))
    assert [r["t"] for r in sent.collect()] == [None, "é"]


def test_spans_of_many_answers_are_gathered_once(spark):
    said = ["One", "two é b a", None, " ", "five", "six"]
    words = spark.createDataFrame([(7, i, w, i * 500, i * 500 + 400) for i, w in enumerate(said)], "transcript long, idx long, text string, start_ms long, end_ms long")
    spans = spark.createDataFrame([(7, 0, 10_000)], "transcript long, _a long, _b long")
    [row] = answers.span_tokens(spans, words).collect()
    # tokens of one word are sorted, as they were when each was a row
    assert row["text"] == "One a b two é five six" and [t["idx"] for t in row["tokens"]] == [0, 1, 1, 1, 1, 4, 5]
    passages = spark.createDataFrame([(a, "p1", 9, 7, 0, 10_000) for a in range(50)], "answer long, passage string, segment long, transcript long, start_ms long, end_ms long")
    cited = spark.createDataFrame([(a, 1, "p1", "two é five") for a in range(50)], "answer long, pos int, passage string, quote string")
    got = answers.checked_citations(cited, passages, words)
    assert {(r["n"], r["start_ms"], r["end_ms"], r["segment"]) for r in got.collect()} == {(1, 500, 2400, 9)} and got.count() == 50


def test_a_quote_is_looked_for_once_in_a_span(spark, monkeypatch):
    looked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("first_word int, last_word int")
    def counted(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
        looked.add(len(quote))
        got = [alignment.find_span_of(q, t) or (None, None) for q, t in zip(quote, text, strict=True)]
        return pd.DataFrame({"first_word": pd.array([g[0] for g in got], dtype="Int32"), "last_word": pd.array([g[1] for g in got], dtype="Int32")})

    monkeypatch.setattr(answers, "find_span", counted)
    words = spark.createDataFrame([(7, i, w, i * 500, i * 500 + 400) for i, w in enumerate("one two three four".split())], "transcript long, idx long, text string, start_ms long, end_ms long")
    passages = spark.createDataFrame([(a, p, 9, 7 if p == "p1" else 8, 0, 10_000) for a in range(50) for p in ("p1", "p2")], "answer long, passage string, segment long, transcript long, start_ms long, end_ms long")
    drafted = [("p1", "two three four"), ("p1", "two"), ("p1", "not said here"), ("p1", None), ("p2", "two three four"), ("p3", "two three four"), ("p1", "one two three")]
    cited = spark.createDataFrame([(a, k, p, q) for a in range(50) for k, (p, q) in enumerate(drafted)], "answer long, pos int, passage string, quote string")
    got = answers.checked_citations(cited, passages, words).collect()
    want = [(0, None, 1, 9, 500, 1900, "two three four"), (1, "length of quote", None, 9, None, None, None), (2, "quote not found", None, 9, None, None, None), (3, "quote not found", None, 9, None, None, None),
            (4, "quote not found", None, None, None, None, None), (5, "unknown passage", None, None, None, None, None), (6, None, 2, 9, 0, 1400, "one two three")]
    assert len(got) == 350 and sorted({(r["pos"], r["problem"], r["n"], r["segment"], r["start_ms"], r["end_ms"], r["quote_display"]) for r in got}, key=lambda x: x[0]) == want
    assert looked.value <= len(drafted)  # before: a row for each of the 350


def test_what_a_generator_reads_is_made_once_for_a_text(spark):
    chunks = spark.createDataFrame([(7, 0, "one two. three", 3, 0, 900)], "transcript int, idx int, text string, words int, start_ms int, end_ms int")
    windows = spark.createDataFrame([(q, 7, 1, 7, 7, 0, 0, 0, 0) for q in range(40)], "question int, window int, priority int, transcript int, segment int, a int, b int, seed_a int, seed_b int")
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def first(text):
        made.add(1)
        return text[:3]

    got = smart.context(windows, chunks, reads={"quote": first}).collect()
    assert len(got) == 40 and {(r["passage"], r["quote"]) for r in got} == {("p1", "one")} and "text" not in got[0] and made.value == 1
    whole = smart.context(windows, chunks).withColumnRenamed("question", "question_id")
    assert {r["quote"] for r in ask.extractive(whole)[1].collect()} == {r["quote"] for r in ask.extractive(whole.withColumn("quote", ask.first_words(F.col("text"))).drop("text"))[1].collect()} == {"one two."}


def test_texts_of_windows_pass_no_sort(spark):
    chunks = spark.createDataFrame([(t, 0, f"t{t}", 3000, 0, 900) for t in range(9)], "transcript int, idx int, text string, words int, start_ms int, end_ms int")
    windows = spark.createDataFrame([(t, t, t, 7, 0, 0, 0, 0) for t in range(9)], "window int, priority int, transcript int, segment int, a int, b int, seed_a int, seed_b int")
    got = smart.context(windows, chunks)
    assert [(r["passage"], r["text"]) for r in got.collect()] == [("p1", "t0")]
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("quote", "text"), [("two é", "one two é three two é"), ("abc", "abc"), ("3333 444", "some words of prose without a digit"), ("words of prose", "some word of prose")])
def test_spans_without_windows(quote, text, monkeypatch):
    """What is found word for word, or cannot be found by its letters, needs no window; the ratio stays that of all windows."""
    want = max(((r, -k) for k, (a, b) in enumerate(zip(*alignment._windows(len(quote), len(text)), strict=True)) if (r := 200.0 * _common(quote, text[a:b]) / (len(quote) + b - a)) >= 90), default=(0.0, 0))
    if quote in text or not want[0]:
        monkeypatch.setattr(alignment, "_windows", None)
    assert alignment._one_way(quote, text, 90.0)[0] == want[0]


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_stretches_that_cannot_hold_a_verse(monkeypatch):
    """A verse whose tokens a document has, but nowhere close together, is not aligned; one that lies across two blocks is."""
    verse = [f"v{k}" for k in range(10)]
    far = [w for v in verse for w in [v] + ["x"] * 60]
    near = ["x"] * 27 + [w for v in verse for w in (v, "y")] + ["x"] * 50
    assert alignment.anchors(near, [(1, verse)]) == [(1, 27, 46, 10)]
    monkeypatch.setattr(alignment, "alignments", None)
    assert alignment.anchors(far, [(1, verse)]) == []


def test_verses_by_codes(spark):
    verses = [(1, "a b c d e".split()), (2, ["a", "", None, "b", "c"]), (1, "p q r s".split()), (3, "only here".split())]
    docs = [(0, "x a b c d e y".split()), (1, None), (2, []), (3, "p q r s a b c".split()), (4, ["a", None, "", "b", "c", "only"])]
    df = spark.createDataFrame(docs, "doc int, toks array<string>").coalesce(1)
    got = alignment.verse_anchors(df, spark.createDataFrame(verses, "verse int, tokens array<string>").where("verse < 3"), "doc", "toks").collect()
    want = {d: alignment.anchors([w or "" for w in t or []], [(v, [w or "" for w in s]) for v, s in verses if v < 3]) for d, t in docs}
    assert {r["doc"]: [tuple(x) for x in r["anchors"]] for r in got} == want and want[0] and want[3]
