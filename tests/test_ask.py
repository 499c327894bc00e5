"""Questions from end to end: responses, citations, log rows and the cache."""

import pytest

from lectern.operators import answers, ask

SAID = {
    1: "الصبر عند الصدمة الأولى هو الأصل في كل أمر. وبعده كلام آخر لا يقال هنا",
    2: "الشكر زيادة في النعمة وحفظ لها من الزوال دائما. ثم كلام",
    3: "الصبر والشكر جناحان للمؤمن في سيره إلى ربه. تمام الكلام",
}


@pytest.fixture
def tables(spark):
    words, chunks, passages = [], [], []
    for t, text in SAID.items():
        toks = text.split()
        words += [(t, i, w, i * 500, i * 500 + 400) for i, w in enumerate(toks)]
        chunks.append((t, 0, text, len(toks), 0, len(toks) * 500))
        passages.append((t * 10, text, t, t + 100, 0, 0))
    return {
        "passages": spark.createDataFrame(passages, "id long, text string, transcript long, segment long, chunk_start long, chunk_end long"),
        "chunks": spark.createDataFrame(chunks, "transcript long, idx long, text string, words long, start_ms long, end_ms long"),
        "words": spark.createDataFrame(words, "transcript long, idx long, text string, start_ms long, end_ms long"), "verses": spark.createDataFrame([(2, 155)], "surah int, ayah int"),
    }


def questions(spark, *rows):
    return spark.createDataFrame(rows, "question_id long, question string, at long")


def test_many_questions_at_once(spark, tables):
    responses, log = ask.ask(questions(spark, (1, "ما الصبر", 1000), (2, "زيادة النعمة", 1000), (3, "لا شيء يوافق", 1000)), **tables)
    got = {r["question_id"]: r for r in responses.collect()}
    assert got[2]["status"] == "answered" and got[2]["kept"] == 1 and not got[2]["cache_hit"]
    [c] = got[2]["citations"]
    assert (c["segment"], c["start_ms"], c["url"]) == (102, 0, "/listen/102?t=0") and c["quote"].startswith("الشكر زيادة") and "[1]" in got[2]["answer_md"]
    assert {c["segment"] for c in got[1]["citations"]} == {101, 103}
    assert got[3]["status"] == "not_found" and got[3]["answer_md"] == answers.NOT_FOUND_TEXT and got[3]["citations"] == []
    rows = {r["question_id"]: r for r in log.collect()}
    assert rows[2]["candidates"] == rows[2]["reranked"] == [20] and rows[2]["weak"] and rows[2]["drafted"] == 1
    assert rows[1]["reranked"][0] in (10, 30) and rows[3]["candidates"] is None and rows[3]["status"] == "not_found"


def test_scores_drop_and_order_passages(spark, tables):
    scores = spark.createDataFrame([(1, 10, 1.0, 0), (1, 30, 3.0, 1), (1, 30, 0.0, 2)], "question long, id long, score double, order int")
    _, log = ask.ask(questions(spark, (1, "الصبر", 0)), scores=scores, **tables)
    [r] = log.collect()
    assert r["reranked"] == [30, 10] and r["weak"]  # one good passage is too few, so the next one fills


def test_cache_serves_until_it_expires(spark, tables):
    responses, log = ask.ask(questions(spark, (1, "زيادة النعمة", 1000)), **tables)
    old = responses.join(log.select("question_id", "question_hash", "at"), "question_id").select("question_hash", "at", "status", "answer_md", "citations", "ayah_refs", "kept")
    later, rows = ask.ask(questions(spark, (7, "زِيَادَة  النعمة", 2000), (8, "زيادة النعمة", 1000 + ask.CACHE_TTL_MS), (9, "زيادة النعمة", 500)), cache=old, **tables)
    got = {r["question_id"]: (r["cache_hit"], r["answer_md"]) for r in later.collect()}
    assert {k: v[0] for k, v in got.items()} == {7: True, 8: False, 9: False} and len({v[1] for v in got.values()}) == 1
    assert {r["question_id"]: r["cache_hit"] for r in rows.collect()} == {7: True, 8: False, 9: False}
