"""Table-driven cases of comparison, phrases, quotes and anchors, and the chain without models."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import alignment, arabic, fuzzy
from lectern.operators import corpus, search, smart


@pytest.mark.parametrize(("a", "b", "d"), [("الصرب", "الصبر", 1), ("ca", "abc", 3), ("a", "", 1), ("abcdef", "abdcef", 1), ("", "", 0)])
def test_alignment_distance(a, b, d):
    assert fuzzy.alignment_distance(a, b) == d == fuzzy.alignment_distance(b, a)


def test_closed_form_of_one_edit(spark):
    words = ["abcd", "abdc", "abc", "abcde", "xbcd", "badc", "abcd"]
    df = spark.createDataFrame([(x, y) for x in words for y in words], "a string, b string")
    for r in df.select("a", "b", fuzzy.within_one_edit(F.col("a"), F.col("b")).alias("w")).collect():
        assert r["w"] == (fuzzy.alignment_distance(r["a"], r["b"]) <= 1), r


def test_query_parsing():
    assert search.parse_query('الصبر "عند الصدمة"') == [("الصبر", False), ("عند", True), ("الصدمه", True)]
    assert search.parse_query('a «b c» "d') == [("a", False), ("b", True), ("c", True), ("d", False)]
    assert search.parse_query("2:255") == [("2", False), ("255", False)]
    assert search.parse_query("") == []


def test_phrases_with_typo_and_stem_tiers(spark):
    docs = spark.createDataFrame([(1, "الصبر عند الصدمة"), (2, "بالصبر، عند الصدمه"), (3, "عند الصبر الصدمة"), (4, "الصبرر عند الصدمة"), (5, "x الصبر عند الصدمة الصبر عند")], "id int, text string")
    got = {r["doc"]: (r["stems"], r["typos"], r["start"], r["rank"]) for r in search.lexical_search(docs, "id", "text", "الصبر عند الصدمة").collect()}
    assert got == {1: (0, 0, 0, 1), 5: (0, 0, 1, 2), 4: (0, 1, 0, 3), 2: (1, 0, 0, 4)}
    strict = {r["doc"] for r in search.lexical_search(docs, "id", "text", '"الصبر عند"').collect()}
    assert strict == {1, 5}


def test_normal_form_is_idempotent(spark):
    df = spark.createDataFrame([("ٱلْحَمْدُ  لِلَّهِ آمِين ٣",), ("é à",), ("",)], "s string")
    once = df.select(arabic.normalize_index(F.col("s")).alias("s"))
    assert once.collect() == once.select(arabic.normalize_index(F.col("s")).alias("s")).collect()


def test_fusion_counts_repeats_once_and_keeps_their_places(spark):
    rows = [(0, 1, 7, 1.0), (0, 2, 7, 1.0), (0, 3, 8, 1.0), (1, 1, 8, 1.0)]
    got = [(r["id"], r["score"]) for r in sorted(search.fuse(spark.createDataFrame(rows, "list_index int, rank int, id long, weight double")).collect(), key=lambda r: r["place"])]
    assert got == [(8, round(1 / 63 + 1 / 61, 9)), (7, round(1 / 61, 9))]


@pytest.mark.parametrize(("quote", "text", "span"), [("the cat sat on the mat today with friends", "sat on the mat", (0, 3)), ("b c", "a b c d", (1, 2)), ("abcdefghij klm", "x abcdefghij kln y", (1, 2)), ("zzz", "a b", None), (None, "a", None)])
def test_quote_spans(quote, text, span):
    assert alignment.find_span_of(quote, text) == span


def test_anchors_mask_repeats_and_do_not_overlap():
    verse = "in the name of".split()
    doc = "in the name of x in the name of y in the".split()
    assert [(v, a, b) for v, a, b, _ in alignment.anchors(doc, [(1, verse)])] == [(1, 0, 4), (1, 5, 9)]
    assert alignment.anchors("a b".split(), [(1, verse)]) == []


def test_chain_without_models(spark):
    docs = spark.createDataFrame([(1, "the fox and the hound"), (2, "a hound"), (3, "nothing")], "id long, text string")
    rows = smart.smart_search(docs, "fox hound").collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["kept_place"])] == [1, 2]
    scored = smart.smart_search(docs, "fox hound", lambda q, p: p.select("id", F.when(F.col("id") == 2, 9.0).otherwise(1.0).alias("score"), F.lit(0).alias("order")))
    assert [(r["id"], r["weak"]) for r in sorted(scored.collect(), key=lambda r: r["kept_place"])] == [(2, True), (1, True)]


def test_plan_is_tidied(spark):
    verses = spark.createDataFrame([(2, 255), (1, 1)], "surah int, ayah int")
    p = smart.tidy(smart.Plan("سؤال", ["سُؤال", "ثان", " ثان"], ["k"] * 3, [(2, 255), (2, 999), (2, 255)], 200), verses)
    assert (p.rewrites, p.keywords, p.refs, p.surah) == (["ثان"], ["k"], [(2, 255)], None)


def test_stage_runner(spark):
    start = spark.range(1)
    stages = [("a", lambda d: d.withColumn("x", F.lit(1))), ("b", lambda d: None), ("c", lambda d: 1 / 0), ("d", lambda d: d)]
    assert [v.split(":")[0] for _, v in smart.run_stages(stages, start)] == ["processed", "skipped", "failed"]
    assert [n for n, _ in smart.run_stages(stages, start, "b")] == ["a", "b"]


def test_budget_over_all_documents_is_spent_as_by_a_loop(spark, tmp_path):
    """Small documents behind the first 200 still fit."""
    from lectern.plans.registry import queries

    sizes = [(i, 900 if i < 200 and i % 3 else 35_000 if i < 200 else 7) for i in range(1000)]
    spark.createDataFrame(sizes, "doc_id long, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spent, want = 0, []
    for i, n in sizes:
        if spent + n <= 36000:
            spent, want = spent + n, [*want, i]
    assert max(want) >= 200
    assert sorted(r["id"] for r in queries()["context_budget"](spark, str(tmp_path)).collect()) == want


def test_postings_are_not_shuffled_for_a_phrase(spark):
    post = spark.createDataFrame([(1, 0, "there"), (1, 1, "the"), (2, 0, "their"), (2, 1, "the"), (3, 0, "the")], "doc long, pos int, word string").repartition(2)
    got = search.phrase_match(post, [("there", False), ("the", True)])
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc"] for r in got.collect()) == [1]


def test_strict_verses_are_found_inside_their_texts(spark):
    v = spark.createDataFrame([(1, "of the", "of a the"), (2, "x of the", "the of"), (3, None, "of the"), (4, "of", "the")], "id long, uthmani string, imlaei string")
    got = corpus.verse_search(v, '"of the"')
    assert "posexplode" not in got._jdf.queryExecution().analyzed().toString()
    assert sorted((r["doc"], r["start"], r["attr"], r["rank"]) for r in got.collect()) == [(1, 0, "uthmani", 1), (2, 1, "uthmani", 2), (3, 0, "imlaei", 3)]


@pytest.mark.parametrize("frequent", [1, 2, 1000])
def test_top_pair_asks_for_frequent_words_only(spark, monkeypatch, tmp_path, frequent):
    from lectern.plans import text_queries

    monkeypatch.setattr(text_queries, "FREQUENT", frequent)
    folder = tmp_path.as_posix()
    spark.createDataFrame([(1, "a x a y a z a x"), (2, "p q p q p q"), (3, "z p q"), (4, None), (5, "")], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    assert text_queries.top_pair(spark, folder) == ["p", "q"]
