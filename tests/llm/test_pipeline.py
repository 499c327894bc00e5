"""The pipeline against plain versions of its stages."""

import corpus_pipeline as cp
import pytest
from lectern.llm import packing, pii

from tests.llm.test_jaccard import brute as near_duplicates
from tests.llm.test_quality import corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(9)
    rows, labels = corpus(rng, 400)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows[10] = (10, rows[0][1] if labels[0][1] else "the of and tionth " * 9)
    clean = [i for i, q, _ in labels if q]
    for i in clean[20:24]:
        rows[i] = (i, rows[i][1] + " " + item)
    for i in clean[30:34]:
        rows[i] = (i, rows[i][1] + f" mail me{i}@mail.example.com")
    rows += [(5000, None), (5001, ""), (rows[clean[2]][0], rows[clean[2]][1]), (None, rows[clean[3]][1])]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, item


def test_rows_that_doc_id_does_not_tell_apart(docs_of, spark):
    """Of each group of linked rows one stays, whatever the ids; texts that have nothing in common stay though they share one."""
    one, two, lone = ("one two three four five six seven eight", "entirely other words that nothing here repeats", "a text of its own with no id at all")
    rows = [(7, one), (7, two), (9, two), (9, two), (9, "third text under the id of nine"), (8, one), (None, one), (None, lone), (None, lone), (None, lone + " "), (None, None), (3, ""), (3, ""), (5, "plain")]
    docs = docs_of(rows).drop("bucket")
    got = sorted(((r["doc_id"], (r["text"] or "").strip()) for r in cp.drop_near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(7, one), (7, two), (9, "third text under the id of nine"), (None, lone), (None, ""), (3, ""), (3, ""), (5, "plain")], key=str)


def test_stages_keep_columns_of_their_own_names(spark, folder):
    from pyspark.sql import functions as F

    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(30)
    for name in ("quality_score", "quality_predicted", "row", "set_id", "component_id", "spans", "key", "d", "s", "benchmark_items"):
        docs = docs.withColumn(name, F.lit("mine"))
    for _, stage in cp.STAGES[:4]:
        docs = stage(spark, docs, d).checkpoint()
        assert {r["quality_score"] for r in docs.collect()} <= {"mine"} and docs.columns[-10:] == ["quality_score", "quality_predicted", "row", "set_id", "component_id", "spans", "key", "d", "s", "benchmark_items"]


def test_each_stage_takes_effect(spark, folder):
    d, item = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").checkpoint()
    columns = docs.columns
    good = cp.keep_quality(spark, docs, d).checkpoint()
    assert good.columns == columns and 0 < good.count() < docs.count()
    one = cp.drop_near_duplicates(spark, good, d).checkpoint()
    rows = {(r["doc_id"], r["text"]) for r in good.collect()}
    want = sorted((x for x, _, least in near_duplicates(sorted(rows, key=str)) if x == least), key=str)
    assert one.columns == columns and sorted((r["doc_id"] for r in one.collect()), key=str) == want
    clean = cp.drop_contaminated(spark, one, d).checkpoint()
    left = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == columns and left == {r["doc_id"] for r in one.collect() if item not in (r["text"] or "")}
    masked = cp.redact_pii(spark, clean, d).checkpoint()
    assert masked.columns == columns and masked.count() == clean.count()
    assert not any(s for r in masked.select("text").collect() for s in pii.spans_of(r["text"] or "", pii.automaton()))
    packed = cp.pack(spark, masked, d)
    assert packed.select("doc_id").distinct().count() == masked.select("doc_id").distinct().count()
    # run() packs the very texts that the stages leave: the pieces of each document, in order, are its ids
    ids = lambda df: sorted((str(r["doc_id"]), r["doc_tokens"]) for r in df.where("start = 0").collect())
    whole = cp.run(spark, d).checkpoint()
    assert ids(whole) == ids(packed)
    encode = packing.encoder(*packing.byte_level_vocabulary(packing.default_tokenizer()))
    want = sorted((str(r["doc_id"]), len(encode(r["text"] or "")) + 1) for r in masked.collect())
    assert ids(whole) == want and whole.agg({"length": "sum"}).first()[0] == sum(n for _, n in want)


def test_stages_on_odd_rows(spark, folder, docs_of):
    """Null and empty texts, rows without id and repeated rows pass every stage with the results that the docstrings state."""
    d, item = folder
    rows = [(1, None), (1, None), (2, ""), (None, "   "), (3, "some text of its own here " + item), (4, "mail me@mail.example.com now"), (5, "word " * 60_000)]
    docs = docs_of(rows)
    assert cp.keep_quality(spark, docs, d).columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in cp.drop_near_duplicates(spark, docs, d).collect()) == ["1", "1", "2", "3", "4", "5", "None"]
    assert sorted(str(r["doc_id"]) for r in cp.drop_contaminated(spark, docs, d).collect()) == ["1", "1", "2", "4", "5", "None"]
    masked = {r["doc_id"]: r["text"] for r in cp.redact_pii(spark, docs, d).collect()}
    assert masked[1] is None and masked[2] == "" and "@" not in masked[4] and masked[5] == rows[6][1]
    packed = cp.pack(spark, docs, d).collect()
    assert sorted(str(r["doc_id"]) for r in packed if r["start"] == 0) == sorted(str(r[0]) for r in rows)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
