"""Questions answered from end to end: cache, plan, retrieval, rerank, context, draft, verification, response and log.

All questions of a table pass in one chain of joins; a question is a row wherever it can be. Models are interfaces:
without a generator the draft is extractive, without a scorer every candidate counts as relevant.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.arabic import normalize_index, stem_text, tokens
from lectern.functions.text import listen_url, question_hash, split_sentences
from lectern.operators import answers, search, smart

KEEP = 8
QUOTE_WORDS = 12
CACHE_TTL_MS = 7 * 86_400_000
#: Ids of transcripts that are broadcast.
MOST_IDS = 1_000_000
RESPONSE = ("question_id", "status", "answer_md", "citations", "ayah_refs", "kept", "cache_hit")


class Generator(Protocol):
    """Context rows (question_id, question, passage, text) to drafts: answers (answer, status, answer_md, refs, followups) and citations (answer, pos, passage, quote).

    One that needs functions of a text only can name them in an attribute ``reads``: they are made once for each text and given in its place.
    """

    def __call__(self, context: DataFrame) -> tuple[DataFrame, DataFrame]: ...


def first_words(text: Column) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.get(split_sentences(text), F.lit(0)), r"\s+"), lambda w: w != ""), 1, QUOTE_WORDS), " ")


def extractive(context: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A draft without a model: the first words of each passage, each with its marker and quoted word for word."""
    quoted = context if "quote" in context.columns else context.withColumn("quote", first_words(F.col("text")))
    rows = quoted.withColumn("pos", F.regexp_extract("passage", r"(\d+)", 1).cast("int"))
    said = F.transform(F.sort_array(F.collect_list(F.struct("pos", "passage", "quote"))), lambda x: F.concat(x["quote"], F.lit(" ["), x["passage"], F.lit("].")))
    none = F.array().cast("array<struct<surah:int,ayah:int>>")
    drafts = rows.groupBy(F.col("question_id").alias("answer")).agg(F.array_join(said, "\n").alias("answer_md"))
    return drafts.select("answer", F.lit(smart.ANSWERED).alias("status"), "answer_md", none.alias("refs"), F.array().cast("array<string>").alias("followups")), rows.select(F.col("question_id").alias("answer"), "pos", "passage", "quote")


extractive.reads = {"quote": first_words}


def candidates_of(asked: DataFrame, lists: DataFrame) -> DataFrame:
    """Fused lexical candidates (question, id, score, ranks, place): the question's stems, and its keywords as a list of its own."""
    stems = tokens(stem_text(normalize_index(F.col("question"))))
    rows = asked.select(F.col("question_id").alias("question"), F.array_distinct(stems).alias("t"))
    one = lambda index, name, weight, terms: F.struct(F.lit(index).alias("list_index"), F.lit(name).alias("name"), F.lit(weight).alias("weight"), terms.alias("terms"))
    wanted = rows.select("question", F.inline(F.array(one(0, "question", 2.0, F.col("t")), one(1, "keywords", 1.0, F.slice("t", 1, smart.KEYWORDS)))))
    found = search.lexical_fill_many(lists, wanted).withColumnRenamed("doc", "id").withColumnRenamed("place", "rank")
    names = F.when(F.col("list_index") == 0, "question").otherwise("keywords")
    return search.fuse_many(found.select("question", "list_index", names.alias("name"), F.when(F.col("list_index") == 0, 2.0).otherwise(1.0).alias("weight"), "id", "rank"))


def reranked(candidates: DataFrame, scores: DataFrame | None, least: float = 2.0, few: int = 2, fill: int = 3) -> DataFrame:
    """``smart.rerank`` for many questions: (question, id, kept_place, weak). scores: (question, id, score, order); the first of an id wins, ids without one count as 0."""
    if scores is None:
        rows = candidates.withColumn("s", F.lit(3.0))
    else:
        first = scores.groupBy("question", "id").agg(F.min_by("score", "order").alias("s"))
        rows = candidates.drop("s").join(first, ["question", "id"], "left").withColumn("s", F.coalesce(F.least(F.greatest("s", F.lit(0.0)), F.lit(3.0)), F.lit(0.0)))
    good = F.col("s") >= least
    order = Window.partitionBy("question").orderBy(good.desc(), F.when(good, -F.col("s")), "place", "id")
    ranked = rows.withColumn("kept_place", F.row_number().over(order)).withColumn("n_good", F.count(F.when(good, 1)).over(Window.partitionBy("question")))
    keep = F.when(F.col("n_good") < few, F.col("kept_place") <= fill).otherwise(good & (F.col("kept_place") <= KEEP))
    return ranked.where(keep).select("question", "id", "kept_place", (F.col("n_good") < few).alias("weak"))


def ask(
    asked: DataFrame, passages: DataFrame, chunks: DataFrame, words: DataFrame, verses: DataFrame, lists: DataFrame | None = None, generator: Generator = extractive, scores: DataFrame | None = None, cache: DataFrame | None = None,
    limit: int = smart.PASSAGE_WORDS, budget: int = smart.CONTEXT_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """(responses, log rows) of a table of questions (question_id, question, at).

    passages: (id, text, transcript, segment, chunk_start, chunk_end); chunks: (transcript, idx, text, words, start_ms, end_ms); words: (transcript, idx, text, start_ms, end_ms); verses: (surah,
    ayah). ``lists``: the passages' stored postings, else they are made here. cache: (question_hash, at, status, answer_md, citations, ayah_refs, kept) of earlier responses, which serve questions
    of the same normalised form within the time to live, the latest first. A response has its status, text, citations (n, segment, start_ms, end_ms, url, quote), verses and whether it is from the cache; the log
    row has the question's hash, its candidates and kept passages in order, whether the evidence was weak, how much of the draft survived, and an error.
    """
    hashed = asked.withColumn("question_hash", question_hash(normalize_index(F.col("question")), F.lit(None), F.lit(None)))
    served = None
    if cache is not None:
        old = cache.select("question_hash", F.col("at").alias("_at"), "status", "answer_md", "citations", "ayah_refs", "kept")
        hit = hashed.join(old, "question_hash").where((F.col("_at") <= F.col("at")) & (F.col("at") < F.col("_at") + CACHE_TTL_MS))
        newest = F.max_by(F.struct("status", "answer_md", "citations", "ayah_refs", "kept"), "_at").alias("r")
        served = hit.groupBy("question_id", "question_hash").agg(newest).select("question_id", "question_hash", "r.*").checkpoint()
        hashed = hashed.join(served, "question_id", "left_anti")
    if lists is None:
        placed = search.postings(passages, "id", stem_text(normalize_index(F.col("text"))))
        lists = placed.groupBy("word", "doc").agg(F.sort_array(F.collect_list("pos")).alias("pos"))
    found = candidates_of(hashed, lists).checkpoint()
    kept = reranked(found, scores).checkpoint()
    p = passages.select("id", "transcript", "segment", F.col("chunk_start").alias("a"), F.col("chunk_end").alias("b"))
    windows = kept.join(p, "id").select("question", F.col("id").alias("window"), F.col("kept_place").alias("priority"), "transcript", "segment", "a", "b", F.col("a").alias("seed_a"), F.col("a").alias("seed_b"))
    reads = getattr(generator, "reads", None)
    context = smart.context(windows, chunks, limit, budget, reads).checkpoint()
    told = context.select(F.col("question").alias("question_id"), "passage", *(reads or ["text"])).join(hashed.select("question_id", "question"), "question_id")
    drafts, citations = generator(told)
    # a question without any evidence has a draft that says so
    none = F.array().cast("array<struct<surah:int,ayah:int>>")
    empty = hashed.select(F.col("question_id").alias("answer")).join(drafts, "answer", "left_anti").select("answer", F.lit(smart.NOT_FOUND).alias("status"), F.lit("").alias("answer_md"), none.alias("refs"), F.array().cast("array<string>").alias("followups"))
    said = context.select(F.col("question").alias("answer"), "passage", "segment", "transcript", "start_ms", "end_ms")
    # words of the transcripts that are cited only; their ids are broadcast up to a million
    named = context.select("transcript").distinct().checkpoint()
    spoken = words.join(F.broadcast(named) if named.count() <= MOST_IDS else named, "transcript", "left_semi")
    final, checked = answers.verify(drafts.unionByName(empty), citations, said, spoken, verses)
    cited = checked.where("n IS NOT NULL").select("answer", "n", "segment", "start_ms", "end_ms", listen_url(F.col("segment"), F.col("start_ms")).alias("url"), F.col("quote_display").alias("quote"))
    by = cited.groupBy("answer").agg(F.sort_array(F.collect_list(F.struct("n", "segment", "start_ms", "end_ms", "url", "quote"))).alias("citations"))
    made = final.join(by, "answer", "left").withColumnRenamed("answer", "question_id").withColumn("citations", F.coalesce("citations", F.array().cast(by.schema["citations"].dataType))).withColumn("kept", F.col("kept").cast("long")).checkpoint()
    responses = made.withColumn("cache_hit", F.lit(False)).select(*RESPONSE)
    ids = found.groupBy("question").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("candidates"))
    best = kept.groupBy("question").agg(F.transform(F.sort_array(F.collect_list(F.struct("kept_place", "id"))), lambda x: x["id"]).alias("reranked"), F.max("weak").alias("weak"))
    log = hashed.select("question_id", "question_hash", "at").join(ids, F.col("question_id") == ids["question"], "left").drop("question").join(best, F.col("question_id") == best["question"], "left").drop("question")
    log = log.join(made.select("question_id", "status", "drafted", "kept", "error"), "question_id").withColumn("cache_hit", F.lit(False))
    if served is not None:
        responses = responses.unionByName(served.withColumn("cache_hit", F.lit(True)).select(*RESPONSE))
        log = log.unionByName(served.join(asked.select("question_id", "at"), "question_id").withColumn("cache_hit", F.lit(True)).drop("answer_md", "citations", "ayah_refs"), allowMissingColumns=True)
    return responses, log
