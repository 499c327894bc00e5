"""The question-answering chain: plan, retrieve, rerank, context, verify. Models are interfaces; without one the chain is lexical and extractive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.arabic import is_arabic, normalize_index, stem_text
from lectern.operators import search
from lectern.sources.shared import shared_folder

# --- fixed values -----------------------------------------------------------------
REWRITES, KEYWORDS, TOPIC_LETTERS = 5, 8, 120
PASSAGE_WORDS, CONTEXT_WORDS = 450, 3600
ANSWER_LETTERS, FOLLOWUPS = 2500, 3
NOT_FOUND, PARTIAL, ANSWERED = "not_found", "partial", "answered"
# ------------------------------------------------------------------------------------


class Scorer(Protocol):
    """Relevance of passages to a question, 0 to 3: (id, text) rows to (id, score) rows."""

    def __call__(self, question: str, passages: DataFrame) -> DataFrame: ...


@dataclass
class Plan:
    question: str
    rewrites: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    refs: list[tuple[int, int]] = field(default_factory=list)
    surah: int | None = None


def distinct_texts(texts: list[str], most: int, exclude: str = "") -> list[str]:
    """The first of each normalised form, trimmed; empty ones and the excluded form go."""
    seen = {search.normalized(exclude)} if exclude else set()
    out: list[str] = []
    for t in texts:
        key = search.normalized(t)
        if key and key not in seen and len(out) < most:
            seen.add(key)
            out.append(t.strip())
    return out


def tidy(plan: Plan, verses: DataFrame) -> Plan:
    """Bounds a plan; references have to be verses (surah, ayah) of the table."""
    refs = []
    if plan.refs:
        wanted = verses.sparkSession.createDataFrame([(i, s, a) for i, (s, a) in enumerate(plan.refs)], "i int, surah int, ayah int")
        found = wanted.join(verses.select("surah", "ayah"), ["surah", "ayah"], "left_semi").orderBy("i").collect()
        refs = list(dict.fromkeys((r["surah"], r["ayah"]) for r in found))
    return Plan(plan.question, distinct_texts(plan.rewrites, REWRITES, plan.question), distinct_texts(plan.keywords, KEYWORDS), refs, plan.surah if plan.surah and 1 <= plan.surah <= 114 else None)


def naive(question: str) -> Plan:
    """The plan without a model: the question, and its words as keywords."""
    return Plan(question, [], distinct_texts([w for w, _ in search.parse_query(question)], KEYWORDS))


def anchored(passages: DataFrame, refs: list[tuple[int, int]], limit: int = 30, nearness: DataFrame | None = None) -> DataFrame:
    """(id, rank) of the passages whose verses cover a reference. In the order of the corpus, by (segment, ordinal) where passages have them; or, with ``nearness`` (id, distance) of those that
    have a vector of the question's model, the nearest first, and only those."""
    r = passages.sparkSession.createDataFrame(refs, "rs int, ra int").distinct()
    hit = passages.join(r, (F.col("surah") == F.col("rs")) & F.col("ra").between(F.col("ayah_start"), F.col("ayah_end"))).drop("rs", "ra").dropDuplicates(["id"])
    if nearness is not None:
        order = ["distance", "id"]
        hit = hit.join(nearness.select("id", "distance"), "id")
    else:
        order = [*(c for c in ("segment", "ordinal") if c in passages.columns), "id"]
    best = hit.orderBy(*order).limit(limit)  # the window sees what the limit leaves
    return best.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def filtered(passages: DataFrame, surah: int | None = None, source: int | None = None, segments: DataFrame | None = None) -> DataFrame:
    """Passages of a chapter, and of a source: their own ``source``, or that of their segment in ``segments`` (segment, source)."""
    out = passages if surah is None else passages.where(F.col("surah") == surah)
    if source is None:
        return out
    if segments is None:
        return out.where(F.col("source") == source)
    return out.join(segments.where(F.col("source") == source).select("segment"), "segment", "left_semi")


def retrieve(passages: DataFrame, plan: Plan, semantic: DataFrame | list[DataFrame] | None = None) -> DataFrame:
    """Fused candidates of (id, text[, surah, ayah_start, ayah_end]). ``semantic`` is the list (id, rank) of the question's vector, or such lists of the question, its rewrites and its keywords; without any,
    lexical lists only."""
    if plan.surah is not None:
        passages = passages.where(F.col("surah") == plan.surah)
    post = search.postings(passages, "id", stem_text(normalize_index(F.col("text"))))
    asked, lists = [plan.question, *plan.rewrites, *([" ".join(plan.keywords)] if plan.keywords else [])], []
    # at most seven constants, stemmed in one job, without stop words as the passages are
    stemmed = passages.sparkSession.createDataFrame([(k, search.normalized(q)) for k, q in enumerate(asked)], "k int, q string").select("k", F.split(stem_text(F.col("q")), " ").alias("s"))
    stems_of = {r["k"]: [w for w in r["s"] if w] for r in stemmed.collect()}
    for k in range(len(asked)):
        if stems := stems_of[k]:
            lists.append(search.lexical_fill(post, stems).select(F.lit(k).alias("list_index"), F.col("doc").alias("id"), F.col("place").alias("rank"), F.lit(2.0 if k == 0 else 1.0).alias("weight")))
    for k, near in enumerate([semantic] if isinstance(semantic, DataFrame) else semantic or []):
        lists.append(near.select(F.lit(50 + k).alias("list_index"), "id", "rank", F.lit(2.0 if k == 0 else 1.0).alias("weight")))
    if plan.refs and "ayah_start" in passages.columns:
        lists.append(anchored(passages, plan.refs).select(F.lit(91).alias("list_index"), "id", "rank", F.lit(1.0).alias("weight")))
    if not lists:
        return passages.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("place")).limit(0)
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    return search.fuse(every)


def rerank(candidates: DataFrame, scores: DataFrame | None) -> DataFrame:
    """Scores clamped to 0..3, the first of an id wins, unknown ids go; without scores all count as relevant."""
    if scores is None:
        return search.keep_reranked(candidates.select("id", F.lit(3.0).alias("score"), "place"))
    first = scores.groupBy("id").agg(F.min_by("score", "order").alias("score"))
    joined = candidates.select("id", "place").join(first, "id", "left")
    return search.keep_reranked(joined.select("id", F.coalesce(F.least(F.greatest("score", F.lit(0.0)), F.lit(3.0)), F.lit(0.0)).alias("score"), "place"))


def trim_windows(chunks: DataFrame, limit: int = PASSAGE_WORDS, key: tuple[str, ...] = ("window",)) -> DataFrame:
    """(window, idx, words, seed_a, seed_b) → the chunks that stay: left of the seed as long as what follows is over the limit they go, then from the right; the seed stays."""
    onward = Window.partitionBy(*key).orderBy("idx").rowsBetween(0, Window.unboundedFollowing)
    upto = Window.partitionBy(*key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    suffix = F.sum("words").over(onward)
    from_seed = F.sum(F.when(F.col("idx") >= F.col("seed_a"), F.col("words")).otherwise(0)).over(upto)
    left, right = F.col("idx") < F.col("seed_a"), F.col("idx") > F.col("seed_b")
    stays = F.when(left, suffix <= limit).when(right, from_seed <= limit).otherwise(True)
    return chunks.withColumn("_s", stays).where("_s").drop("_s")


def context(windows: DataFrame, chunks: DataFrame, limit: int = PASSAGE_WORDS, budget: int = CONTEXT_WORDS, reads: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Numbered passages p1.. by (segment, start) from windows (window, priority, transcript, segment, a, b, seed_a, seed_b[, question]) of chunks (transcript, idx, text, words,
    start_ms, end_ms). Many questions at once have a budget and numbers of their own each; without that column all windows are of one question. With ``reads`` the passages have these functions of
    their text, made once for each text, in its place."""
    shared_folder(windows.sparkSession)  # for checkpoints
    asked = windows if "question" in windows.columns else windows.withColumn("question", F.lit(1))
    at = lambda *columns: chunks.select(F.col("transcript").alias("_t"), "idx", *columns)
    inside = lambda a, b: (F.col("transcript") == F.col("_t")) & F.col("idx").between(F.col(a), F.col(b))
    rows = trim_windows(asked.join(at("words", "start_ms", "end_ms"), inside("a", "b")).drop("_t"), limit, ("question", "window"))
    # what stays of a window is a run of chunks; texts are joined to those that the budget takes only
    sizes = rows.groupBy("question", "window", "priority", "segment", "transcript").agg(F.sum("words").alias("words"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("idx").alias("_a"), F.max("idx").alias("_b")).checkpoint()
    fits = search.spend_budget(sizes.select(F.col("question").alias("run"), "priority", F.col("window").cast("long").alias("id"), "words"), budget).select(F.col("run").alias("question"), F.col("id").alias("window"))
    order = Window.partitionBy("question").orderBy("segment", "start_ms", "window")
    taken = sizes.join(fits, ["question", "window"], "left_semi").withColumn("passage", F.concat(F.lit("p"), F.row_number().over(order).cast("string"))).checkpoint()
    # of many windows on one run of chunks the text is made once
    runs = taken.select("transcript", "_a", "_b").distinct().join(at("text"), inside("_a", "_b"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    texts = runs.groupBy("transcript", "_a", "_b").agg(text.alias("text"))
    read = {"text": lambda t: t} if reads is None else reads
    told = texts.select("transcript", "_a", "_b", *(f(F.col("text")).alias(name) for name, f in read.items()))
    numbered = taken.join(told, ["transcript", "_a", "_b"]).select("question", "window", "priority", "segment", "transcript", "words", "start_ms", "end_ms", *read, "passage")
    return numbered if "question" in windows.columns else numbered.drop("question")


def status_after(drafted: Column, kept: Column, status: Column) -> Column:
    """Nothing kept: not found; an answer with most citations dropped: partial."""
    return F.when(kept == 0, NOT_FOUND).when((status == ANSWERED) & (kept * 2 < drafted), PARTIAL).otherwise(status)


def tidy_answer(text: Column, most: int = ANSWER_LETTERS) -> Column:
    """Single spaces, no space before line ends, at most the limit, cut behind a sentence."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"\s+\n", "\n"))
    sentence = F.regexp_extract(F.left(t, F.lit(most)), r"(?s)^(.+\.)", 1)
    return F.when(F.length(t) <= most, t).when(sentence != "", F.rtrim(sentence)).otherwise(F.rtrim(F.left(t, F.lit(most))))


def followups(items: Column) -> Column:
    return F.slice(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: (x != "") & is_arabic(x)), 1, FOLLOWUPS)


def parse_answer(text: Column) -> Column:
    """Typed nodes of an answer: text, citation ``[n]``, verse ``[[ayah:S:A]]``."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(\[\[ayah:\d+:\d+\]\]|\[\d+\]|(?:(?!\[\[ayah:\d+:\d+\]\]|\[\d+\]).)+)"), F.lit(1))
    return F.transform(pieces, lambda p: F.struct(F.when(p.rlike(r"^\[\[ayah:"), "ayah").when(p.rlike(r"^\[\d+\]$"), "citation").otherwise("text").alias("kind"), F.regexp_replace(p, r"^\[\[ayah:|\]\]$|^\[(?=\d+\]$)|(?<=\d)\]$", "").alias("value")))


def extractive(passages: DataFrame, sentences: int = 2) -> DataFrame:
    """A stand-in for a generator: the first sentences of each passage, cited. No model is involved."""
    from lectern.functions.text import split_sentences

    return passages.select("passage", F.concat(F.array_join(F.slice(split_sentences(F.col("text")), 1, sentences), " "), F.lit(" ["), F.col("passage"), F.lit("]")).alias("draft"))


def smart_search(passages: DataFrame, question: str, scorer: Scorer | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """Plan, retrieve and rerank one question over (id, text); ids with scores and whether the evidence is weak."""
    candidates = retrieve(passages, naive(question), semantic)
    scores = scorer(question, candidates.join(passages.select("id", "text"), "id")) if scorer else None
    return rerank(candidates, scores)


def run_stages(stages: list[tuple[str, Callable[[DataFrame], DataFrame | None]]], start: DataFrame, until: str | None = None) -> list[tuple[str, str]]:
    """Stages in order up to ``until``, each on the result before: processed, skipped (None: nothing to do) or failed, where it stops."""
    log, now = [], start
    for name, stage in stages:
        try:
            got = stage(now)
        except Exception as error:  # a stage's failure is its verdict
            log.append((name, f"failed: {error}"))
            break
        log.append((name, "skipped" if got is None else "processed"))
        now = now if got is None else got
        if name == until:
            break
    return log
