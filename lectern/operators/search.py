"""Phrase search, rank fusion and context, over an inverted index kept as a table.

The query is compiled on the driver to literals; documents stay distributed. Word costs are computed once
per distinct word of the vocabulary, then joined to the postings.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import fuzzy
from lectern.functions.arabic import DIGITS_FROM, DIGITS_TO, FOLDED_FROM, FOLDED_TO, STRIPPED, let, light_stem, normalize_index, tokens
from lectern.operators import fill
from lectern.operators.ranking import numbered
from lectern.sources.shared import shared_folder

#: Rows of a run that one task reads in order, and rounds over longer ones.
LONG_RUN = 5_000
MOST_ROUNDS = 40

_QUOTED = re.compile(r'"([^"]*)"|«([^»]*)»|“([^”]*)”')
_FOLD = {ord(a): b for a, b in zip(FOLDED_FROM + DIGITS_FROM, FOLDED_TO + DIGITS_TO, strict=True)} | {ord(c): None for c in STRIPPED}


def normalized(text: str) -> str:
    """The index form of a constant, on the driver."""
    return " ".join(unicodedata.normalize("NFC", text).translate(_FOLD).split())


def parse_query(raw: str) -> list[tuple[str, bool]]:
    """(word, strict) of a query; quoted spans are strict, an open quote is punctuation."""
    out, last = [], 0
    words = lambda s: re.findall(r"[^\W]+", "".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in normalized(s)))
    for m in _QUOTED.finditer(raw):
        out += [(w, False) for w in words(raw[last : m.start()])]
        out += [(w, True) for w in words(next(g for g in m.groups() if g is not None))]
        last = m.end()
    return out + [(w, False) for w in words(raw[last:])]


def postings(docs: DataFrame, doc: str, text: Column) -> DataFrame:
    """(doc, pos, word) of normalised text."""
    return docs.select(F.col(doc).alias("doc"), F.posexplode(tokens(text)).alias("pos", "word"))


def vocabulary_costs(post: DataFrame, query: list[tuple[str, bool]]) -> DataFrame:
    """(qpos, word, stems, typos) of the vocabulary's words that a query word reaches. The distance runs on distinct words behind a prefilter."""
    q = post.sparkSession.createDataFrame([(i, w, s) for i, (w, s) in enumerate(query)], "qpos int, q string, strict boolean")
    if all(s for _, s in query):  # strict words are their own vocabulary
        return q.select("qpos", F.col("q").alias("word"), F.lit(0).alias("stems"), F.lit(0).alias("typos"))
    vocabulary = post.select("word").distinct()
    q = q.withColumn("q_stem", light_stem(F.col("q")))
    near = fuzzy.comparable(F.col("q"), F.col("word"))
    same_stem = (F.length("q_stem") >= fuzzy.LEAST_STEM) & (F.col("q_stem") == F.col("stem"))
    pairs = vocabulary.withColumn("stem", light_stem(F.col("word"))).join(F.broadcast(q), (F.col("q") == F.col("word")) | (~F.col("strict") & (near | same_stem)))
    needs = near & (F.col("q") != F.col("word"))
    if any(len(w) >= fuzzy.ONE_TYPO_LETTERS and not s for w, s in query):
        pairs = pairs.withColumn("d", fuzzy.osa_distance(F.when(needs, F.col("q")), F.when(needs, F.col("word"))))
    else:
        pairs = pairs.withColumn("d", F.lit(None).cast("int"))
    typos = fuzzy.typo_cost(F.col("q"), F.col("word"), F.col("d"))
    cost = F.when(typos.isNotNull(), F.struct(F.lit(0).alias("stems"), typos.cast("int").alias("typos"))).when(same_stem, F.struct(F.lit(1).alias("stems"), F.lit(0).alias("typos")))
    return pairs.select("qpos", "word", cost.alias("c")).where("c IS NOT NULL").select("qpos", "word", "c.stems", "c.typos")


def phrase_match(post: DataFrame, query: list[tuple[str, bool]], costs: DataFrame | None = None) -> DataFrame:
    """(doc, start, stems, typos): the best window of each document that holds the phrase in order. Few rows pass the vocabulary join, so the rest is small.
    ``costs`` are those of ``vocabulary_costs``, where they are known: the words that a query reaches by its few edits or its stem. They are broadcast, so that no posting is shuffled or sorted for them."""
    if not query:
        return post.select("doc", F.col("pos").alias("start"), F.lit(0).alias("stems"), F.lit(0).alias("typos")).limit(0)
    hits = post.join(F.broadcast(vocabulary_costs(post, query) if costs is None else costs), "word").withColumn("start", F.col("pos") - F.col("qpos")).where("start >= 0")
    windows = hits.groupBy("doc", "start").agg(F.count("*").alias("n"), F.sum("stems").alias("stems"), F.sum("typos").alias("typos")).where(F.col("n") == len(query))
    best = F.min(F.struct("stems", "typos", "start")).alias("b")
    return windows.groupBy("doc").agg(best).select("doc", F.col("b.start").alias("start"), F.col("b.stems").alias("stems"), F.col("b.typos").alias("typos"))


def verified(matches: DataFrame, relevance: Column | None = None) -> DataFrame:
    """Matches with their rank by (stems, typos, relevance, doc) and the exact total."""
    return numbered(matches, ["stems", "typos", *([relevance.desc()] if relevance is not None else []), "doc"], "rank", "total")


def phrase_in_tokens(docs: DataFrame, doc: str, text: Column, words: list[str]) -> DataFrame:
    """(doc, start, stems, typos) of documents that hold the words in order, found in each document's tokens joined by spaces, which none contains: nothing is exploded or shuffled."""
    line = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))

    def starts(line: Column) -> Column:
        at = F.instr(line, f" {' '.join(words)} ")
        before = F.left(line, at)
        return F.array_compact(F.array(F.when(at > 0, F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))) - 1)))

    # a generator's input is computed once, where a filter would tokenise each text again
    return docs.select(F.col(doc).alias("doc"), F.explode(let(line, starts)).alias("start")).select("doc", "start", F.lit(0).alias("stems"), F.lit(0).alias("typos"))


def phrase_in_texts(docs: DataFrame, doc: str, normal: Column, words: list[tuple[str, bool]]) -> DataFrame:
    """``phrase_match`` over normalised texts. A phrase of strict words only needs no vocabulary and is found inside each text."""
    if words and all(strict for _, strict in words):
        return phrase_in_tokens(docs, doc, normal, [w for w, _ in words])
    return phrase_match(postings(docs, doc, normal), words)


def lexical_search(docs: DataFrame, doc: str, text: str, query: str, latin: bool = False) -> DataFrame:
    """Ranked matches of a phrase. A phrase of strict words only needs no vocabulary and is found inside each text."""
    words = parse_query(query)
    normal = normalize_index(F.col(text), latin)
    if words and all(strict for _, strict in words):
        # only matches are shuffled; the ranking's sample then reads them, and not the texts again
        return verified(phrase_in_tokens(docs, doc, normal, [w for w, _ in words]).repartition("doc"))
    return verified(phrase_match(postings(docs, doc, normal), words))


def page(ranked: DataFrame, number: int, size: int) -> DataFrame:
    if not (1 <= number <= 100 and 1 <= size <= 50):
        raise ValueError("page or size out of range")
    return ranked.where(F.col("rank").between((number - 1) * size + 1, number * size))


def fuse(lists: DataFrame, k: int = 60, limit: int = 40) -> DataFrame:
    """Reciprocal rank fusion of (list_index, rank, id, weight): repeated ids of a list count once, but keep their places."""
    first = lists.groupBy("list_index", "id").agg(F.min("rank").alias("rank"), F.first("weight").alias("weight"))
    got = first.groupBy("id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("list_index", "rank")).alias("first"))
    best = got.orderBy(F.desc("score"), "first", "id").limit(limit)  # the window only sees what the limit leaves
    return best.select("id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "first", "id")).alias("place"))


def _hits(post: DataFrame, terms: list[str]) -> DataFrame:
    """Of each document its places of the terms, in order: an array of (pos, term number). Postings are filtered before they are grouped."""
    number = F.array_position(F.array(*(F.lit(t) for t in terms)), F.col("word")).cast("int") - 1
    return post.where(F.col("word").isin(terms)).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", number.alias("term")))).alias("hits"))


def _covers(hits: Column, n: int | Column) -> Column:
    """Cover density of the places of a document: the sum over minimal covers (least windows with all n terms) of 1 / length; one fold over the places."""

    def step(s: Column, x: Column) -> Column:
        last = F.transform(s["last"], lambda p, i: F.when(i == x["term"], x["pos"]).otherwise(p))
        start = F.array_min(last)
        new = (start >= 0) & (start > s["start"])  # the first place at which the cover from this start is whole
        return F.struct(last.alias("last"), F.when(new, start).otherwise(s["start"]).alias("start"), (s["sum"] + F.when(new, 1.0 / (x["pos"] - start + 1)).otherwise(0.0)).alias("sum"))

    zero = F.struct(F.array_repeat(F.lit(-1), n).alias("last"), F.lit(-1).alias("start"), F.lit(0.0).alias("sum"))
    return F.aggregate(hits, zero, step, lambda s: F.round(s["sum"], 6))


def lexical_fill(post: DataFrame, stems: list[str], limit: int = 50) -> DataFrame:
    """Documents with all stems first, then those with any; in each round by cover density (with any: each place is a cover of its own), then id."""
    terms = list(dict.fromkeys(stems))
    if not terms:
        return post.select("doc", F.lit(False).alias("all_terms"), F.lit(0.0).alias("rank_cd"), F.lit(0).alias("place")).limit(0)
    hit = _hits(post, terms).withColumn("all_terms", F.size(F.array_distinct(F.transform("hits", lambda h: h["term"]))) == len(terms))
    density = F.when(F.col("all_terms"), _covers(F.col("hits"), len(terms))).otherwise(F.size("hits").cast("double"))
    best = hit.select("doc", "all_terms", density.alias("rank_cd")).orderBy(F.desc("all_terms"), F.desc("rank_cd"), "doc").limit(limit)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("all_terms"), F.desc("rank_cd"), "doc")))


def cover_density(post: DataFrame, stems: list[str]) -> DataFrame:
    """Cover-density rank of the documents that hold all stems."""
    terms = list(dict.fromkeys(stems))
    ranked = _hits(post, terms).select("doc", _covers(F.col("hits"), len(terms)).alias("rank_cd"))
    return ranked.where("rank_cd > 0")


def lexical_fill_many(lists: DataFrame, questions: DataFrame, limit: int = 50) -> DataFrame:
    """``lexical_fill`` for a table of questions: (question, list_index, doc, all_terms, rank_cd, place).

    lists: (word, doc, pos array), as an index stores them; questions: (question, list_index, terms array). Pairs of a question and a document are added up inside
    tasks (``fill``); only those that can be among the best ``limit`` are rows. Repeated terms count once; no terms give no rows.
    """
    asked = questions.select("question", "list_index", F.array_distinct(F.filter("terms", lambda t: t != "")).alias("terms"))
    sets, rows = fill.asked_sets(asked)
    return rows.join(fill.fill_many(lists, sets, limit), "set").select("question", "list_index", "doc", "all_terms", "rank_cd", "place")


def fuse_many(lists: DataFrame, k: int = 60, limit: int = 40) -> DataFrame:
    """``fuse`` for each question of (question, list_index, name, rank, id, weight): (question, id, score, ranks, place), with the id's rank in each list that has it, by name."""
    first = lists.groupBy("question", "list_index", "id").agg(F.min("rank").alias("rank"), F.first("weight").alias("weight"), F.first("name").alias("name"))
    ranks = F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("list_index", "name", "rank"))), lambda x: F.struct(x["name"], x["rank"])))
    got = first.groupBy("question", "id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"), ranks.alias("ranks"), F.min(F.struct("list_index", "rank")).alias("first"))
    best = Window.partitionBy("question").orderBy(F.desc("score"), "first", "id")
    return got.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit).select("question", "id", "score", "ranks", "place")


def keep_reranked(scored: DataFrame, least: float = 2.0, most: int = 8, few: int = 2, fill: int = 3) -> DataFrame:
    """(id, score, place) → those at or above the least by (score, place), the first ``most``; if fewer than ``few``, fused order fills up to ``fill``."""
    good = F.col("score") >= least
    order = Window.orderBy(good.desc(), F.when(good, -F.col("score")), "place", "id")
    ranked = scored.withColumn("kept_place", F.row_number().over(order)).withColumn("n_good", F.count(F.when(good, 1)).over(Window.partitionBy()))
    return ranked.where(F.when(F.col("n_good") < few, F.col("kept_place") <= fill).otherwise(good & (F.col("kept_place") <= most))).select("id", "score", "kept_place", (F.col("n_good") < few).alias("weak"))


def first_seen(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each normalised key, in order."""
    w = Window.partitionBy("_k").orderBy(order)
    return df.withColumn("_k", key).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_k", "_r")


def suggest(titles: DataFrame, text: str, prefix: str, snippet: Column, limit: int = 6) -> DataFrame:
    """Distinct snippets of texts with a word that starts with the prefix; a prefix under two letters gives none."""
    p = normalized(prefix)
    hit = titles.where(F.lit(len(p) >= 2) & F.exists(tokens(F.col(text)), lambda w: w.startswith(p)))
    return hit.select(snippet.alias("suggestion")).distinct().orderBy("suggestion").limit(limit)


def merge_windows(seeds: DataFrame) -> DataFrame:
    """Per transcript, seed ranges (priority, a, b) folded in priority order: a range that overlaps or touches a window widens the first such one only."""
    rows = seeds.groupBy("transcript").agg(F.sort_array(F.collect_list(F.struct("priority", "a", "b"))).alias("s"))

    def step(state: Column, x: Column) -> Column:
        at = F.array_min(F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(state) - 1, F.lit(0))), lambda i: (F.size(state) > 0) & (x["a"] <= F.get(state, i)["b"] + 1) & (x["b"] >= F.get(state, i)["a"] - 1)), lambda i: i))
        wide = F.transform(state, lambda y, i: F.when(i == at, F.struct(y["priority"].alias("priority"), F.least(y["a"], x["a"]).alias("a"), F.greatest(y["b"], x["b"]).alias("b"))).otherwise(y))
        return F.when(at.isNull(), F.concat(state, F.array(F.struct(x["priority"].alias("priority"), x["a"].alias("a"), x["b"].alias("b"))))).otherwise(wide)

    return rows.select("transcript", F.inline(F.aggregate("s", F.array().cast("array<struct<priority:int,a:int,b:int>>"), step)))


def _spend_in_order(rows: DataFrame) -> DataFrame:
    """(run, id) of (run, priority, id, words, budget) that fit; each run is read in order by one task and never held whole."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, spent = object(), 0
        for batch in batches:
            take = []
            for run, words, budget in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if run != now:
                    now, spent = run, 0
                fits = words is not None and spent + words <= budget
                spent += words if fits else 0
                take.append(fits)
            yield batch.select(["run", "id"]).filter(pa.array(take, pa.bool_()))

    dealt = rows.repartition("run").sortWithinPartitions("run", "priority", "id", "words")
    return dealt.mapInArrow(fold, dealt.select("run", "id").schema)


def _spend_in_rounds(rows: DataFrame) -> DataFrame:
    """The same for long runs, by all tasks. In a round everything up to the first row that does not fit is taken, found by sums over sorted parts; that row and all
    that are larger than what is left go for good. A run that is not through after ``MOST_ROUNDS`` goes on in order with the few rows left."""
    order = ["run", "priority", "id", "words"]
    sorted_ = rows.where("words <= budget").repartitionByRange(*order).sortWithinPartitions(*order)
    open_ = sorted_.select("run", "priority", "id", "words", "budget", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")).checkpoint()
    taken: list[DataFrame] = []
    for _ in range(MOST_ROUNDS):
        sums = open_.groupBy("run", "part").agg(F.sum("words").alias("sum"))
        before = F.coalesce(F.sum("sum").over(Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = open_.join(sums.withColumn("before", before).select("run", "part", "before"), ["run", "part"])
        spent = F.col("before") + F.sum("words").over(Window.partitionBy("run", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
        summed = placed.withColumn("spent", spent).checkpoint()
        over = summed.where("spent > budget").groupBy("run").agg(F.min("seq").alias("first"))
        fits = summed.join(over, "run", "left")
        good = F.col("first").isNull() | (F.col("seq") < F.col("first"))
        took = fits.where(good).select("run", "id", "spent").checkpoint()
        taken.append(took.select("run", "id"))
        if not over.head(1):
            break
        used = took.groupBy("run").agg(F.max("spent").alias("used"))
        left = fits.where(F.col("seq") > F.col("first")).join(used, "run", "left").withColumn("budget", F.col("budget") - F.coalesce("used", F.lit(0)))
        open_ = left.where("words <= budget").select("run", "priority", "id", "words", "budget", "part", "seq").checkpoint()
    else:
        taken.append(_spend_in_order(open_.select("run", "priority", "id", "words", "budget")))
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def spend_budget(windows: DataFrame, budget: int = 3600, long: int = LONG_RUN) -> DataFrame:
    """(run, id) of the windows (run, priority, id, words of 0 or more) that fit what is left of their run's budget, in order of priority; one that does not fit is skipped.
    A run of up to ``long`` rows is read by one task, a longer one is spent in rounds over all tasks."""
    rows = windows.select("run", "priority", F.col("id").cast("long").alias("id"), F.col("words").cast("long").alias("words"), F.lit(budget).cast("long").alias("budget"))
    shared_folder(windows.sparkSession)  # for checkpoints
    sizes = rows.where("run IS NOT NULL").groupBy("run").count().where(F.col("count") > long).select(F.col("run").alias("_r")).checkpoint()
    if not sizes.head(1):
        return _spend_in_order(rows)
    short, wide = rows.join(sizes, F.col("run") == F.col("_r"), "left_anti"), rows.join(sizes, F.col("run") == F.col("_r"), "left_semi")
    return _spend_in_order(short).unionByName(_spend_in_rounds(wide))
