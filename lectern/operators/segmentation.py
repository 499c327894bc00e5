"""Greedy, order-dependent segmentation as folds over one ordered array per transcript (all in the JVM).

A transcript is at most some ten thousand words, so an array per transcript is bounded by the data model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: contract of the chunks, passages and lines -------------------
GAP_MS, LEAST_MS, MOST_MS = 400, 20_000, 45_000
PLAYER_WORDS, PLAYER_GAP_MS = 9, 1200
ASS_WORDS, ASS_LETTERS, ASS_GAP_CS = 6, 28, 80
PASSAGE_LEAST, PASSAGE_MOST, PASSAGE_OVERLAP = 150, 300, 1
# ----------------------------------------------------------------------------------


def ordered(df: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """One row per key with ``items``, the structs (order, fields) in order."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias("items"))


def chunk_ends(words: Column, gap_ms: int = GAP_MS, least_ms: int = LEAST_MS, most_ms: int = MOST_MS, starts: Column | None = None) -> Column:
    """Indexes behind each chunk's last word. A cut follows a word if a gap over ``gap_ms`` comes and the chunk covers
    ``least_ms``, or if it covers ``most_ms``; with ``starts``, only before a word whose index is one of them."""
    n = F.size(words)

    def step(state: Column, i: Column) -> Column:
        word, after = F.get(words, i), F.get(words, i + 1)
        covered = word["end_ms"] - state["from_ms"]
        wide = F.coalesce(after["start_ms"] - word["end_ms"] > gap_ms, F.lit(False))
        cut = (wide & (covered >= least_ms)) | (covered >= most_ms)
        if starts is not None:
            cut = cut & (starts.isNull() | F.array_contains(F.coalesce(starts, F.array().cast("array<int>")), i + 1))
        cut = cut | (i == n - 1)
        ends = F.when(cut, F.concat(state["ends"], F.array(i + 1))).otherwise(state["ends"])
        return F.struct(ends.alias("ends"), F.when(cut, F.coalesce(after["start_ms"], word["end_ms"])).otherwise(state["from_ms"]).alias("from_ms"))

    zero = F.struct(F.array().cast("array<int>").alias("ends"), F.get(words, F.lit(0))["start_ms"].cast("long").alias("from_ms"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), zero, step)["ends"]).otherwise(F.array().cast("array<int>"))


def plan_chunks(words: DataFrame, key: str, **how) -> DataFrame:
    """key, chunk, first word, end word, start_ms and end_ms; chunks cover every word once."""
    w = ordered(words, key, "idx", "start_ms", "end_ms")
    at = w.withColumn("ends", chunk_ends(F.col("items"), **how)).select(key, "items", "ends", F.posexplode("ends").alias("chunk", "word_end"))
    first = F.when(F.col("chunk") == 0, 0).otherwise(F.get("ends", F.col("chunk") - 1))
    return at.withColumn("word_start", first).select(key, "chunk", "word_start", "word_end", F.get("items", F.col("word_start"))["start_ms"].alias("start_ms"), F.get("items", F.col("word_end") - 1)["end_ms"].alias("end_ms"))


def player_lines(words: DataFrame, key: str) -> DataFrame:
    """Line of each word: at most nine words, or up to a pause. The count restarts at pauses only, so windows do."""
    order = Window.partitionBy(key).orderBy("idx")
    pause = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(order) > PLAYER_GAP_MS, F.lit(False)).cast("int")
    island = words.withColumn("_p", pause).withColumn("island", F.sum("_p").over(order)).drop("_p")
    inside = Window.partitionBy(key, "island").orderBy("idx")
    block = island.withColumn("block", F.floor((F.row_number().over(inside) - 1) / PLAYER_WORDS))
    new = F.coalesce((F.col("island") != F.lag("island").over(order)) | (F.col("block") != F.lag("block").over(order)), F.lit(True)).cast("int")
    return block.withColumn("_n", new).withColumn("line", F.sum("_n").over(order) - 1).drop("island", "block", "_n")


def subtitle_lines(words: DataFrame, key: str) -> DataFrame:
    """Lines of at most six words and 28 letters with their spaces, or up to a pause (compared in centiseconds)."""
    cs = lambda c: F.floor((F.col(c) + 5) / 10).cast("long")
    w = ordered(words.withColumn("s", cs("start_ms")).withColumn("e", cs("end_ms")), key, "idx", "text", "s", "e")

    def step(state: Column, word: Column) -> Column:
        letters = state["letters"] + 1 + F.length(word["text"])
        new = (state["n"] == 0) | (state["n"] >= ASS_WORDS) | (letters > ASS_LETTERS) | (word["s"] - state["e"] > ASS_GAP_CS)
        line = state["line"] + F.when(new, 1).otherwise(0)
        return F.struct(
            F.concat(state["out"], F.array(F.struct(word["idx"].cast("long").alias("idx"), line.alias("line")))).alias("out"), line.alias("line"), F.when(new, 1).otherwise(state["n"] + 1).alias("n"),
            F.when(new, F.length(word["text"])).otherwise(letters).alias("letters"), word["e"].alias("e"),
        )

    zero = F.struct(F.array().cast("array<struct<idx:bigint,line:int>>").alias("out"), F.lit(-1).alias("line"), F.lit(0).alias("n"), F.lit(0).alias("letters"), F.lit(0).cast("long").alias("e"))
    return w.select(key, F.inline(F.aggregate("items", zero, step)["out"]))


def plan_passages(chunks: DataFrame, key: str, least: int = PASSAGE_LEAST, most: int = PASSAGE_MOST, overlap: int = PASSAGE_OVERLAP) -> DataFrame:
    """key, passage, chunk_start, chunk_end (inclusive) from (idx, words, gap): gap is the pause behind a chunk.

    From ``least`` words on every edge is a candidate, up to the first at which the words reach ``most``; the widest
    gap wins, the first on a tie. The transcript's end closes a window unless that passes ``most`` and there is a candidate.
    The next window starts ``overlap`` chunks back if that is further on, else behind the cut. A last window whose
    own words are under half of ``least`` joins the one before.
    """
    w = ordered(chunks, key, "idx", "words", "gap")
    items = F.col("items")
    n = F.size(items)
    planned = w.withColumn("sums", F.transform(F.sequence(F.lit(0), n), lambda k: F.aggregate(F.slice(items, 1, k), F.lit(0).cast("long"), lambda s, x: s + x["words"])))
    sums = F.col("sums")

    def window(state: Column, _: Column) -> Column:
        start = state["start"]
        upto = lambda e: F.get(sums, e + 1) - F.get(sums, start)
        edges = F.filter(F.sequence(start, F.greatest(start, n - 2)), lambda e: (e < n - 1) & (upto(e) >= least) & ((e == start) | (upto(e - 1) < most)) & (F.get(items, e)["gap"] > -1))
        best = F.array_max(F.transform(edges, lambda e: F.struct(F.get(items, e)["gap"].cast("long").alias("gap"), (-e).alias("e"))))
        reaches = (start >= n - 1) | (upto(n - 2) < most)
        end = F.when((F.size(edges) == 0) | (reaches & (upto(n - 1) <= most)), n - 1).otherwise(-best["e"])
        back = end + 1 - overlap
        out = F.concat(state["out"], F.array(F.struct(start.alias("a"), end.alias("b"))))
        return F.when(state["done"], state).otherwise(F.struct(out.alias("out"), F.when(back > start, back).otherwise(end + 1).alias("start"), (end >= n - 1).alias("done")))

    zero = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("out"), F.lit(0).alias("start"), F.lit(False).alias("done"))
    planned = planned.withColumn("windows", F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), zero, window)["out"])
    ws = F.col("windows")
    last, prior = F.element_at(ws, -1), F.get(ws, F.size(ws) - 2)
    own = F.get(sums, last["b"] + 1) - F.get(sums, prior["b"] + 1)
    merged = F.concat(F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))), F.array(F.struct(prior["a"].alias("a"), last["b"].alias("b"))))
    folded = F.when((F.size(ws) > 1) & (own * 2 < least), merged).otherwise(ws)
    return planned.select(key, F.posexplode(folded).alias("passage", "w")).select(key, "passage", F.col("w.a").alias("chunk_start"), F.col("w.b").alias("chunk_end"))


def even_timings(duration: Column, n: Column) -> Column:
    """n slots of equal length less a pause of 100 ms, of at least 1 ms."""
    slot = F.floor(duration / n).cast("long")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * slot).alias("start_ms"), (i * slot + F.greatest(slot - 100, F.lit(1))).alias("end_ms")))


def boundaries(start: Column, end: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n), lambda i: start + F.floor((end - start) * i / n).cast("long"))


def verse_starts(words: Column, count: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.bround(i * words / count, 0).cast("long"))))


def clamp_alignment(spans: Column) -> Column:
    """Starts at or behind the end before; ends past starts."""

    def step(state: Column, x: Column) -> Column:
        s = F.greatest(x["start_ms"], state["last"])
        e = F.greatest(x["end_ms"], s + 1)
        return F.struct(F.concat(state["out"], F.array(F.struct(s.alias("start_ms"), e.alias("end_ms")))).alias("out"), e.alias("last"))

    zero = F.struct(F.array().cast("array<struct<start_ms:bigint,end_ms:bigint>>").alias("out"), F.lit(0).cast("long").alias("last"))
    return F.aggregate(spans, zero, step)["out"]


def karaoke(words: DataFrame, key: str, line: str) -> DataFrame:
    """For each word the time to the next one (the last: its own length), in centiseconds."""
    order = Window.partitionBy(key, line).orderBy("idx")
    cs = lambda c: F.floor((F.col(c) + 5) / 10).cast("long")
    return words.withColumn("k_cs", F.coalesce(F.lead(cs("start_ms")).over(order), cs("end_ms")) - cs("start_ms"))


def clip_words(words: DataFrame, start: int, end: int) -> DataFrame:
    """Words that overlap a clip, shifted, clamped to it and in centiseconds; empty ones go."""
    hit = words.where((F.col("start_ms") < end) & (F.col("end_ms") > start))
    cs = lambda c: F.floor((F.least(F.greatest(F.col(c) - start, F.lit(0)), F.lit(end - start)) + 5) / 10).cast("long")
    return hit.withColumn("start_cs", cs("start_ms")).withColumn("end_cs", cs("end_ms")).where("end_cs > start_cs")


def offset_map(words: DataFrame, key: str, text: str) -> DataFrame:
    """Start of each non-empty word in the text that joins them with spaces."""
    order = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return words.where(F.length(text) > 0).withColumn("char_start", F.coalesce(F.sum(F.length(text) + 1).over(order), F.lit(0)))


def renumber(words: DataFrame, first: int, last: int, replacement: list[str], start_ms: Column, end_ms: Column) -> DataFrame:
    """Words [first, last] replaced; the tail moves on. Times of new words divide the span evenly."""
    m = len(replacement)
    shift = m - (last - first + 1)
    kept = words.where((F.col("idx") < first) | (F.col("idx") > last)).withColumn("idx", F.when(F.col("idx") > last, F.col("idx") + shift).otherwise(F.col("idx")))
    span = words.where(F.col("idx").between(first, last)).groupBy("transcript").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"))
    new = span.select("transcript", F.posexplode(F.lit(replacement) if m else F.array().cast("array<string>")).alias("i", "text"), "s", "e")
    edge = lambda i: F.col("s") + F.floor((F.col("e") - F.col("s")) * i / max(m, 1)).cast("long")
    return kept.select("transcript", "idx", "text", "start_ms", "end_ms").unionByName(new.select("transcript", (F.lit(first) + F.col("i")).cast("long").alias("idx"), "text", edge(F.col("i")).alias("start_ms"), edge(F.col("i") + 1).alias("end_ms")))
