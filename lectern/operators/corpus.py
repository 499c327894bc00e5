"""Corpus changes and scoped search: reference checks, passages, corrections, ingestion and clip ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.arabic import normalize_index, stem_text
from lectern.functions.text import content_hash, famous_reference, numeric_reference
from lectern.operators import search, segmentation

# --- fixed values: the canonical text's sizes; clip bounds -------------------------
FULL = {"chapters": 114, "verses": 6236, "juz": 30, "quarters": 240, "pages": 604}
LEAST_CLIP_MS, DEFAULT_CLIP_MS = 1000, 30_000
VERSES_SHOWN = 8
# -------------------------------------------------------------------------------------


def full_reference_problems(counts: DataFrame, declared: DataFrame, lines: DataFrame) -> DataFrame:
    """What keeps a reference from being whole: (name, n) off the fixed sizes, chapters whose verses are not as many as declared, unknown chapters."""
    sizes = counts.sparkSession.createDataFrame(list(FULL.items()), "name string, want long")
    off = sizes.join(counts, "name", "left").where(~F.col("want").eqNullSafe(F.col("n"))).select(F.concat_ws(" ", F.lit("size of"), "name").alias("problem"), F.col("n").cast("long").alias("found"))
    got = lines.groupBy("surah").agg(F.count("*").alias("n"))
    both = declared.select("surah", "ayah_count").join(got, "surah", "full_outer")
    wrong = both.where(~F.col("ayah_count").eqNullSafe(F.col("n"))).select(F.concat_ws(" ", F.when(F.col("ayah_count").isNull(), "unknown chapter").otherwise("verses of chapter"), F.col("surah").cast("string")).alias("problem"), F.col("n").cast("long").alias("found"))
    return off.unionByName(wrong)


def strip_opening(lines: DataFrame) -> DataFrame:
    """First verses (but of chapter 1) without the opening formula, where their first four words are its normalised form."""
    opening = lines.where("surah = 1 AND ayah = 1").select(normalize_index(F.col("text")).alias("_o"))
    words = F.split(normalize_index(F.col("text")), " ")
    starts = (F.col("surah") != 1) & (F.col("ayah") == 1) & (F.size(words) > 4) & (F.array_join(F.slice(words, 1, 4), " ") == F.col("_o"))
    rows = lines.crossJoin(F.broadcast(opening))  # one row
    return rows.select("surah", "ayah", F.when(starts, F.regexp_replace("text", r"^(?:\S+\s+){4}", "")).otherwise(F.col("text")).alias("text"), starts.alias("stripped"))


def build_passages(chunks: DataFrame, headers: DataFrame, least: int = segmentation.PASSAGE_LEAST, most: int = segmentation.PASSAGE_MOST) -> DataFrame:
    """Passages of (transcript, idx, text, start_ms, end_ms): text, its normalised and stemmed forms, and a content hash under the transcript's header."""
    order = Window.partitionBy("transcript").orderBy("idx")
    words = F.size(F.filter(F.split(F.col("text"), " "), lambda w: w != "")).cast("long")
    c = chunks.withColumn("words", words).withColumn("gap", F.coalesce(F.lead("start_ms").over(order) - F.col("end_ms"), F.lit(0)))
    plan = segmentation.plan_passages(c.select("transcript", "idx", "words", "gap"), "transcript", least, most)
    rows = plan.join(c, "transcript").where(F.col("idx").between(F.col("chunk_start"), F.col("chunk_end")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    whole = rows.groupBy("transcript", "passage", "chunk_start", "chunk_end").agg(text.alias("text"), F.sum("words").alias("word_count"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    norm = whole.withColumn("text_normalized", normalize_index(F.col("text"))).join(headers, "transcript")
    return norm.withColumn("text_stem", stem_text(F.col("text_normalized"))).withColumn("content_hash", content_hash(F.col("header"), F.col("text_normalized")))


def unchanged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Transcripts whose lists of (passage, content_hash) are equal, so that nothing has to be written."""
    hashes = lambda df, name: df.groupBy("transcript").agg(F.sort_array(F.collect_list(F.struct("passage", "content_hash"))).alias(name))
    return hashes(old, "a").join(hashes(new, "b"), "transcript").where("a = b").select("transcript")


def correction_problems(corrections: DataFrame, chunk_words: DataFrame, words: DataFrame) -> DataFrame:
    """Of each (correction, status, transcript, chunk, word_start, word_end, suggested_text) why it cannot be applied, or null; chunk_words: (chunk, low, high), the words a chunk covers."""
    present = corrections.join(words.select(F.col("transcript").alias("_t"), "idx"), (F.col("transcript") == F.col("_t")) & F.col("idx").between(F.col("word_start"), F.col("word_end")))
    n = present.groupBy("correction").agg(F.count("*").alias("_n"))
    rows = corrections.join(chunk_words.select("chunk", "low", "high"), "chunk", "left").join(n, "correction", "left")
    problem = (
        F.when(F.col("status") != "pending", F.concat(F.lit("already "), F.col("status"))).when(F.trim(F.regexp_replace("suggested_text", r"\s+", " ")) == "", "no words")
        .when(F.col("word_end") < F.col("word_start"), "end before start").when(F.col("low").isNull(), "chunk without words")
        .when((F.col("word_start") < F.col("low")) | (F.col("word_end") > F.col("high")), "outside the chunk")
        .when(F.coalesce("_n", F.lit(0)) != F.col("word_end") - F.col("word_start") + 1, "words missing")
    )
    return rows.select("correction", problem.alias("problem"))


def apply_correction(words: DataFrame, chunks: DataFrame, transcript: int, first: int, last: int, replacement: list[str], passages: DataFrame | None = None) -> dict[str, DataFrame]:
    """New versions of the words, the transcript's text, the texts of chunks (transcript, idx, start_ms, end_ms) that touch the edit, and, of passages (transcript, passage,
    chunk_start, chunk_end, header), those that hold such a chunk, whole, with their new hashes. A range that is not all there, or no words, is refused."""
    if not replacement or last < first:
        raise ValueError("no words, or the end comes before the start")
    mine = words.where(F.col("transcript") == transcript)
    edge = mine.where(F.col("idx").between(first, last)).agg(F.count("*").alias("n"), F.min("start_ms").alias("es"), F.max("end_ms").alias("ee")).first()
    if edge["n"] != last - first + 1:
        raise ValueError(f"words {first}-{last} are not all present")
    edited = segmentation.renumber(mine, first, last, replacement, F.col("start_ms"), F.col("end_ms"))
    after = words.where(F.col("transcript") != transcript).select("transcript", "idx", "text", "start_ms", "end_ms").unionByName(edited)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    touched = chunks.where((F.col("transcript") == transcript) & (F.col("start_ms") <= edge["ee"]) & (F.col("end_ms") >= edge["es"]))

    def texts_of(spans: DataFrame) -> DataFrame:
        w = edited.select(F.col("idx").alias("w"), F.col("text").alias("wt"), F.col("start_ms").alias("ws"))
        met = spans.select("transcript", "idx", "start_ms", "end_ms").join(w, (F.col("ws") >= F.col("start_ms")) & (F.col("ws") < F.col("end_ms")), "left")
        return met.groupBy("transcript", "idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("w", "wt")))), lambda x: x["wt"]), " ").alias("text"))

    out = {"words": after, "transcript": edited.groupBy("transcript").agg(joined.alias("raw_text"), F.count("*").alias("word_count")), "chunks": texts_of(touched).withColumn("text_normalized", normalize_index(F.col("text")))}
    if passages is not None:
        hit = passages.join(touched.select("transcript", F.col("idx").alias("_i")), "transcript").where(F.col("_i").between(F.col("chunk_start"), F.col("chunk_end"))).select(*passages.columns).distinct()
        whole = texts_of(chunks.where(F.col("transcript") == transcript))
        rows = hit.join(whole, "transcript").where(F.col("idx").between(F.col("chunk_start"), F.col("chunk_end")))
        text = rows.groupBy("transcript", "passage", "chunk_start", "chunk_end", "header").agg(joined.alias("text")).withColumn("text_normalized", normalize_index(F.col("text")))
        out["passages"] = text.withColumn("text_stem", stem_text(F.col("text_normalized"))).withColumn("content_hash", content_hash(F.col("header"), F.col("text_normalized")))
    return out


def ingest(files: DataFrame, assets: DataFrame) -> DataFrame:
    """For each file the first segment of an asset of the same sha256, or null for a new one."""
    first = assets.groupBy("sha256").agg(F.min("segment").alias("segment"))
    return files.join(first, "sha256", "left").withColumn("status", F.when(F.col("segment").isNull(), "new").otherwise("known"))


def discovered(files: DataFrame, key: Column) -> DataFrame:
    """Files by derived key, in order; a null or repeated key fails."""
    rows = files.withColumn("key", key)
    n = rows.groupBy("key").agg(F.count("*").alias("n"))
    ok = F.col("key").isNotNull() & (F.col("n") == 1)
    return rows.join(n, "key", "left").withColumn("key", F.when(ok, F.col("key")).otherwise(F.raise_error(F.lit("file without a key of its own")).cast("string"))).drop("n").orderBy("key")


def verse_search(verses: DataFrame, query: str) -> DataFrame:
    """Phrase search over both spellings of (id, uthmani, imlaei); the better one counts."""
    words = search.parse_query(query)
    hits = [search.phrase_in_texts(verses, "id", normalize_index(F.col(c)), words).withColumn("attr", F.lit(c)) for c in ("imlaei", "uthmani")]
    best = hits[0].unionByName(hits[1]).groupBy("doc").agg(F.min(F.struct("stems", "typos", "attr", "start")).alias("b"))
    return search.verified(best.select("doc", "b.start", "b.stems", "b.typos", "b.attr"))


def scoped_search(chunks: DataFrame, verses: DataFrame, query: str, kind: str | None = None, number: int = 1, size: int = 20) -> dict[str, DataFrame | None]:
    """Blocks of results, never mixed: verses that a reference in the query names (``ayah_matches``), verses that hold the phrase but none of those (``verse_matches``, the first 8), and a page of
    transcripts' chunks (``results``) with their ``total``. ``recitation`` asks the canonical text only, ``khawatir`` transcripts only.

    chunks: (id, text); verses: (id, surah, ayah, uthmani, imlaei)."""
    if kind not in (None, "recitation", "khawatir"):
        raise ValueError(f"unknown kind {kind!r}")
    out: dict[str, DataFrame | None] = {"ayah_matches": None, "verse_matches": None, "results": None, "total": None}
    if kind != "khawatir":
        asked = verses.sparkSession.createDataFrame([(search.normalized(query),)], "q string")
        ref = F.coalesce(numeric_reference(F.col("q")), famous_reference(F.col("q")))
        named = asked.select(ref.alias("r")).where("r IS NOT NULL").select("r.surah", "r.ayah")
        out["ayah_matches"] = verses.join(F.broadcast(named), ["surah", "ayah"]).select("id", "surah", "ayah")  # one row at most
        held = verse_search(verses, query).join(out["ayah_matches"].select(F.col("id").alias("doc")), "doc", "left_anti")
        best = held.orderBy("rank").limit(VERSES_SHOWN)
        out["verse_matches"] = best.withColumn("rank", F.row_number().over(Window.orderBy("rank")))
    if kind != "recitation":
        ranked = search.lexical_search(chunks, "id", "text", query)
        out["results"] = search.page(ranked, number, size)
        out["total"] = ranked.agg(F.coalesce(F.max("total"), F.lit(0)).alias("total"))
    return out


def clamp_range(start: Column, end: Column, duration: Column) -> Column:
    """A clip inside the segment of at least a second, ends swapped if need be."""
    inside = lambda x: F.least(F.greatest(x, F.lit(0)), duration)
    a, b = F.least(inside(start), inside(end)), F.greatest(inside(start), inside(end))
    span = F.greatest(b - a, F.least(F.lit(LEAST_CLIP_MS), duration))
    stop = F.least(a + span, duration)
    return F.struct(F.greatest(stop - span, F.lit(0)).alias("start_ms"), stop.alias("end_ms"))


def _inside(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def move_start(end: Column, start: Column, duration: Column) -> Column:
    """The range after its start is dragged to ``start``: the end stays where it is, and at least the least clip (or the whole of a shorter segment) is left."""
    least = F.least(F.lit(LEAST_CLIP_MS), duration)
    stop = _inside(end, least, duration)
    return F.struct(_inside(start, F.lit(0), F.greatest(stop - least, F.lit(0))).alias("start_ms"), stop.alias("end_ms"))


def move_end(start: Column, end: Column, duration: Column) -> Column:
    """The mirror of ``move_start``."""
    least = F.least(F.lit(LEAST_CLIP_MS), duration)
    begin = _inside(start, F.lit(0), F.greatest(duration - least, F.lit(0)))
    return F.struct(begin.alias("start_ms"), _inside(end, F.least(begin + least, duration), duration).alias("end_ms"))


def default_range(position: Column, duration: Column) -> Column:
    start = F.least(F.greatest(position, F.lit(0)), duration)
    return clamp_range(start, start + DEFAULT_CLIP_MS, duration)


def grow_selection(words: Column, first: Column, last: Column) -> Column:
    """A selection of (start_ms, end_ms) words grown by a word at a time, the end first, then the start, until it lasts a second or all words are in."""
    top = F.size(words) - 1

    def step(s: Column, _: Column) -> Column:
        short = F.get(words, s["b"])["end_ms"] - F.get(words, s["a"])["start_ms"] < LEAST_CLIP_MS
        more_b, more_a = s["b"] < top, s["a"] > 0
        at_end = F.when(s["end"], more_b).otherwise(~more_a)
        go = short & (more_a | more_b)
        return F.struct(F.when(go & ~at_end, s["a"] - 1).otherwise(s["a"]).alias("a"), F.when(go & at_end, s["b"] + 1).otherwise(s["b"]).alias("b"), F.when(go, ~s["end"]).otherwise(s["end"]).alias("end"))

    zero = F.struct(first.cast("int").alias("a"), last.cast("int").alias("b"), F.lit(True).alias("end"))
    return F.aggregate(F.sequence(F.lit(0), F.greatest(top, F.lit(0))), zero, step, lambda s: F.struct(s["a"].alias("first"), s["b"].alias("last")))
