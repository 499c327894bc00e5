"""Listings and projections of the archive: what readers and reviewers are shown, and verdicts of single records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------
CONFIDENCE_DIGITS = 3
TITLE_LETTERS = 80
RESULT_FIELDS = ("chunk_id", "segment_id", "segment_title", "surah", "ayah_start", "ayah_end", "kind", "text", "start_ms", "end_ms")
# --------------------------------------------------------------------------------------


def compact_words(segments: DataFrame, transcripts: DataFrame, words: DataFrame) -> DataFrame:
    """Of each segment its transcript's version, engine and review, and the words as (i, t, s, e, c) in order; ``found`` tells why there are none:
    ``no segment``'s rows are not given, ``no transcript``, ``no words``, or ``ok``."""
    word = F.struct(F.col("idx").alias("i"), F.col("text").alias("t"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.bround("confidence", CONFIDENCE_DIGITS).alias("c"))
    lists = words.groupBy("transcript").agg(F.sort_array(F.collect_list(word)).alias("words"))
    joined = segments.select("segment").join(transcripts, "segment", "left").join(lists, "transcript", "left")
    found = F.when(F.col("transcript").isNull(), "no transcript").when(F.col("words").isNull(), "no words").otherwise("ok")
    return joined.select("segment", "version", "engine", "is_human_reviewed", "words", found.alias("found"))


def result_shape(chunks: DataFrame, transcripts: DataFrame, segments: DataFrame) -> DataFrame:
    """A chunk as results and topics show it, with its segment's place in the text."""
    where = transcripts.select("transcript", "segment").join(segments, "segment")
    return chunks.join(where, "transcript").select(
        F.col("chunk").alias("chunk_id"), F.col("segment").alias("segment_id"), F.col("title").alias("segment_title"), "surah", "ayah_start", "ayah_end", "kind", "text", "start_ms", "end_ms"
    )


def published(topics: DataFrame, slug: str) -> DataFrame:
    """The published topic of that name, or no row."""
    return topics.where(F.col("is_published") & (F.col("slug") == slug))


def listing(rows: DataFrame, filters: dict[str, object], search: tuple[list[str], str] | None = None, period: tuple[str, str, str] | None = None, newest: str | None = None) -> DataFrame:
    """Rows that equal all ``filters``, hold ``search``'s text (any case) in one of its columns, and lie in the ``period`` (time column, unit, first day of it); newest first if asked."""
    out = rows
    for column, value in filters.items():
        out = out.where(F.col(column).eqNullSafe(F.lit(value)))
    if search:
        columns, text = search
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(c), F.lower(F.lit(text)))
        out = out.where(F.coalesce(hit, F.lit(False)))
    if period:
        at, unit, first = period
        kind = rows.schema[at].dataType
        out = out.where(F.date_trunc(unit, F.col(at)).cast(kind) == F.lit(first).cast(kind))
    return out.orderBy(F.col(newest).desc()) if newest else out


def short_question(text: Column, most: int = TITLE_LETTERS) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - 3)), F.lit("…")))


def download_verdicts(records: DataFrame, present: DataFrame, fetched: DataFrame) -> DataFrame:
    """For each (path, sha256): ``skipped`` if what is present has the digest, else ``downloaded`` or ``mismatch`` by what was fetched, ``missing`` if nothing was."""
    have = present.select("path", F.col("sha256").alias("_have"))
    got = fetched.select("path", F.col("sha256").alias("_got"))
    verdict = F.when(F.col("_have").eqNullSafe(F.col("sha256")), "skipped").when(F.col("_got").isNull(), "missing").when(F.col("_got") == F.col("sha256"), "downloaded").otherwise("mismatch")
    return records.join(have, "path", "left").join(got, "path", "left").select("path", "sha256", verdict.alias("verdict"))


def cost_usd(given: Column, prompt_tokens: Column, completion_tokens: Column, prompt_price: Column, completion_price: Column) -> Column:
    """The provider's own cost, else tokens by prices per million, as a decimal; null without either."""
    d = lambda c: c.cast("decimal(18,6)")
    priced = (prompt_tokens.cast("decimal(12,0)") * d(prompt_price) + completion_tokens.cast("decimal(12,0)") * d(completion_price)) / F.lit(1_000_000).cast("decimal(7,0)")
    return F.coalesce(given.cast("decimal(28,12)"), priced.cast("decimal(28,12)"))


def token_estimate(passages: DataFrame, words: str, per_word: float = 2.5, per_row: int = 30) -> DataFrame:
    """What embedding all passages would take: whole tokens of the words, and a header's for each."""
    return passages.agg((F.floor(F.coalesce(F.sum(words), F.lit(0)) * per_word).cast("long") + F.count("*") * per_row).alias("tokens"))


def feedback_verdicts(votes: DataFrame, answers: DataFrame) -> DataFrame:
    """Votes (id, answer, vote) on answers (answer, feedback): ``not_found`` of an unknown answer, ``kept`` where it has that vote already, else ``set``."""
    known = answers.select("answer", "feedback", F.lit(True).alias("_known"))
    rows = votes.join(known, "answer", "left")
    return rows.withColumn("verdict", F.when(F.col("_known").isNull(), "not_found").when(F.col("feedback").eqNullSafe(F.col("vote")), "kept").otherwise("set")).drop("_known", "feedback")


def pages_of(rows: DataFrame, key: str, order: list[str], number: int, size: int) -> DataFrame:
    """Page ``number`` of each key's rows, with their place; a page past the last has no rows. A page below 1 is refused."""
    if number < 1 or size < 1:
        raise ValueError("page or size out of range")
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return placed.where(F.col("place").between((number - 1) * size + 1, number * size))
