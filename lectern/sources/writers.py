"""Index documents, JSON, sitemap and subtitle output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import ass_colour, ass_escape, ass_time


def index_documents(chunks: DataFrame, transcripts: DataFrame, segments: DataFrame) -> DataFrame:
    """One flat row per chunk; both parents are lookups."""
    return chunks.join(transcripts, "transcript").join(segments, "segment")


def upsert_index(index: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return index.join(new, key, "left_anti").unionByName(new)


def delete_segment(index: DataFrame, segment: int) -> DataFrame:
    """The index without a segment's rows; those of no segment stay."""
    return index.where(~F.col("segment").eqNullSafe(F.lit(segment)))


def json_lines(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*order).select(F.to_json(F.struct(*df.columns)).alias("value"))


def xml_escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def sitemap_rows(df: DataFrame, loc: Column, lastmod: Column | None = None) -> DataFrame:
    mod = F.when(lastmod.isNotNull(), F.concat(F.lit("<lastmod>"), F.date_format(lastmod, "yyyy-MM-dd"), F.lit("</lastmod>"))) if lastmod is not None else F.lit("")
    return df.select(F.concat(F.lit("<url><loc>"), xml_escaped(loc), F.lit("</loc>"), F.coalesce(mod, F.lit("")), F.lit("</url>")).alias("value"))


def ass_dialogue(lines: DataFrame, colour: str = "#ffffff") -> DataFrame:
    """(line, start_cs, end_cs, text) → subtitle events; the colour is in the file's byte order."""
    tag = F.concat(F.lit("{\\c"), ass_colour(F.lit(colour)), F.lit("&}"))
    return lines.orderBy("line").select(F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start_cs")), F.lit(","), ass_time(F.col("end_cs")), F.lit(",Default,,0,0,0,,"), tag, ass_escape(F.col("text"))).alias("value"))
