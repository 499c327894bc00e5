"""Whole subtitle files of clips: a header, a line for each group of words with every word on its own clock, and a closing credit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import ass_colour, ass_escape, ass_time
from lectern.operators import joins, segmentation

# --- fixed values: fields of the format ---------------------------------------------
STYLE_FIELDS = "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
EVENT_FIELDS = "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"
WORDS, CREDIT = "Words", "Credit"
# --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Card:
    """How a clip's words look; colours as ``#rrggbb``."""

    title: str = "clip"
    width: int = 1080
    height: int = 1080
    font: str = "Amiri"
    size: int = 72
    credit_size: int = 40
    spoken: str = "#ffffff"
    pending: str = "#9aa0a6"
    outline: str = "#000000"
    shadow: str = "#202124"
    credit: str = "#dadce0"

    def header(self) -> Column:
        """Everything before the first event."""

        def style(name: str, size: int, first: str, second: str, bold: int, outline: int, alignment: int, sides: int, vertical: int) -> Column:
            colours = F.concat_ws(",", *(ass_colour(F.lit(c)) for c in (first, second, self.outline, self.shadow)))
            return F.concat_ws(",", F.lit(f"Style: {name},{self.font},{size}"), colours, F.lit(f"{bold},0,0,0,100,100,0,0,1,{outline},0,{alignment},{sides},{sides},{vertical},1"))

        info = f"[Script Info]\n; {self.title}\nScriptType: v4.00+\nWrapStyle: 0\nScaledBorderAndShadow: yes\nPlayResX: {self.width}\nPlayResY: {self.height}\n\n[V4+ Styles]\nFormat: {STYLE_FIELDS}"
        words = style(WORDS, self.size, self.spoken, self.pending, -1, 4, 5, 140, 160)
        return F.concat_ws("\n", F.lit(info), words, style(CREDIT, self.credit_size, self.credit, self.credit, 0, 2, 2, 100, 90), F.lit(f"\n[Events]\nFormat: {EVENT_FIELDS}"))


def timed_lines(clips: DataFrame, words: DataFrame, width: int = 60_000) -> DataFrame:
    """(clip, line, start_cs, end_cs, text) of clips (clip, transcript, start_ms, end_ms) of words (transcript, idx, text, start_ms, end_ms).

    Words are shifted to their clip and clamped to it. In a line's text they stand last first, each with its start in the line and its time up to the next
    one's start, both differences of whole centiseconds, so that they add up to the line: ``{\\kt48\\k37}word``.
    """
    c = clips.select("clip", "transcript", F.col("start_ms").alias("clip_start"), F.col("end_ms").alias("clip_end"))
    met = joins.bucketed_overlap(words.select("transcript", "idx", "text", "start_ms", "end_ms"), c, "transcript", "start_ms", "end_ms", "clip_start", "clip_end", width)
    cs = lambda t: F.floor((F.least(F.greatest(F.col(t) - F.col("clip_start"), F.lit(0)), F.col("clip_end") - F.col("clip_start")) + 5) / 10).cast("long")
    timed = met.select("clip", "idx", F.trim(ass_escape(F.col("text"))).alias("text"), cs("start_ms").alias("s"), cs("end_ms").alias("e")).where("e > s AND text <> ''")
    grouped = segmentation.subtitle_lines(timed.select("clip", "idx", "text", (F.col("s") * 10).alias("start_ms"), (F.col("e") * 10).alias("end_ms")), "clip")
    line = Window.partitionBy("clip", "line").orderBy("idx")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("s").over(whole), F.last("e").over(whole)
    stop = F.coalesce(F.lead("s").over(line), last)
    tag = F.concat(F.lit("{\\kt"), (F.col("s") - first).cast("string"), F.lit("\\k"), (stop - F.col("s")).cast("string"), F.lit("}"), F.col("text"))
    told = timed.join(grouped, ["clip", "idx"]).withColumn("_tag", tag).withColumn("_first", first).withColumn("_last", last)
    backwards = F.transform(F.sort_array(F.collect_list(F.struct("idx", "_tag")), asc=False), lambda x: x["_tag"])
    return told.groupBy("clip", "line").agg(F.min("_first").alias("start_cs"), F.max("_last").alias("end_cs"), F.array_join(backwards, " ").alias("text"))


def subtitle_files(clips: DataFrame, words: DataFrame, card: Card = Card()) -> DataFrame:
    """(clip, file): the whole file of each clip (clip, transcript, start_ms, end_ms, credit). A clip without words has its credit, one without either the header; an empty clip fails."""
    event = lambda start, end, style, text: F.concat(F.lit("Dialogue: 0,"), ass_time(start), F.lit(","), ass_time(end), F.lit(f",{style},,0,0,0,,"), text)
    lines = timed_lines(clips, words).withColumn("event", event(F.col("start_cs"), F.col("end_cs"), WORDS, F.col("text")))
    events = lines.groupBy("clip").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "event"))), lambda x: x["event"]), "\n").alias("events"))
    span = F.col("end_ms") - F.col("start_ms")
    mark = F.trim(ass_escape(F.coalesce("credit", F.lit(""))))
    closing = F.when(mark != "", event(F.lit(0), F.floor((span + 5) / 10), CREDIT, mark))
    checked = F.when(span > 0, card.header()).otherwise(F.raise_error(F.lit("a clip has to have a length")).cast("string"))
    return clips.join(events, "clip", "left").select("clip", F.concat(F.concat_ws("\n", checked, F.col("events"), closing), F.lit("\n")).alias("file"))
