"""Text, hash, time and reference functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.arabic import SPACE, collapse

# --- fixed values --------------------------------------------------------------
SNIPPET_LETTERS = 80
FAMOUS_VERSES = {"ايه الكرسي": (2, 255), "ايه الدين": (2, 282), "ايه النور": (24, 35), "ايه السيف": (9, 5), "ايه المباهله": (3, 61)}
REFERENCE_FILLERS = ("سوره", "ايه", "الايه", "رقم", "من")
# --------------------------------------------------------------------------------


def snippet(text: Column, most: int = SNIPPET_LETTERS) -> Column:
    """At most ``most`` letters, cut at the last space up to there, or hard."""
    t = F.trim(text)
    soft = F.regexp_extract(F.left(t, F.lit(most + 1)), r"(?s)^(.*)\s", 1)
    return F.when(F.length(t) <= most, t).when(F.rtrim(soft) != "", F.rtrim(soft)).otherwise(F.left(t, F.lit(most)))


def excerpt(text: Column, words: int) -> Column:
    parts = F.filter(F.split(text, SPACE), lambda x: x != "")
    cut = F.array_join(F.slice(parts, 1, words), " ")
    return F.when(F.size(parts) > words, F.concat(cut, F.lit(" …"))).otherwise(cut)


def split_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?؟])\s+|\n+"), lambda x: F.trim(x)), lambda x: x != "")


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def content_hash(header: Column, normalized: Column) -> Column:
    return F.sha2(F.concat_ws("\n", header, normalized), 256)


def question_hash(normalized: Column, surah: Column, source: Column) -> Column:
    """SHA-256 of the canonical JSON of the question and its non-null filters, keys in order."""
    filters = F.concat(F.lit("{"), F.concat_ws(", ", F.when(source.isNotNull(), F.concat(F.lit('"source": '), source.cast("string"))), F.when(surah.isNotNull(), F.concat(F.lit('"surah": '), surah.cast("string")))), F.lit("}"))
    return F.sha2(F.concat(F.lit('{"filters": '), filters, F.lit(', "question": '), F.to_json(F.array(normalized)).substr(F.lit(2), F.length(F.to_json(F.array(normalized))) - 2), F.lit("}")), 256)


def ip_hash(secret: str, day: Column, ip: Column) -> Column:
    return F.when(F.coalesce(ip, F.lit("")) == "", "").otherwise(F.left(F.sha2(F.concat_ws(":", F.lit(secret), day.cast("string"), ip), 256), F.lit(32)))


def client_ip(forwarded: Column, remote: Column, proxies: int) -> Column:
    """The entry that the outermost trusted proxy wrote."""
    hops = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    if proxies <= 0:
        return remote
    return F.when(F.size(hops) == 0, remote).otherwise(F.element_at(hops, -F.least(F.lit(proxies), F.size(hops))))


def safe_filename(name: Column, most: int = 60) -> Column:
    clean = F.regexp_replace(name, r'[\x00-\x1f\x7f<>:"/\\|?*]', "")
    extension = F.regexp_extract(clean, r"(\.[A-Za-z0-9]{1,8})$", 1)
    stem = F.left(clean, F.length(clean) - F.length(extension))
    trimmed = F.regexp_replace(collapse(stem), r"^[ .\-]+|[ .\-]+$", "")
    return F.concat(F.regexp_replace(F.left(trimmed, F.lit(most)), r"[ .\-]+$", ""), extension)


def parse_ms(text: Column) -> Column:
    """``h:mm:ss``, ``m:ss`` or seconds; only the leading field may be large; null for the rest. Arabic digits count."""
    t = F.translate(F.trim(text), "٠١٢٣٤٥٦٧٨٩", "0123456789")
    part = lambda g: F.regexp_extract(t, r"^(?:(?:(\d+):)?(\d+):)?(\d+)(?:\.(\d{1,3}))?$", g)
    number = lambda c: F.coalesce(F.when(c != "", c).try_cast("long"), F.lit(0))
    h, m, s = number(part(1)), number(part(2)), number(part(3))
    frac = F.rpad(part(4), 3, "0").try_cast("long")
    ok = t.rlike(r"^(?:(?:\d+:)?\d+:)?\d+(?:\.\d{1,3})?$") & ((part(1) == "") | (m < 60)) & ((part(2) == "") | (s < 60))
    return F.when(ok, ((h * 60 + m) * 60 + s) * 1000 + F.coalesce(frac, F.lit(0)))


def format_ms(ms: Column) -> Column:
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000).cast("long")
    h = F.floor(s / 3600).cast("long")
    m = F.floor((s % 3600) / 60).cast("long")
    r = (s % 60).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", m.cast("string"), two(r)))


def ass_time(cs: Column) -> Column:
    two = lambda c: F.lpad(F.floor(c).cast("long").cast("string"), 2, "0")
    return F.concat(F.floor(cs / 360000).cast("long").cast("string"), F.lit(":"), two((cs / 6000) % 60), F.lit(":"), two((cs / 100) % 60), F.lit("."), two(cs % 100))


def ass_colour(rgb: Column) -> Column:
    """``#rrggbb`` as ``&H00BBGGRR``."""
    c = F.upper(rgb)
    return F.concat(F.lit("&H00"), F.substr(c, F.lit(6), F.lit(2)), F.substr(c, F.lit(4), F.lit(2)), F.substr(c, F.lit(2), F.lit(2)))


def ass_escape(text: Column) -> Column:
    return F.translate(F.translate(text, "{}\r\n", "()  "), "\\", "")


def centiseconds(ms: Column) -> Column:
    return F.floor((ms + 5) / 10).cast("long")


def object_key(surah: Column, ordinal: Column, extension: str = "opus") -> Column:
    three = lambda c: F.lpad(c.cast("string"), 3, "0")
    return F.concat(F.lit("corpus/"), three(surah), F.lit("/"), three(ordinal), F.lit(f".{extension}"))


def clip_name(label: Column, start_ms: Column, end_ms: Column, extension: str) -> Column:
    """The label and both timecodes, ``h.mm.ss`` or ``m.ss``."""
    stamp = lambda ms: F.translate(format_ms(ms), ":", ".")
    return F.concat(label, F.lit(" "), stamp(start_ms), F.lit("-"), stamp(end_ms), F.lit("." + extension))


def listen_url(segment: Column, ms: Column) -> Column:
    return F.concat(F.lit("/listen/"), segment.cast("string"), F.lit("?t="), ms.cast("string"))


def segment_title(kind: Column, surah: Column, first: Column, last: Column, filename: Column) -> Column:
    prefix = F.when(kind == "recitation", "تلاوة").otherwise("خواطر")
    span = F.when(first == last, F.concat(F.lit("الآية "), first.cast("string"))).otherwise(F.concat(F.lit("الآيات "), first.cast("string"), F.lit("–"), last.cast("string")))
    return F.left(F.when(surah.isNull(), filename).when(first.isNull(), F.concat_ws(" ", prefix, F.lit("سورة"), surah)).otherwise(F.concat(F.concat_ws(" ", prefix, F.lit("سورة"), surah), F.lit(" — "), span)), F.lit(255))


def passage_header(title: Column, surah: Column, first: Column, last: Column, source: Column, segment: Column) -> Column:
    name = F.coalesce(F.when(F.trim(title) != "", F.trim(title)), F.concat(F.lit("مقطع "), segment.cast("string")))
    span = F.when(first.isNotNull() & last.isNotNull(), F.concat(F.lit(": الآيات "), first.cast("string"), F.lit("–"), last.cast("string"))).otherwise("")
    where = F.when(surah.isNotNull(), F.concat(F.lit("سورة "), surah, span))
    return F.left(F.concat_ws(" — ", name, where, F.when(F.trim(source) != "", source)), F.lit(300))


def embed_text(header: Column, light: Column) -> Column:
    return F.concat_ws("\n", F.when(F.trim(header) != "", header), light)


def numeric_reference(normalized: Column) -> Column:
    """(surah, ayah) of ``2:255``, or null."""
    pattern = r"^(\d{1,3})\s*:\s*(\d{1,3})$"
    return F.when(normalized.rlike(pattern), F.struct(F.regexp_extract(normalized, pattern, 1).cast("int").alias("surah"), F.regexp_extract(normalized, pattern, 2).cast("int").alias("ayah")))


def famous_reference(normalized: Column) -> Column:
    out = F.lit(None).cast("struct<surah:int,ayah:int>")
    for name, (s, a) in FAMOUS_VERSES.items():
        out = F.when(normalized == name, F.struct(F.lit(s).alias("surah"), F.lit(a).alias("ayah"))).otherwise(out)
    return out


def named_reference(normalized: Column) -> Column:
    """(name, ayah) of a chapter name and a number, fillers dropped, or null; the name is for a lookup join."""
    words = F.filter(F.split(normalized, " "), lambda w: (w != "") & ~w.isin(*REFERENCE_FILLERS))
    ok = (F.size(words) >= 2) & F.element_at(words, -1).rlike(r"^\d+$")
    return F.when(ok, F.struct(F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ").alias("name"), F.element_at(words, -1).try_cast("int").alias("ayah")))


def strip_markers(text: Column) -> Column:
    """``[p3]`` as ``[3]``, repeats beside each other once."""
    return F.regexp_replace(F.regexp_replace(text, r"\[p(\d+)\]", "[$1]"), r"(\[\d+\])(?:\s*\1)+", "$1")


def clip_verdict(start: Column, end: Column, duration: Column, video: Column) -> Column:
    """A reason, or ``ok``."""
    return F.when(end - start < 1000, "too_short").when((end > duration) | (start < 0), "outside").when(video & (end - start > 300_000), "video_too_long").otherwise("ok")


# --- fixed values of the recogniser's stand-in --------------------------------------
STUB_MS_PER_WORD = 600
# ----------------------------------------------------------------------------------------


def stub_confidence(digest: Column, index: Column) -> Column:
    """0.80 to 0.99 by a byte of a digest in hex, cycled."""
    at = F.pmod(index, F.floor(F.length(digest) / 2)).cast("int")
    return F.round(0.80 + F.conv(F.substr(digest, at * 2 + 1, F.lit(2)), 16, 10).cast("int") / 255 * 0.19, 4)


def stub_words(digest: Column, duration_ms: Column, vocabulary: list[str]) -> Column:
    """A word for each 600 ms (one at least), cycled through a vocabulary from an offset that the digest's first byte gives; with their confidences."""
    n = F.greatest(F.floor(duration_ms / STUB_MS_PER_WORD), F.lit(1))
    offset = F.conv(F.substr(digest, F.lit(1), F.lit(2)), 16, 10).cast("int")
    words = F.array(*(F.lit(w) for w in vocabulary))
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct(F.element_at(words, (F.pmod(offset + i, F.lit(len(vocabulary))) + 1).cast("int")).alias("text"), stub_confidence(digest, i).alias("confidence")))


def active_token(token_map: Column, word_start: Column, word_end: Column, active: Column) -> Column:
    """Of an alignment (a token or -1 for each word from word_start on) the token at the active word, or the last one before it; -1 outside or with none."""
    upto = F.filter(F.slice(token_map, 1, F.greatest(active - word_start + 1, F.lit(0)).cast("int")), lambda t: t >= 0)
    return F.when(active.between(word_start, word_end) & (F.size(upto) > 0), F.element_at(upto, -1)).otherwise(-1)


def alignment_density(matched: Column, word_start: Column, word_end: Column) -> Column:
    return matched / (word_end - word_start + 1)
