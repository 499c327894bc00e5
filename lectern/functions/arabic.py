"""Normalisation, light stemming and tokens of Arabic (and Latin) text, as column expressions."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# --- fixed values: the normalised form is a contract between indexes ------------
#: tatweel; harakat, maddah and hamza marks; superscript alef; annotation marks
STRIPPED = "ـ" + "".join(map(chr, range(0x064B, 0x0656))) + "ٰ" + "".join(map(chr, range(0x06D6, 0x06EE)))
FOLDED_FROM = "آأإٱٲٳةىؤئ"
FOLDED_TO = "ااااااهيوي"
DIGITS_FROM = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
DIGITS_TO = "01234567890123456789"
STEM_PREFIXES = ("وال", "بال", "فال", "كال", "لل", "ال")
STEM_PARTICLES = "وبفكل"
STEM_SUFFIXES = ("ها", "هم", "كم", "نا", "ات", "ون", "ين")
LEAST_STEM = 3
STOP_WORDS = (
    "في من علي الي عن ان ما لا هذا هذه ذلك تلك الذي التي الذين كان كانت يكون قد ثم او "
    "يا هو هي هم انا انت نحن انتم له لها لهم به بها بهم فيه فيها منه منها عليه عليها "
    "الا اذا لم لن كل بعد قبل عند مع حتي بل لكن ولكن اي ايضا هناك هنا ليس انه انها لانه "
    "لان لانها كما بين ذا ذي هكذا فقط"
).split()
# ---------------------------------------------------------------------------------

TOKEN = r"[\p{L}\p{N}_]+"
SPACE = r"(?U)[\s\x1c-\x1f]+"


#: Letters that are Python strings at once, a longer text excepted.
PIECE = 1 << 20


def _composed(texts: pa.Array) -> pa.Array:
    """NFC of each text, a piece at a time; pieces that are NFC already are passed on as they came."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // PIECE)) + 1).tolist(), len(texts)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        piece = texts.slice(a, b - a)
        said = piece.to_pylist()
        whole = all(s is None or s.isascii() or unicodedata.is_normalized("NFC", s) for s in said)
        out.append(piece if whole else pa.array([s and unicodedata.normalize("NFC", s) for s in said], texts.type))
    return out[0] if len(out) == 1 else pa.concat_arrays(out)


@F.arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Unicode NFC; Spark has no built-in for it."""
    return _composed(text)


@F.arrow_udf(ArrayType(StringType()))
def nfc_each(texts: pa.Array) -> pa.Array:
    """The same of each text of an array."""
    return pa.ListArray.from_arrays(pa.array(texts.offsets.to_numpy()), _composed(texts.values), mask=texts.is_null())


#: Only text that has one of these can be other than NFC.
MAY_COMPOSE = r"[^\x00-\x{02FF}]"


def composed(text: Column, latin: bool = False) -> Column:
    """NFC, or the text itself where the caller knows that all code points are below U+0300 (such text is NFC). Python is sent only texts with others."""
    return text if latin else F.coalesce(nfc(F.when(text.rlike(MAY_COMPOSE), text)), text)


def composed_each(texts: Column) -> Column:
    """NFC of each text of an array."""
    return F.coalesce(nfc_each(F.when(F.exists(texts, lambda t: t.rlike(MAY_COMPOSE)), texts)), texts)


def normalize_light(text: Column, latin: bool = False) -> Column:
    return F.translate(composed(text, latin), STRIPPED, "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize_index(text: Column, latin: bool = False) -> Column:
    # translate() drops what has no counterpart, so the stripped marks come last
    return collapse(F.translate(composed(text, latin), FOLDED_FROM + DIGITS_FROM + STRIPPED, FOLDED_TO + DIGITS_TO))


def tokens(normalized: Column) -> Column:
    return F.regexp_extract_all(normalized, F.lit(f"({TOKEN})"), F.lit(1))


def space_tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def let(value: Column, use) -> Column:
    """use(value), the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def light_stem(word: Column) -> Column:
    """One prefix (or a particle before the article), then one suffix, if enough letters stay. Not idempotent: apply once."""

    def prefix(w: Column) -> Column:
        particle = F.left(w, F.lit(1)).isin(*STEM_PARTICLES) & (F.substr(w, F.lit(2), F.lit(2)) == "ال") & (F.length(w) - 1 >= LEAST_STEM)
        out = F.when(particle, F.substr(w, F.lit(2))).otherwise(w)
        for p in reversed(STEM_PREFIXES):
            out = F.when(w.startswith(p) & (F.length(w) - len(p) >= LEAST_STEM), F.substr(w, F.lit(len(p) + 1))).otherwise(out)
        return out

    def suffix(w: Column) -> Column:
        out = w
        for x in reversed(STEM_SUFFIXES):
            out = F.when(w.endswith(x) & (F.length(w) - len(x) >= LEAST_STEM), F.left(w, F.length(w) - len(x))).otherwise(out)
        return out

    return F.when(word.rlike(r"^\p{L}"), let(let(word, prefix), suffix)).otherwise(word)


def stem_text(normalized: Column) -> Column:
    """Stems without stop words (before or after stemming)."""
    kept = F.filter(space_tokens(normalized), lambda w: ~w.isin(*STOP_WORDS))
    return F.array_join(F.filter(F.transform(kept, light_stem), lambda w: ~w.isin(*STOP_WORDS)), " ")


def stem_words(normalized: Column) -> Column:
    return F.array_join(F.transform(tokens(normalized), light_stem), " ")


def is_arabic(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    arabic = F.regexp_count(text, F.lit(r"[\x{0600}-\x{06FF}&&\p{L}]"))
    return (letters > 0) & (arabic >= 0.7 * letters)


def arabic_digits(text: Column) -> Column:
    return F.translate(text, "0123456789", DIGITS_FROM[:10])
