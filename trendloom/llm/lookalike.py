"""One consistent form for texts that look the same but differ in their characters.

A text is scanned once for unstable characters: those for which the quick-check properties of canonical
composition say no or maybe, those with a width or blank variant, invisible ones, and letters that look like
Latin ones. Only the segments around such characters, from the last stable starter before to the first stable
one after, are normalised; everything else is copied as it is.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.session import materialise, spread

#: Letters of other scripts that look like Latin letters or signs, each above its look-alike.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮҺԌԚԜӀавеѕіјкмнорстухүһԁԛԝ"
CYRILLIC_AS = "ABESIJKMHOPCTYXYhGQWIaBesijKMHopcTyxyhdqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳαιικνορσυχϲ"
GREEK_AS = "ABEZHIKMNOPTYXCjaiikvopouxc"
ARMENIAN = "ՍՕօսոհզցյ"
ARMENIAN_AS = "UOounhqgj"
OTHER = "ɑɡıɩǀ‐‑−ʼ"
OTHER_AS = "agiil---'"
#: Ligatures and digraphs that are drawn as their letters.
LIGATURES = {*range(0xFB00, 0xFB07), 0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4)}
#: Small Cyrillic letters that are not small Latin ones keep their own shape.
KEPT = "вкмнт"
#: A character outside the short ranges known to be stable (ASCII, composed Latin letters, common marks). The class of all
#: unstable characters has thousands of ranges, which the JVM's patterns try one by one; texts found here are scanned with it in Python.
DOUBTFUL = r"[^\n\x20-\x7e\u00a1-\u00ac\u00ae-\u0130\u0134-\u01bf\u01cd-\u01f0\u1ea0-\u1ef9\u2013\u2014\u2018-\u201f\u2026]"
BLANK_LINES = re.compile(r"[ \t\x0b\x0c]*\r\n?|[ \t\x0b\x0c]*(?=\n)")
EMOJI = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}\p{Regional_Indicator}️]")


@cache
def lookalikes() -> dict[str, str]:
    """The Latin look-alike of each letter."""
    pairs = [*zip(CYRILLIC, CYRILLIC_AS), *zip(GREEK, GREEK_AS), *zip(ARMENIAN, ARMENIAN_AS), *zip(OTHER, OTHER_AS)]
    return {a: b for a, b in pairs if a not in KEPT}


@cache
def simple_forms() -> dict[str, str]:
    """Characters that are drawn as another one: width forms, font variants, blanks; by the decomposition tags."""
    out = {}
    for n in range(0x80, sys.maxunicode + 1):
        c = chr(n)
        d = unicodedata.decomposition(c)
        if d.startswith(("<wide>", "<narrow>", "<font>")) or d.startswith("<compat>") and n in LIGATURES:
            out[c] = unicodedata.normalize("NFKC", c)
        elif unicodedata.category(c) in ("Zs", "Zl", "Zp"):
            out[c] = "\n" if unicodedata.category(c) != "Zs" else " "
    return out


@cache
def unstable_class() -> str:
    """A character class of all unstable characters."""
    forms, looks = simple_forms(), lookalikes()
    runs: list[list[int]] = []
    for n in range(sys.maxunicode + 1):
        c = chr(n)
        if 0xD800 <= n < 0xE000:
            continue
        bad = c in forms or c in looks or unicodedata.combining(c) or unicodedata.category(c) == "Cf" or not unicodedata.is_normalized("NFC", c) or c in "\r\t\x0b\x0c"
        bad = bad or 0x1160 <= n < 0x1200 or unicodedata.category(c) == "Mn"  # may compose with what stands before
        if bad:
            if runs and runs[-1][1] == n - 1:
                runs[-1][1] = n
            else:
                runs.append([n, n])
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@cache
def _segments() -> re.Pattern:
    return re.compile(f"[{unstable_class()}]+")


def _segment(text: str, start: int, end: int) -> str:
    """The normal form of a segment of unstable characters with the character before it."""
    forms = simple_forms()
    out = []
    for k in range(start, end):
        c = text[k]
        if c == "\u200d" and 0 < k and EMOJI.match(text[k - 1]) and EMOJI.match(text, k + 1):
            out.append(c)  # a joiner inside an emoji is seen
        elif unicodedata.category(c) != "Cf" or 0xE0000 <= ord(c):
            out.append(forms.get(c, c))
    return unicodedata.normalize("NFC", "".join(out))


def canonical(text: str) -> str:
    """The text with composed accents, plain width, plain blanks and no invisible characters; idempotent."""
    parts, at = [], 0
    for m in _segments().finditer(text):
        start = max(at, m.start() - 1)  # the starter that the segment may compose with
        parts += (text[at:start], _segment(text, start, m.end()))
        at = m.end()
    text = "".join(parts) + text[at:]
    text = BLANK_LINES.sub(lambda m: "\n" if "\r" in m[0] else "", text)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


_WORD = regex.compile(r"[\p{L}\p{M}]+")
_OTHER_LETTER = re.compile("[\u0370-\u058f\u1f00-\u1fffɑɡıɩ]")
_LATIN = regex.compile(r"\p{Latin}")


def plain_letters(text: str) -> str:
    """Look-alike letters as Latin ones, in words that hold a Latin letter or look-alikes only; other words stay."""
    looks = lookalikes()

    def word(m: regex.Match) -> str:
        w = m[0]
        if not _OTHER_LETTER.search(w):
            return w
        d = unicodedata.normalize("NFD", w)
        if _LATIN.search(w) or all(c in looks or unicodedata.combining(c) for c in d):
            return unicodedata.normalize("NFC", "".join(looks.get(c, c) for c in d))
        return w

    return _WORD.sub(word, text) if _OTHER_LETTER.search(text) else text


_LOOKS = re.compile(f"[\u0370-\u058f{OTHER}]")
_BLANKS = re.compile(r"[ \t\x0b\x0c]+")


def skeleton(text: str) -> str:
    """What is equal for texts that look the same: all look-alikes mapped, runs of blanks as one."""
    text = canonical(text)
    if _LOOKS.search(text):
        looks = lookalikes()
        text = unicodedata.normalize("NFC", "".join(looks.get(c, c) for c in unicodedata.normalize("NFD", text)))
    return _BLANKS.sub(" ", text).strip()


def _mapped(text: Column, how: str) -> Column:
    """``how`` over the texts with a doubtful character; the others don't leave the JVM."""
    f = {"canonical": lambda s: plain_letters(canonical(s)), "skeleton": skeleton}[how]

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(f, na_action="ignore")

    doubtful = text.rlike(DOUBTFUL if how == "canonical" else DOUBTFUL + r"|  |^\s|\s$")
    return F.coalesce(run(F.when(doubtful, text)), text)


def normalise_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, normalised, changed``: one row a row; a null text stays null (changed false), an empty one empty."""
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("__t"))
    out = out.select("id", "__t", _mapped(F.col("__t"), "canonical").alias("normalised"))
    return out.select("id", "normalised", F.coalesce(F.col("normalised") != F.col("__t"), F.lit(False)).alias("changed"))


def _keyed(df: DataFrame, id_col: str, text_col: str, by: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with fingerprints of their spelling and look, the spellings, and the looks that have several of them."""
    t = spread(df.select(F.col(by).alias("by"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where(F.col("t").rlike(r"[^\s\p{Z}\p{Cf}]")))
    keyed = t.select("by", "id", F.unhex(F.md5(F.col("t").cast("binary"))).alias("spelling"), F.unhex(F.md5(_mapped(F.col("t"), "skeleton").cast("binary"))).alias("look"))
    keyed = materialise(keyed)  # read several times: the texts are mapped once
    spellings = keyed.groupBy("by", "look", "spelling").agg(F.min("id").alias("least"))
    several = spellings.groupBy("by", "look").agg(F.min("spelling").alias("first"), F.max("spelling").alias("last"), F.min("least").alias("class_id")).where("first <> last").select("by", "look", "class_id")
    return keyed, spellings, several


def lookalike_classes(df: DataFrame, id_col: str, text_col: str, by: str) -> DataFrame:
    """``by, id, class_id, spelling_id``: the rows of each class of texts that look the same and have several spellings.

    ``class_id`` is the smallest id of the class, ``spelling_id`` that of the rows of the same string: one row a row, and no pair.
    Defined cases as in ``lookalike_pairs``.
    """
    keyed, spellings, several = _keyed(df, id_col, text_col, by)
    return keyed.join(several, ["by", "look"]).join(spellings, ["by", "look", "spelling"]).select("by", "id", "class_id", F.col("least").alias("spelling_id"))


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str, by: str) -> DataFrame:
    """``by, id_a, id_b`` with ``id_a < id_b``: rows of one ``by`` whose texts look the same and aren't the same string.

    Defined cases: null and blank texts make no pair; identical strings make no pair, but each of two identical
    rows makes one with every different look-alike; other columns are not looked at; an empty table gives none.
    Different spellings are paired first, over fingerprints of 128 bits, and only then are the rows of either
    spelling joined: copies of one spelling never meet each other, and the shuffles carry no text. Where pairs aren't asked for,
    ``lookalike_classes`` says the same by one row a row.
    """
    keyed, spellings, several = _keyed(df, id_col, text_col, by)
    one = spellings.select("by", "look", "spelling").join(several, ["by", "look"], "left_semi")
    pairs = one.join(one.withColumnRenamed("spelling", "other"), ["by", "look"]).where("spelling < other")
    rows = keyed.join(several, ["by", "look"], "left_semi")
    left = pairs.join(rows.select("by", "look", "spelling", F.col("id").alias("a")), ["by", "look", "spelling"])
    both = left.join(rows.select("by", "look", F.col("spelling").alias("other"), F.col("id").alias("b")), ["by", "look", "other"])
    return both.select("by", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
