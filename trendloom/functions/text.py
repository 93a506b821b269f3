"""Text functions as column expressions: they stay in generated code and never leave the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of the sentiment fallback, by label.
POSITIVE = ("tốt", "tuyệt", "vui", "thắng", "tăng", "đẹp", "good", "great", "happy", "win", "gold", "record")
NEGATIVE = ("xấu", "buồn", "thua", "giảm", "chết", "hỏng", "bad", "sad", "lost", "fraud", "jammed", "rejected")
#: Categories by keyword, in order of priority; keywords of up to 3 letters must stand alone.
TAXONOMY = (
    ("T1", ("bão", "lũ", "động đất", "sạt lở", "cháy", "storm", "flood", "tremor", "wildfire")),
    ("T2", ("giáo dục", "y tế", "bệnh", "thuốc", "học", "giao thông", "hospital", "school", "traffic", "vaccine")),
    ("T3", ("chính sách", "nghị quyết", "thông tư", "quốc hội", "decree", "policy", "council")),
    ("T6", ("công an", "tòa", "bị cáo", "khởi tố", "lừa đảo", "court", "fraud", "suspect")),
    ("T4", ("giá", "lãi suất", "cổ phiếu", "xuất khẩu", "bank", "bond", "exchange rate")),
    ("T5", ("phim", "ca sĩ", "hoa hậu", "bóng", "ai", "concert", "album", "singer", "coach")),
    ("T7", ("du lịch", "lễ hội", "thời tiết", "beach", "cruise", "weather")),
)
NO_CATEGORY = "T7"
#: Labels that stand for no topic.
NO_TOPIC = ("unknown", "unassigned", "n/a", "", "noise", "[noise]", "discovery", "none", "null", "-1")
#: Prefixes under which a source repeats its own name.
SOURCE_PREFIXES = (r"^\s*\[[^\]]{1,30}\]\s*", r"^\s*\([^)]{1,30}\)\s*[-–:]\s*", r"^\s*(?i:breaking|tin nóng|cập nhật từ [^:]{1,30}|update from [^:]{1,30})\s*:\s*")


@cache
def _folding() -> tuple[str, str]:
    """Accented Latin letters and their plain ones; đ isn't composed of d and stays."""
    a, b = [], []
    for n in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(n).lower()
        d = unicodedata.normalize("NFD", c)
        if len(c) == 1 and len(d) > 1 and len(base := d[0]) == 1 and c not in a:
            a.append(c)
            b.append(base)
    return "".join(a), "".join(b)


def collapse(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def fold(x: Column, fold_d: bool = False) -> Column:
    """Lower case without accents, white space collapsed; ``đ`` stays unless ``fold_d``."""
    a, b = _folding()
    y = F.regexp_replace(F.translate(F.lower(x), a, b), r"\p{M}+", "")
    return collapse(F.translate(y, "đ", "d") if fold_d else y)


def strip_credit(x: Column) -> Column:
    """Without a credit (source, via, photo) to the end of its line."""
    return F.trim(F.regexp_replace(x, r"(?i)\b(?:cre|credit|via|nguồn|source)\s*:[^\n]*", ""))


def strip_source_prefix(x: Column) -> Column:
    """Each known kind of prefix taken off once."""
    for p in SOURCE_PREFIXES:
        x = F.regexp_replace(x, p, "")
    return F.trim(x)


def english_share(x: Column) -> Column:
    """ASCII letters among all letters, null without letters."""
    letters = F.regexp_count(x, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(x, F.lit("[A-Za-z]")) / letters)


def hashtags(x: Column) -> Column:
    """The tags of a text in order, lower case, without the sign."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"(?U)#(\w+)"), 1), F.lower)


def tokens(x: Column, least: int = 2) -> Column:
    """Lower-case words of at least ``least`` letters or digits."""
    return F.regexp_extract_all(F.lower(x), F.lit(rf"([\p{{L}}\p{{M}}\p{{N}}_]{{{least},}})"), 1)


def plain_url(x: Column) -> Column:
    """An address without fragment, query and one slash at the end."""
    return F.regexp_replace(F.regexp_replace(x, r"[#?].*$", ""), "/$", "")


def volume(x: Column) -> Column:
    """A search volume such as ``50 N+``, ``2 Tr+`` or ``1.000+`` as a number; 0 if there is none."""
    y = F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), "[.,]", ""))
    n = F.coalesce(F.regexp_extract(y, r"(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    million = y.rlike("TR|M")
    return n * F.when(million, F.lit(1_000_000).cast("bigint")).when(y.rlike("N|K"), F.lit(1_000).cast("bigint")).otherwise(F.lit(1).cast("bigint"))


def mostly_numeric(x: Column) -> Column:
    """At least 60 % digits and at most one letter."""
    digits, letters = F.regexp_count(x, F.lit(r"\p{Nd}")), F.regexp_count(x, F.lit(r"\p{L}"))
    return (digits >= F.greatest(F.lit(1), F.floor(F.length(x) * 0.6))) & (letters <= 1)


def symbol_share(x: Column) -> Column:
    """Characters that are no letter, mark, digit or blank."""
    return F.when(F.length(x) > 0, 1 - F.regexp_count(x, F.lit(r"[\p{L}\p{M}\p{N}\s]")) / F.length(x))


def dated(x: Column) -> Column:
    """Whether a text names a day such as 7/12 or 7-12-2025."""
    return x.rlike(r"\d{1,2}[/-]\d{1,2}([/-]\d{2,4})?")


def garbage_keyword(x: Column) -> Column:
    """Up to two characters, digits only, or up to three ASCII letters."""
    return (F.length(x) <= 2) | x.rlike(r"^\d+$") | x.rlike("^[a-z]{1,3}$")


def bad_versus(x: Column) -> Column:
    """A match-up that lacks a side: ends with vs, or one side has under 3 characters."""
    left, right = F.trim(F.split_part(x, F.lit(" vs "), F.lit(1))), F.trim(F.split_part(x, F.lit(" vs "), F.lit(2)))
    return F.trim(x).endswith(" vs") | (F.contains(x, F.lit(" vs ")) & ((F.length(left) < 3) | (F.length(right) < 3)))


def guard_reason(x: Column) -> Column:
    """Why a trend name is refused, or null: the first test that it fails."""
    y = fold(x)
    return (
        F.when(F.length(y) < 4, "short").when(bad_versus(y), "versus").when(mostly_numeric(y) & (F.length(y) <= 6), "numeric")
        .when(symbol_share(y) > 0.30, "symbols").when(dated(y), "date").when(y.rlike(r"^\d+$"), "digits")
    )


def category(x: Column) -> Column:
    """The first category of the taxonomy of which the text has a keyword."""
    y = F.lower(x)
    out = F.lit(NO_CATEGORY)
    for code, keys in reversed(TAXONOMY):
        hit = None
        for k in keys:
            h = y.rlike(rf"(^|[^\p{{L}}\p{{N}}]){k}($|[^\p{{L}}\p{{N}}])") if len(k) <= 3 else F.contains(y, F.lit(k))
            hit = h if hit is None else hit | h
        out = F.when(hit, code).otherwise(out)
    return F.when(x.isNotNull(), out)


def sentiment(x: Column) -> Column:
    """Positive, Negative or Neutral, by which list has more words in the text."""
    y = F.lower(x)
    count = lambda keys: F.size(F.filter(F.array(*map(F.lit, keys)), lambda k: F.contains(y, k)))
    p, n = count(POSITIVE), count(NEGATIVE)
    return F.when(x.isNull(), None).when(p > n, "Positive").when(n > p, "Negative").otherwise("Neutral")


def sentiment_label(x: Column) -> Column:
    """One label set for the spellings that models use."""
    y = F.upper(F.trim(x))
    return F.when(y.isin("POS", "POSITIVE", "LABEL_2", "TÍCH CỰC"), "Positive").when(y.isin("NEG", "NEGATIVE", "LABEL_0", "TIÊU CỰC"), "Negative").when(y.isin("NEU", "NEUTRAL", "LABEL_1", "TRUNG TÍNH", "TRUNG LẬP"), "Neutral")


def topic_of(x: Column) -> Column:
    """A topic label in lower case without the mark of a new one; null for labels that stand for none."""
    y = F.trim(F.regexp_replace(F.lower(F.trim(x)), "^new:", ""))
    return F.when(~y.isin(*NO_TOPIC), y)


def source_type(x: Column) -> Column:
    return F.when(x.isNull(), None).when(F.contains(x, F.lit("Face")), "social").otherwise("news")


def short_name(x: Column, most: int = 40) -> Column:
    """``New: `` and the first characters of a text, with dots if it is longer."""
    return F.concat(F.lit("New: "), F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x))


def keyword_list(x: Column) -> Column:
    """Keywords written as a JSON list or separated by commas: trimmed, without empty ones."""
    raw = F.when(F.ltrim(x).startswith("["), F.from_json(x, "array<string>")).otherwise(F.split(x, ","))
    return F.filter(F.transform(raw, lambda k: F.trim(k)), lambda k: k != "")


def smart_query(name: Column, keywords: Column, most: int = 5) -> Column:
    """The name and up to ``most`` keywords, none a part of another one chosen (order counts)."""
    start = F.array(F.lower(name))
    chosen = F.aggregate(
        keywords, start,
        lambda acc, k: F.when((F.size(acc) <= most) & ~F.exists(acc, lambda s: F.contains(F.lower(k), s) | F.contains(s, F.lower(k))), F.array_append(acc, F.lower(k))).otherwise(acc),
    )
    return F.array_join(chosen, " ")


def any_contains(text: Column, terms: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), t))
