"""Texts that were cut off by a limit or in transfer.

What a text ends with either settles the case (a closing mark, hashtags, an emoji, a whole address: complete; a broken
entity, character or address, or the mark of a limit: cut) or leaves it open. Open endings are settled in two ways. Texts
whose opening words are near-copies (min-hash bands of five-word shingles) are aligned word by word, and the copy whose
alignment ends inside a sentence of the other is cut. The rest is scored by the terminality of its closing words: how
often, over all distinct texts, authors end a text without a mark after these words in a sentence that opens like this one,
against how often such a sentence goes on.
"""

from __future__ import annotations

import ast
import functools
import json
import re
from collections import Counter
from collections.abc import Iterator
from operator import or_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.leakage import folded_words
from trendloom.llm.words import sentences, words
from trendloom.session import materialise, parts, spread

#: Words of a text's opening, words of a shingle, min-hash values, values of a band, and share of equal shingles.
OPENING, SHINGLE, HASHES, BAND, SIMILAR = 24, 5, 16, 2, 0.8
#: Uses of a closing that make it known; share of unmarked ends from which it closes a text; share of ends of a closing.
KNOWN, CLOSES, ENDS, LOOSE = 3, 0.03, 0.5, 0.1
#: A word that stands at unmarked ends only is none, but a piece of one, unless so many and such a share of the open texts end in it.
ENDINGS, ENDING_SHARE = 5, 0.008
FLUSHED = 400_000
#: Words of 64 bits of the filters that tell which contexts and last words are asked for; full ones let more through and lose none.
FILTER, PLACE_FILTER = 1 << 18, 1 << 20
#: Places of last words that a worker holds before it passes them on; words of which it remembers what beginnings are asked for.
PLACES, REMEMBERED = 100_000, 100_000
#: Places that are looked up as one.
NEAR = 8
#: Columns of 64 bits on which the words of a text are marked.
MARKED = ("m0", "m1", "m2", "m3")

_BROKEN = re.compile(r"�$|&#?\w{0,8}$|[,;:–—“‘«(\[\-/]$")
_MARKER = re.compile(r"(?:…|\.{3}) ?(?:xem thêm|đọc tiếp|see more|read more)$|[\[(](?:…|\.{3})[\])]$", re.I)
_ADDRESS = re.compile(r"https?:\S*$")
_WHOLE_ADDRESS = re.compile(r"https?://[^\s/]+\.[A-Za-z]{2,}/\S+$")
_DOTS = re.compile(r"(?:…|\.{3})$")
_CLOSED = re.compile(r"[.?!…][\"”’»)\]]*$|[\"”»)\]]$")
_TAG_OR_FOREIGN = re.compile(r"#\w+|[^\s0-9A-Za-zÀ-ɏḀ-ỿ]+")
_RAW = re.compile(r"[^\W_]+")
_LATIN_END = re.compile(r"[0-9A-Za-zÀ-ɏ̀-ͯḀ-ỿ%°$€₫]$")


def ending(text: str | None) -> tuple[str, str]:
    """What a text's end says (empty, broken, closed, open) and the text up to its closing words.

    The last parts between blanks decide, in time linear in the text's length.
    """
    t = (text or "").rstrip("﻿​‌‍‎⁠­ \t\r\n\x0b\x0c     ")
    if not re.search(r"\w", t):
        return "empty", ""
    last = t.rsplit(None, 3)[-3:]
    if m := _MARKER.search(" ".join(last)):
        body = t.rsplit(None, m[0].count(" "))[0]  # without the blanks within the mark
        return "broken", re.sub(r"[\[(]?(?:…|\.{3})\w*[\])]?$", "", body)
    if a := _ADDRESS.search(last[-1]):
        return ("closed" if _WHOLE_ADDRESS.search(last[-1]) else "broken"), t[: len(t) - len(last[-1]) + a.start()].rstrip()
    if _BROKEN.search(t):
        return "broken", t
    if _DOTS.search(t):
        return "open", _DOTS.sub("", t).rstrip()
    if len(last) > 1 and _TAG_OR_FOREIGN.fullmatch(last[-1]):
        spans = [m.span() for m in re.finditer(r"\S+", t)]
        while len(spans) > 1 and _TAG_OR_FOREIGN.fullmatch(t, *spans[-1]):
            spans.pop()
        return "closed", t[: spans[-1][1]]
    if _CLOSED.search(t) or not _LATIN_END.search(t):
        return "closed", t
    return "open", t


def closing(body: str) -> tuple[list[str], str, bool]:
    """The words of the last sentence, its last word as written, and whether it is closed by a mark."""
    last = sentences(body)
    if not last:
        return [], "", True
    raw = _RAW.findall(last[-1])
    return words(last[-1]), raw[-1] if raw else "", bool(_CLOSED.search(body))


def keys_of(body: str) -> dict[str, str]:
    """The contexts in which a text's closing words are looked up."""
    ws, raw, _ = closing(body)
    opener, last = " ".join(ws[:2]), " ".join(ws[-2:])
    return {"a": f"{opener}|{last}", "b": last, "c": opener, "d": raw}


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def key_hash(key: str) -> int:
    """64 bits of a context, as Spark's long."""
    return signed(xxhash.xxh64_intdigest(key))


def count_contexts(text: str, n: tuple[Counter, Counter, Counter]) -> None:
    """Adds a text to the counts (unmarked ends, marked ends, places where the sentence goes on) of its contexts."""
    state, body = ending(text)
    own = sentences(body)
    for k, s in enumerate(own):
        ws = words(s)
        if not ws:
            continue
        opener = " ".join(ws[:2])
        final = k == len(own) - 1
        how = 2 if final and state == "broken" else 1 if not final or _CLOSED.search(body) else 0
        last = [ws[0], *map(" ".join, zip(ws, ws[1:]))]
        after = [f"a|{opener}|{x}" for x in last]
        before = [f"b|{x}" for x in last]
        raw = _RAW.findall(s)
        n[how].update((after.pop(), before.pop(), f"c|{opener}", *[f"d|{raw[-1]}"] * bool(raw)))
        n[2].update(after)
        n[2].update(before)
        for w, x in zip(raw, raw[1:]):  # whether a name or word is over after this part of it
            n[2 if x[0].isupper() else 1][f"d|{w}"] += 1


def is_cut(c: dict[str, tuple[int, int, int]], raw: str, n_open: int) -> bool:
    """Whether an open ending is a cut, by the counts of its contexts; the text itself is one of the unmarked ends."""
    none = (0, 0, 0)
    d = c.get("d", none)
    whole = d[1] + max(0, d[0] - 1)
    rare = d[0] <= max(ENDINGS, ENDING_SHARE * n_open)
    if rare and 2 * d[1] < max(1, d[0]) or raw[:1].isupper() and whole < 0.1 * (whole + d[2]):
        return True  # no word, or no end of a name, elsewhere
    own, marked, on = c.get("a", none)
    own = max(0, own - 1)
    if own + marked + on >= KNOWN:
        return not (own >= 1 and own >= CLOSES * (marked + on))
    b, o = c.get("b", none), c.get("c", none)
    ends = max(0, b[0] - 1) + b[1]
    loose = max(0, o[0] - 1) >= LOOSE * max(1, sum(o) - 1)
    return not (loose and ends >= ENDS * max(1, ends + b[2]))


def aligned_end(a: list[str], b: list[str], most: int) -> int | None:
    """The words of ``b`` that ``a`` is aligned with, from the start of both, with the fewest words added, dropped or
    changed; None if more than ``most`` are. Diagonals are followed as far as words are equal, for one edit more each round."""
    n, m = len(a), len(b)
    far = {0: 0}
    for edits in range(most + 1):
        if edits:
            old, far = far, {}
            for d in range(-edits, edits + 1):
                i = max(old.get(d - 1, -1), old.get(d, -2) + 1, old.get(d + 1, -2) + 1)
                if 0 <= i <= n and 0 <= i + d <= m:
                    far[d] = i
                elif i > n:
                    far[d] = n
        for d in sorted(far, key=abs):
            i = far[d]
            while i < n and i + d < m and a[i] == b[i + d]:
                i += 1
            far[d] = i
            if i == n and 0 <= i + d <= m:
                return i + d
    return None


def changes(n: int) -> int:
    """How many words a near-copy of ``n`` words may have changed before its last."""
    return int((1 - SIMILAR) * (n - 1))


def cut_at(short: list[str], long: list[str]) -> int | None:
    """The words of ``long`` up to where ``short`` ends, if ``short`` is a near-copy of its beginning, but perhaps for a last word
    that is cut, and ``long`` goes on; words may be added, dropped or changed, as many as leave ``SIMILAR`` of them the same."""
    n = len(short)
    if n < 4:
        return None
    end = aligned_end(short[:-1], long, changes(n))
    if end is None or end >= len(long) or not long[end].startswith(short[-1]):
        return None
    return end + 1 if end + 1 < len(long) or long[end] != short[-1] else None


def aligned_verdict(short_body: str, long_text: str) -> bool | None:
    """True if the alignment of the copy ends inside a sentence of the other, False if only extras follow, None if they differ."""
    a, b = folded_words(short_body), folded_words(long_text)
    at = cut_at(a, b)
    if at is None:
        return None
    state, body = ending(long_text)
    whole = folded_words(body)
    if len(whole) <= at:
        # equal but for hashtags and the like, or the mark of the other's end
        return whole[-1:] != a[-1:] if len(whole) == at else False
    # the sentence boundary of the longer copy at this place, if any
    seen = 0
    for s in sentences(body):
        seen += len(folded_words(s))
        if seen >= at:
            return seen > at or b[at - 1] != a[-1]
    return None


_PERMUTED = np.random.default_rng(11).integers(1, 1 << 62, HASHES).astype(np.uint64) | np.uint64(1)


def bands(text: str) -> list[int]:
    """The min-hash bands of a text's opening words, 64 bits each."""
    size = 600
    while len(ws := folded_words(text[:size])) <= OPENING and size < len(text):  # the last word of a part may be cut
        size *= 4
    ws = ws[:OPENING]
    if len(ws) < SHINGLE:
        return []
    h = np.array([xxhash.xxh64_intdigest(" ".join(ws[k : k + SHINGLE])) for k in range(len(ws) - SHINGLE + 1)], np.uint64)
    mixed = h[None, :] * _PERMUTED[:, None]
    least = (mixed ^ (mixed >> np.uint64(31))).min(axis=1)
    return [signed(xxhash.xxh64_intdigest(least[k : k + BAND].tobytes(), k)) for k in range(0, HASHES, BAND)]


def mark(w: str) -> int:
    """One of the bits of ``MARKED`` for a word."""
    return 1 << xxhash.xxh32_intdigest(w) % (64 * len(MARKED))


def marked(bits: list[int]) -> pd.DataFrame:
    raw = b"".join(x.to_bytes(8 * len(MARKED), "little") for x in bits)
    return pd.DataFrame(np.frombuffer(raw, np.int64).reshape(-1, len(MARKED)), columns=list(MARKED))


def near_hash(n: np.ndarray) -> np.ndarray:
    """64 other bits of a number."""
    x = (n.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def bit_table(keys: DataFrame, size: int = FILTER) -> np.ndarray:
    """One bit for each ``key``, a long, in a table of fixed size."""
    bits = keys.select(F.pmod(F.shiftright("key", 6), F.lit(size)).alias("word"), F.expr("shiftleft(1L, CAST(key & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table_ = np.zeros(size, np.int64)
    table_[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    return table_


def in_table(keys: np.ndarray, table_: np.ndarray) -> np.ndarray:
    return table_[(keys >> 6) % len(table_)] >> (keys & 63) & 1 == 1


def parse_items(text: str | None) -> tuple[list[dict], int]:
    """The objects of a list written as JSON or in single quotes, and the place of the object it breaks off in (else -1)."""
    items: list[dict] = []
    if not text or "{" not in text:
        return items, -1
    depth, quote, skip, start = 0, "", False, 0
    for k, c in enumerate(text):
        if skip:
            skip = False
        elif quote:
            if c == "\\":
                skip = True
            elif c == quote:
                quote = ""
        elif depth and c in "\"'":
            quote = c
        elif c == "{":
            if not depth:
                start = k
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                items.append(_object(text[start : k + 1]))
    if depth:
        items.append(_object(text[start:]))
        return items, len(items) - 1
    return items, -1


def _object(text: str) -> dict:
    for read in (json.loads, ast.literal_eval):
        try:
            x = read(text)
            return x if isinstance(x, dict) else {}
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
    m = re.search(r"['\"]source['\"]\s*:\s*['\"]([^'\"]*)['\"]", text)
    return {"source": m[1]} if m else {}


def items_of(df: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """``row_id, pos, source, text, broken_off``: the items of a column of lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["row_id"], b["t"]):
                items, at = parse_items(t)
                for k, x in enumerate(items):
                    text, source = x.get("content"), x.get("source")
                    out.append((i, k, source if isinstance(source, str) else None, text if isinstance(text, str) else None, k == at))
            yield pd.DataFrame(out, columns=["row_id", "pos", "source", "text", "broken_off"])

    src = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(list_col).cast("string").alias("t")).where("t IS NOT NULL")
    return spread(src).mapInPandas(run, "row_id long, pos int, source string, text string, broken_off boolean")


def find_truncated(texts: DataFrame) -> DataFrame:
    """``tbl, row_id, pos, source, cut`` for every row of ``texts`` (``tbl, row_id, pos, source, text, broken_off``).

    Defined cases: null, empty and wordless texts are not cut unless the list broke off in them; equal texts get equal
    verdicts and count once in the statistics; whole texts are read; repeated rows stay repeated; an empty table gives
    none. Statistics and copies meet by hash keys. An open text meets the longest text of each of its bands; one that this doesn't
    settle meets all longer texts of its bands that have its last word, perhaps cut, about where it ends, as every text that it is
    a copy of has it there: a hot band gives pairs of the texts that go on alike, not of all.
    """
    texts = texts.withColumns({"h1": F.xxhash64("text"), "h2": F.hash("text")})
    one = texts.where("text IS NOT NULL").groupBy("h1", "h2").agg(F.min("text").alias("text"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [ending(t) for t in b["text"]]
            yield b.assign(state=[s for s, _ in both], body=[x if s == "open" else "" for s, x in both], size=b["text"].str.len(), bands=[bands(t) if s != "empty" else [] for t, (s, _) in zip(b["text"], both)])

    if texts.rdd.getNumPartitions() < 2 * parts(texts.sparkSession):  # small: adaptive execution would join its partitions
        one = one.repartition(parts(texts.sparkSession), "h1", "h2")
    one = materialise(one.mapInPandas(look, "h1 long, h2 int, text string, state string, body string, size long, bands array<long>"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(h1, h2, k, key_hash(f"{k}|{key}"), key) for h1, h2, t in zip(b["h1"], b["h2"], b["body"]) for k, key in keys_of(t).items()], columns=["h1", "h2", "kind", "key", "raw"])

    open_ = one.where("state = 'open'")
    n_open = open_.count()
    asked = materialise(open_.select("h1", "h2", "body").mapInPandas(ask, "h1 long, h2 int, kind string, key long, raw string"))
    shared = texts.sparkSession.sparkContext.broadcast(bit_table(asked))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = (Counter(), Counter(), Counter())

        def counted() -> pd.DataFrame:
            found = []
            for at, c in enumerate(n):
                keys = np.array([key_hash(k) for k in c], np.int64)
                wanted = in_table(keys, shared.value)
                v = np.zeros((np.count_nonzero(wanted), 3), np.int64)
                v[:, at] = np.array(list(c.values()), np.int64)[wanted]
                found.append(pd.DataFrame({"key": keys[wanted], "own": v[:, 0], "marked": v[:, 1], "goes_on": v[:, 2]}))
                c.clear()
            return pd.concat(found)

        for b in batches:
            for t in b["text"]:
                count_contexts(t, n)
                if sum(map(len, n)) > FLUSHED:
                    yield counted()
        yield counted()

    counts = one.select("text").mapInPandas(count, "key long, own long, marked long, goes_on long")
    counts = counts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("own", "marked", "goes_on")])
    told = asked.join(counts, "key").groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct("kind", F.array("own", "marked", "goes_on")))).alias("told"), F.max(F.when(F.col("kind") == "d", F.col("raw"))).alias("raw"))

    # near-copies: every open text with the longest text of each of its bands, then with all that it may be a copy of
    banded = one.select("h1", "h2", "size", F.explode("bands").alias("band"))
    longest = banded.groupBy("band").agg(F.max(F.struct("size", "h1", "h2")).alias("top"), F.count("*").alias("n")).where("n > 1").select("band", F.col("top.h1").alias("b1"), F.col("top.h2").alias("b2"), F.col("top.size").alias("b_size"))
    first = open_.select("h1", "h2", "size", F.explode("bands").alias("band")).join(longest, "band").where("b_size > size").select("h1", "h2", "b1", "b2").distinct()

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["h1", "h2"]].assign(verdict=[aligned_verdict(s, t) for s, t in zip(b["body"], b["long"])]).astype({"verdict": "object"})

    def verdicts_of(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(open_.select("h1", "h2", "body"), ["h1", "h2"]).join(one.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("text").alias("long")), ["b1", "b2"])
        return pairs.mapInPandas(align, "h1 long, h2 int, verdict boolean").groupBy("h1", "h2").agg(F.max("verdict").alias("verdict"))

    settled = materialise(verdicts_of(first))
    aligned = settled.unionByName(verdicts_of(_may_be_copies(one, settled.where("verdict IS NULL OR NOT verdict")))).groupBy("h1", "h2").agg(F.max("verdict").alias("verdict"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = [is_cut({k: tuple(v) for k, v in (t if isinstance(t, dict) else dict(t)).items()}, raw or "", n_open) if t is not None else True for t, raw in zip(b["told"], b["raw"])]
            yield b[["h1", "h2"]].assign(scored=cut)

    scored = told.mapInPandas(judge, "h1 long, h2 int, scored boolean")
    verdicts = one.select("h1", "h2", "state").join(scored, ["h1", "h2"], "left").join(aligned, ["h1", "h2"], "left")
    cut = F.when(F.col("state") == "open", F.coalesce("verdict", "scored", F.lit(True))).otherwise(F.col("state") == "broken")
    return texts.join(verdicts.select("h1", "h2", cut.alias("__cut")), ["h1", "h2"], "left").select("tbl", "row_id", "pos", "source", (F.col("broken_off") | F.coalesce("__cut", F.lit(False))).alias("cut"))


def _may_be_copies(one: DataFrame, unsettled: DataFrame) -> DataFrame:
    """``h1, h2, b1, b2``: the ``unsettled`` texts of ``one`` with all longer texts of their bands that have their last
    word, or one that begins so, where an alignment with at most ``changes`` can end, and before it no more than so many
    words of either that the other has not; words with equal marks count as the same one, which leaves out no pair."""
    spark = one.sparkSession

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.reset_index(drop=True)
            ws = [folded_words(t) for t in b["body"]]
            n = np.array([len(w) for w in ws], np.int64)
            most = np.array([changes(k) for k in n], np.int64)
            b = b.drop(columns="body").assign(word=(last := np.array([key_hash(w[-1]) if w else 0 for w in ws], np.int64)), last=last, low=n - 1 - most, high=n - 1 + most)[n >= 4]
            marks = marked([functools.reduce(or_, map(mark, w[:-1]), 0) for w in ws]).set_index(pd.RangeIndex(len(ws)))
            b = b.join(marks).assign(most=(b["high"] - b["low"]) // 2, near=[range(x // NEAR, y // NEAR + 1) for x, y in zip(b["low"], b["high"])]).explode("near")
            b = b.assign(last=b["last"] ^ near_hash(b.pop("near").to_numpy(np.int64))).explode("bands")
            b = b.assign(key=b.pop("bands").astype("int64") ^ b["last"])
            yield b.assign(again=near_hash(b["key"].to_numpy()))

    asked = one.where("state = 'open' AND size(bands) > 0").select("h1", "h2", "size", "bands", "body").join(unsettled.select("h1", "h2"), ["h1", "h2"])
    asked = materialise(asked.mapInPandas(ask, f"h1 long, h2 int, size long, word long, last long, low long, high long, {', '.join(f'{c} long' for c in MARKED)}, most long, key long, again long"))
    far = asked.agg(F.max("high")).first()[0]
    if far is None:
        return unsettled.select("h1", "h2", F.col("h1").alias("b1"), F.col("h2").alias("b2")).limit(0)
    shared = spark.sparkContext.broadcast(tuple(bit_table(asked.select(F.col(c).alias("key")), size) for c, size in (("word", FILTER), ("last", FILTER), ("key", PLACE_FILTER), ("again", PLACE_FILTER))))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, near, keyed, again = shared.value
        remembered: dict[str, tuple[int, list[int]]] = {}

        def known(w: str) -> tuple[int, list[int]]:
            if len(remembered) >= REMEMBERED:
                remembered.clear()
            keys = np.array([key_hash(w[:k]) for k in range(1, len(w) + 1)], np.int64)
            remembered[w] = found = mark(w), keys[in_table(keys, last)].tolist()
            return found

        def rows(b: pd.DataFrame, starts: list[int], before: list[int], word: list[int], keys: list[int]) -> pd.DataFrame:
            word_, key = np.array(word, np.int64), np.array(keys, np.int64)
            row = np.searchsorted(starts, word_, side="right") - 1
            at = word_ - np.array(starts, np.int64)[row]
            key = key ^ near_hash(at // NEAR)
            wanted = in_table(key, near)
            word_, key, row, at = word_[wanted], key[wanted], row[wanted], at[wanted]
            own = b["bands"].to_numpy()[row]
            of = np.repeat(np.arange(len(row)), np.array([len(x) for x in own], np.int64))
            key = key[of] ^ np.concatenate([np.empty(0, np.int64), *own]).astype(np.int64)
            wanted = in_table(key, keyed)
            wanted[wanted] = in_table(near_hash(key[wanted]), again)
            of, key = of[wanted], key[wanted]
            there, place = np.unique(word_[of], return_inverse=True)
            marks = marked([before[k] for k in there]).iloc[place].reset_index(drop=True)
            return pd.concat([b[["b1", "b2", "b_size"]].iloc[row[of]].reset_index(drop=True).assign(at=at[of]), marks, pd.DataFrame({"key": key})], axis=1)

        for b in batches:
            at, starts, before, word, keys = 0, [], [], [], []  # before: the marks of the words before each word
            for n, t in enumerate(b["text"]):
                starts.append(len(before))
                marks = 0
                for w in folded_words(t)[: far + 1]:
                    bit, asked_ = remembered.get(w) or known(w)
                    for k in asked_:
                        word.append(len(before))
                        keys.append(k)
                    before.append(marks)
                    marks |= bit
                if len(before) + len(word) >= PLACES:
                    yield rows(b.iloc[at : n + 1], starts, before, word, keys)
                    at, starts, before, word, keys = n + 1, [], [], [], []
            yield rows(b.iloc[at:], starts, before, word, keys)

    others = one.where(F.size("bands") > 0).select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("size").alias("b_size"), "bands", "text")
    of = [f"b_{c}" for c in MARKED]
    others = others.mapInPandas(places, f"b1 long, b2 int, b_size long, at long, {', '.join(f'{c} long' for c in MARKED)}, key long").withColumnsRenamed(dict(zip(MARKED, of)))
    lacks = lambda x, y: sum((F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b)))) for a, b in zip(x, y)), F.lit(0))
    pairs = asked.join(others, "key").where((F.col("b_size") > F.col("size")) & F.col("at").between(F.col("low"), F.col("high")) & (lacks(MARKED, of) <= F.col("most")) & (lacks(of, MARKED) <= F.col("most")))
    return pairs.select("h1", "h2", "b1", "b2").distinct()
