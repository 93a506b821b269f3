"""Documents that hold passages of held-out test items, whole, in part or reworded.

Words are folded (case, accents, punctuation and layout go). Windows of ``WINDOW`` words at every place of the items
and of the documents are embedded by the CGK random walk, which maps edit distance to Hamming distance: at each step the
walk emits the word it stands on and a random bit of that word says whether it moves on. Bit sampling hashes some of the
emitted words, in independent walks, and windows that share a hash propose the item. There are as many walks as it takes to
propose ``TARGET`` of copies of the items of which only ``share`` of the words are kept. A proposed item is aligned exactly
with the words around its windows (longest common subsequence, the edit distance of words dropped and put in), and the
share of the item's words held in order decides. Few items are an index that goes to every worker; more than ``MOST_WORDS``
words of items are a table of hashes that meets the documents' hashes in a join.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from trendloom.session import materialise, spread

#: Words of a window; words sampled from a walk.
WINDOW, SAMPLED = 8, 4
#: A case holds at least this share of the item's words, in order.
SHARE = 0.5
#: Share of barely held copies that the walks must propose, the items it is measured on (those of the smallest hashes), most walks.
TARGET, MEASURED, MOST_TABLES = 0.998, 300, 32
#: Words of all items up to which every worker holds their index (with 8 walks about 60 MB); beyond, hashes are joined.
MOST_WORDS = 500_000
#: Words of 64 bits of the filter of the items' hashes in the join; a full one lets more through and loses none.
FILTER = 1 << 20

_MARKS = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u2060\ufeff]+")  # accents and what isn't seen
_WORDS = re.compile(r"\w+")


def folded_words(text: str | None) -> list[str]:
    """The words of a text without case, accents and punctuation."""
    if not text:
        return []
    return _WORDS.findall(_MARKS.sub("", unicodedata.normalize("NFKD", text.lower())).replace("đ", "d"))


def common_words(item: list[int], words: np.ndarray) -> int:
    """Length of the longest common subsequence, by one integer of a bit per word of the item."""
    at: dict[int, int] = {}
    for k, x in enumerate(item):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for y in words.tolist():
        m = at.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def walk(flat: np.ndarray, starts: np.ndarray, size: int, codes: np.ndarray, table: int) -> np.ndarray:
    """The hashes of the sampled words of the walk ``table`` over the windows of ``size`` words at ``starts``.

    ``flat`` holds places in ``codes``, the hashes of the words; the last code stands for what is behind a window.
    """
    rng = np.random.default_rng([size, table])
    last = size + size // 2
    steps = set(np.sort(rng.choice(last, min(SAMPLED, last), replace=False)).tolist())
    salts = rng.integers(1, 1 << 62, last).astype(np.uint64)
    at, end, pad = starts.copy(), starts + size, len(codes) - 1
    h = np.full(len(starts), _mixed(salts[:1])[0], np.uint64)
    for j in range(max(steps) + 1):
        word = np.where(at < end, np.take(flat, at, mode="clip"), pad)
        if j in steps:
            h = _mixed(h ^ np.take(codes, word))
        at += np.take((_mixed(codes ^ salts[j]) & np.uint64(1)).astype(np.int64), word)
    return h


def _codes(vocabulary: dict[str, int]) -> np.ndarray:
    """The codes of words numbered from 1; 0 is a word that isn't in the vocabulary, and the last is behind a window."""
    return np.array([0, *map(code, vocabulary), 1], np.uint64)


def tables_needed(items: list[list[str]], share: float, seed: int = 5) -> int:
    """Walks that propose ``TARGET`` of copies of ``items`` that hold ``share`` of the words, the rest being dropped or changed."""
    rng = np.random.default_rng(seed)
    copies, own = [], []
    for ws in items:
        for changed in (False, True):
            kept = np.zeros(len(ws), bool)
            kept[rng.choice(len(ws), max(1, -(-int(1000 * share * len(ws)) // 1000)), replace=False)] = True
            copies.append([w if k else f"\0{n}" for n, (w, k) in enumerate(zip(ws, kept)) if k or changed])
            own.append(ws)
    if not copies:
        return 1
    found = np.zeros(len(copies), bool)
    vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for ws in (*copies, *own) for w in ws), 1)}
    codes = _codes(vocabulary)

    def hashes(ws: list[str], size: int, table: int) -> np.ndarray:
        flat = np.array([vocabulary[w] for w in ws], np.int64)
        return walk(flat, np.arange(max(1, len(ws) - size + 1)), size, codes, table) if len(ws) else np.empty(0, np.uint64)

    for table in range(MOST_TABLES):
        for n, (a, b) in enumerate(zip(copies, own)):
            if not found[n]:
                size = min(WINDOW, len(b))
                found[n] = np.isin(hashes(a, size, table), hashes(b, size, table)).any()
        if found.mean() >= TARGET:
            return table + 1
    return MOST_TABLES


def held(item: list[int], words: np.ndarray, places: np.ndarray) -> float:
    """The share of an item's words that stand in order in the words around ``places``, as many on either side as the item has."""
    near = np.zeros(len(words) + 1, np.int64)
    np.add.at(near, np.maximum(0, places - len(item)), 1)
    np.add.at(near, np.minimum(len(words), places + WINDOW + len(item)), -1)
    return common_words(item, words[np.cumsum(near[:-1]) > 0]) / len(item)


class ItemIndex:
    """The windows of all items by their sampled walks."""

    def __init__(self, items: list[tuple[int, str | None]], tables: int):
        self.ids = [i for i, _ in items]
        words = [folded_words(t) for _, t in items]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}), 1)}
        self.codes = _codes(self.vocabulary)
        self.items = [[self.vocabulary[w] for w in ws] for ws in words]
        self.sizes = np.array([len(ws) for ws in self.items], np.int64)
        self.first = np.cumsum([0, *self.sizes])
        self.flat = np.concatenate([np.array(ws, np.int64) for ws in [*self.items, [0]]])
        self.classes = []  # by window size: items shorter than WINDOW have their own
        for size in sorted({min(WINDOW, len(ws)) for ws in self.items if ws}):
            own = [k for k, ws in enumerate(self.items) if ws and min(WINDOW, len(ws)) == size]
            starts = np.concatenate([self.first[k] + np.arange(len(self.items[k]) - size + 1) for k in own])
            owner = np.concatenate([np.full(len(self.items[k]) - size + 1, k, np.int32) for k in own])
            by_table = []
            for t in range(tables):
                h = walk(self.flat, starts, size, self.codes, t)
                order = np.argsort(h, kind="stable")
                by_table.append((h[order], owner[order]))
            self.classes.append((size, by_table))

    def search(self, texts: list[str | None], share: float) -> list[tuple[int, int, float]]:
        """(place in ``texts``, place in the items, share of the item's words) of each case."""
        lookup, longest = self.vocabulary.get, max([s for s, _ in self.classes], default=0)
        docs = [np.fromiter((lookup(w, 0) for w in folded_words(t)), np.int64) for t in texts]
        gap = np.zeros(longest, np.int64)
        first = np.cumsum([0] + [len(d) + longest for d in docs])
        flat = np.concatenate([x for d in docs for x in (d, gap)]) if docs else gap
        known = np.r_[0, np.cumsum(flat > 0)]
        hits = []
        for size, tables in self.classes:
            starts = np.arange(max(0, len(flat) - size + 1))
            starts = starts[(known[starts + size] - known[starts] >= size / 2) & (flat[starts] > 0)]  # else more than half of the window is no item's
            for t, (keys, owner) in enumerate(tables):
                h = walk(flat, starts, size, self.codes, t)
                left = np.searchsorted(keys, h, "left")
                some = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == h)
                left, at = left[some], starts[some]
                n = np.searchsorted(keys, h[some], "right") - left
                which = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())
                hits.append((np.repeat(at, n), owner[which]))
        if not hits:
            return []
        at, k = np.concatenate([a for a, _ in hits]), np.concatenate([b for _, b in hits]).astype(np.int64)
        d = np.searchsorted(first, at, "right") - 1
        pair, inverse = np.unique(d * len(self.items) + k, return_inverse=True)
        d_of, k_of = pair // len(self.items), pair % len(self.items)
        # what a document has at all of an item's words bounds what it has of them in order
        has = np.zeros((len(docs), len(self.codes)), bool)
        has[np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate([*docs, gap[:0]])] = True
        enough = np.zeros(len(pair), bool)
        for part in np.array_split(np.arange(len(pair)), max(1, len(pair) // 20_000)):
            n = self.sizes[k_of[part]]
            ends = np.cumsum(n)
            words = self.flat[np.repeat(self.first[k_of[part]] - (ends - n), n) + np.arange(n.sum())]
            some = has[np.repeat(d_of[part], n), words]
            enough[part] = np.add.reduceat(some.astype(np.int64), ends - n) >= share * n if len(part) else False
        kept = enough[inverse]
        order = np.argsort(inverse[kept], kind="stable")
        pairs, places = inverse[kept][order], (at - first[d])[kept][order]
        bounds = np.flatnonzero(np.r_[True, np.diff(pairs) > 0, True]) if len(pairs) else [0]
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            doc, item = int(d_of[pairs[a]]), int(k_of[pairs[a]])
            x = held(self.items[item], docs[doc], np.unique(places[a:b]))
            if x >= share:
                out.append((doc, item, x))
        return out


def _bucketed(df: DataFrame, sizes: list[int], tables: int, bits: np.ndarray | None) -> DataFrame:
    """``key, size, place, hash`` of the windows of ``key, t``: of items those of their own size (``bits`` None), of documents those of all sizes that pass the filter."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, text in zip(b["key"], b["t"]):
                ws = folded_words(text)
                vocabulary = {w: n for n, w in enumerate(dict.fromkeys(ws), 1)}
                codes, flat = _codes(vocabulary), np.array([vocabulary[w] for w in ws], np.int64)
                for size in sizes:
                    if len(ws) < size or shared.value is None and size != min(WINDOW, len(ws)):
                        continue
                    starts = np.arange(len(ws) - size + 1)
                    for t in range(tables):
                        h = walk(flat, starts, size, codes, t).astype(np.int64)
                        some = starts
                        if shared.value is not None:
                            some = np.flatnonzero(shared.value[(h >> 6) % FILTER] >> (h & 63) & 1 == 1)
                        yield pd.DataFrame({"key": np.full(len(some), key), "size": np.full(len(some), size, np.int32), "place": some.astype(np.int32), "hash": h[some]})

    return spread(df).mapInPandas(run, "key long, size int, place int, hash long")


def _joined(docs: DataFrame, items: DataFrame, sizes: list[int], tables: int, share: float) -> DataFrame:
    """``doc_id, item_id, share`` of the cases, by a join of the hashes; rows of one id and different texts are told apart."""
    docs = docs.select("doc_id", "t", F.xxhash64("doc_id", "t").alias("key"))
    items = materialise(items.select("item_id", "t", F.xxhash64("item_id", "t").alias("key")))
    own = materialise(_bucketed(items.select("key", "t"), sizes, tables, None).select("key", "size", "hash").distinct())
    bits = own.select(F.pmod(F.shiftright("hash", 6), F.lit(FILTER)).alias("word"), F.expr("shiftleft(1L, CAST(hash & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(FILTER, np.int64)
    for r in bits.collect():  # a table of fixed size
        table[r["word"]] = r["bits"]
    sizes = [r["size"] for r in own.select("size").distinct().collect()]  # at most WINDOW of them
    asked = _bucketed(docs.select("key", "t"), sizes, tables, table)
    pairs = asked.join(own.withColumnRenamed("key", "item"), ["size", "hash"]).groupBy("key", "item").agg(F.collect_set("place").alias("places"))
    full = pairs.join(docs.dropDuplicates(["key"]), "key").join(items.select(F.col("key").alias("item"), "item_id", F.col("t").alias("item_text")), "item")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shares = []
            for text, item, places in zip(b["t"], b["item_text"], b["places"]):
                ws = folded_words(item)
                vocabulary = {w: n for n, w in enumerate(dict.fromkeys(ws), 1)}
                shares.append(held([vocabulary[w] for w in ws], np.array([vocabulary.get(w, 0) for w in folded_words(text)], np.int64), np.unique(places)))
            yield b[["doc_id", "item_id"]].assign(share=np.array(shares, float))

    return full.select("doc_id", "item_id", "t", "item_text", "places").mapInPandas(verify, "doc_id long, item_id long, share double").where(F.col("share") >= share)


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """``doc_id, item_id, share``: documents that hold at least ``share`` of an item's words in the item's order.

    Defined cases: null, empty and wordless texts on either side make no case; a repeated document or item row gives
    its pairs once, with the largest share; items of fewer words than a window have windows of their own size; whole
    texts are searched, however long; other columns are not looked at; an empty table gives none. The corpus is mapped and
    not shuffled, only cases are; with more than ``MOST_WORDS`` words of items the hashes of windows that some item has, too.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("t")).where(F.col("t").isNotNull()).distinct()
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    sample = [folded_words(r["t"]) for r in items.orderBy(F.xxhash64("item_id", "t")).limit(MEASURED).collect()]
    tables = tables_needed([ws for ws in sample if ws], share)
    if (items.agg(F.sum(F.size(F.split("t", r"[^\p{L}\p{N}]+")))).first()[0] or 0) > MOST_WORDS:
        return _joined(src, items, list(range(1, WINDOW + 1)), tables, share).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
    shared = spark.sparkContext.broadcast(ItemIndex(sorted((r[0], r[1]) for r in items.collect()), tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for at in range(0, len(texts), 500):
                found = index.search(texts[at : at + 500].to_pylist(), share)
                if found:
                    d, k, s = zip(*found)
                    yield pa.RecordBatch.from_arrays([ids[at : at + 500].take(pa.array(d)), pa.array([index.ids[x] for x in k], pa.int64()), pa.array(s, pa.float64())], names=["doc_id", "item_id", "share"])

    schema = StructType([StructField("doc_id", LongType()), StructField("item_id", LongType()), StructField("share", DoubleType())])
    return spread(src).mapInArrow(run, schema).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
