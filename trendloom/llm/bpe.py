"""Encoding a whole corpus with a byte-level BPE vocabulary, by batched numpy merge rounds.

The words of a batch of texts are looked up in a table of words already encoded; the new ones are laid
out as one flat array of symbols and merged together: a round finds the rank of every neighbouring pair
by binary search over the sorted pair keys, takes the lowest rank of each word, and merges its places.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from trendloom.session import spread

#: Fixed value: how the published byte-level BPE splits text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words of more bytes go through a heap instead of rounds, whose number grows with the longest word.
LONG_WORD = 256
#: Words kept by a worker; at this number the table is emptied and filled again.
KEPT_WORDS = 400_000
NONE = np.int64(1) << 40


class BatchedBPE:
    """The encoder of one vocabulary file (lines of base64 token and rank)."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.width = np.int64(max(ranks.values()) + 1)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * int(self.width) + right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.merged = np.array(merged, dtype=np.int64)[order]
        self.known: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.known.clear()
        self.flat, self.starts, self.counts, self.used = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, or NONE; a lower id is merged earlier."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all ``words`` in one array, and how many each has."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        symbol = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(n), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            pair = np.full(len(symbol), NONE)
            inner = np.flatnonzero(word[1:] == word[:-1])
            if len(inner):
                pair[inner] = self.rank(symbol[inner], symbol[inner + 1])
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[first, len(word)])
            best = np.minimum.reduceat(pair, first)
            open_ = np.repeat(best != NONE, length)
            done.append((word[~open_], symbol[~open_]))
            best = np.repeat(best, length)[open_]
            symbol, word, pair = symbol[open_], word[open_], pair[open_]
            hit = pair == best
            # of overlapping places (a a a) every other one is merged, from the left
            run_start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], np.arange(len(hit)), 0)) if len(hit) else hit
            hit &= (np.arange(len(hit)) - run_start) % 2 == 0
            symbol = np.where(hit, best, symbol)
            keep = np.r_[True, ~hit[:-1]] if len(hit) else hit
            symbol, word = symbol[keep], word[keep]
        word = np.concatenate([w for w, _ in done]) if done else np.empty(0, np.int64)
        symbol = np.concatenate([s for _, s in done]) if done else np.empty(0, np.int64)
        order = np.argsort(word, kind="stable")
        return symbol[order].astype(np.int32), np.bincount(word, minlength=n)

    def long_word(self, word: bytes) -> list[int]:
        """One long word, by a heap of its pairs: n log n steps."""
        ids = [int(self.byte_ids[b]) for b in word]
        nxt, prv = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        a = np.array(ids, dtype=np.int64)
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(self.rank(a[:-1], a[1:])) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = nxt[i] if ids[i] == left else len(ids)
            if j >= len(ids) or ids[j] != right:
                continue
            ids[i], ids[j], nxt[i] = r, -1, nxt[j]
            if nxt[j] < len(ids):
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < len(ids):
                    new = int(self.rank(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if new != NONE:
                        heapq.heappush(heap, (new, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def learn(self, words: list[str]) -> None:
        """Encodes words not yet known and keeps them."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        short = [i for i, w in enumerate(data) if len(w) <= LONG_WORD]
        flat, counts = self.rounds([data[i] for i in short])
        if len(short) < len(data):
            parts, at = dict(zip(short, np.split(flat, np.cumsum(counts)[:-1]))) if short else {}, []
            for i, w in enumerate(data):
                at.append(parts[i] if i in parts else np.array(self.long_word(w), np.int32))
            flat, counts = np.concatenate(at), np.fromiter(map(len, at), np.int64, len(at))
        first, end = len(self.known), self.used + len(flat)
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while first + len(words) > len(self.starts):
            self.starts, self.counts = np.concatenate([self.starts, self.starts]), np.concatenate([self.counts, self.counts])
        self.flat[self.used : end] = flat
        self.starts[first : first + len(words)] = self.used + np.cumsum(counts) - counts
        self.counts[first : first + len(words)] = counts
        self.used = end
        self.known.update(zip(words, range(first, first + len(words))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the place in it where each text begins (and the end)."""
        if len(self.known) > KEPT_WORDS:
            self._reset()
        split, words, ends = self.split, [], [0]
        for t in texts:
            if t:
                words += split(t)
            ends.append(len(words))
        new = set(words).difference(self.known)
        if new:
            self.learn(sorted(new))
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        counts = self.counts[index]
        stop = np.r_[0, np.cumsum(counts)]
        place = np.arange(stop[-1]) + np.repeat(self.starts[index] - stop[:-1], counts)
        return self.flat[place], stop[np.array(ends)]


_made: dict[tuple[str, str], BatchedBPE] = {}


def encoder(path: str, pattern: str = PATTERN) -> BatchedBPE:
    """This worker's encoder of the file."""
    if (path, pattern) not in _made:
        _made[path, pattern] = BatchedBPE(path, pattern)
    return _made[path, pattern]


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """One row ``(id_col, ids array<int>)`` for each row of ``df``; a null or empty text gives an empty list.

    Repeated ids stay repeated; strings that spell special tokens are ordinary text; other columns, whatever
    their names, are left out; an empty table gives an empty one. A map over the scan: nothing is shuffled
    where the scan has as many partitions as there are cores. ``path`` must exist on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            flat, ends = bpe.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], names=[id_col, "ids"])

    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return spread(src).mapInArrow(run, StructType([src.schema[id_col], StructField("ids", ArrayType(IntegerType()))]))
