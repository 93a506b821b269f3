"""Reading level of documents: a linear pairwise ranker of graded documents, calibrated by isotonic regression.

Features of a sentence are its syntax (length, word lengths, clause marks, numbers, names, quotes) and its vocabulary (words
and pairs of words that several graded documents have). A document's features are the means over its sentences, by words,
so one weight vector scores documents and sentences alike. The ranker is trained on all pairs of graded documents of
different levels; isotonic regression of the graded documents' sentences turns scores into levels. A document is of the
level on which most of its words stand, so a passage of another level doesn't move it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.words import sentences
from trendloom.llm.words import words as words_of
from trendloom.session import spread

#: Graded documents that the ranker is trained on: all up to this bound, then those of the smallest hashes of their ids.
MOST_GRADED = 2_000
#: Graded documents that must have a word or pair; passes of the optimiser; penalty; rounds of leaving out foreign sentences.
LEAST_DOCUMENTS, STEPS, PENALTY, REFINED = 3, 120, 1e-3, 2
#: Documents or sentences whose pairs make one step's gradient; if there are more, the steps take them in turn.
BATCH = 1_000
LEVELS = (1, 2, 3, 4)
LEAST_WORDS = 40

#: Words that string whole sentences together: what stands between them is taken by itself, so that length alone says little.
_STRUNG = re.compile(r"\s+(?:rồi|thế là|sau đó|and then|and so|but then)\s+")
#: Weight of the syntax beside the vocabulary.
SYNTAX = 0.3
#: Power of its words by which a sentence's vocabulary is divided.
NORM = 0.5

#: Marks counted for the syntax; figures, too.
_MARKS = (",", ";:—–", "0123456789", "\"“”«»", "?", "!", "()")
#: UTF-8 read as a one-byte encoding: a lead byte as a capital letter or so, with what its followers become.
_FOLLOWER = "[\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
MANGLED = f"[Â-ß]{_FOLLOWER}|[à-ï]{_FOLLOWER}{{2}}|[ð-ô]{_FOLLOWER}{{3}}"


def undamaged(text: Column) -> Column:
    """Whether a text has no replacement or control character and isn't read in a wrong encoding."""
    return ~text.rlike(r"[�\x00-\x08\x0e-\x1f]") & ~text.rlike(f"(?s)(?:{MANGLED}).*?(?:{MANGLED})")


def n_words(text: Column) -> Column:
    """The parts between blanks."""
    return F.size(F.filter(F.split(text, r"[\s\p{Z}]+"), lambda w: w != ""))


def clauses(text: str | None) -> list[tuple[str, list[str]]]:
    """The sentences of a text, strung ones apart, with their words."""
    return [(c, ws) for s in sentences(text) for c in _STRUNG.split(s) for ws in (words_of(c),) if ws]


def _syntax(sentence: str, ws: list[str]) -> list[float]:
    size = [len(w) for w in ws if w != "0" and w != "<n>"] or [0]
    n, names = len(ws), ws.count("<n>")
    count = sentence.count
    return [SYNTAX * x for x in (n / 20, min(n, 60) ** 0.5 / 4, sum(size) / len(size) / 5, len([s for s in size if s > 6]) / len(size), names / n, *[min(3, sum(map(count, m))) / 3 for m in _MARKS])]


Clause = tuple[str, list[str]]


class _Rows:
    """Rows of features: the dense syntax, and the vocabulary as places and values, row by row."""

    def __init__(self, docs: list[list[Clause]], vocabulary: dict):
        self.syntax = np.zeros((len(docs), 5 + len(_MARKS)))
        cols, values, self.count = [], [], np.zeros(len(docs), np.int64)
        for n, d in enumerate(docs):
            total = sum(len(ws) for _, ws in d)
            for s, ws in d:
                share = len(ws) / total
                self.syntax[n] += np.array(_syntax(s, ws)) * share
                own = [k for g in grams(ws) if (k := vocabulary.get(g)) is not None]
                cols += own
                values += [share / len(ws) ** NORM] * len(own)
                self.count[n] += len(own)
        self.cols, self.values = np.array(cols, np.int64), np.array(values)
        self.first = np.cumsum(self.count) - self.count

    def gradient(self, own: np.ndarray, level: np.ndarray, w: np.ndarray) -> np.ndarray | None:
        """The gradient of the mean logistic loss over all pairs of the rows ``own``."""
        n_syntax, count = self.syntax.shape[1], self.count[own]
        at = np.repeat(self.first[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        cols, values, row = self.cols[at], self.values[at], np.repeat(np.arange(len(own)), count)
        s = self.syntax[own] @ w[:n_syntax] + np.bincount(row, values * w[n_syntax + cols], len(own))
        higher = level[own][:, None] > level[own][None, :]
        if not higher.any():
            return None
        p = higher / (1 + np.exp(np.clip(s[:, None] - s[None, :], -30, 30).astype(np.float32)))
        g = (p.sum(axis=1) - p.sum(axis=0)) / higher.sum()
        return -np.r_[self.syntax[own].T @ g, np.bincount(cols, values * g[row], len(w) - n_syntax)]


def grams(ws: list[str]) -> list:
    """The words, and the pairs of words that follow each other."""
    return [*ws, *zip(["<s>", *ws], ws)]


class ReadingLevels:
    """The ranker's weights and the cuts between levels."""

    def __init__(self, graded: list[tuple[str, int]]):
        docs = [clauses(t) for t, _ in graded]
        keep = [n for n, d in enumerate(docs) if d]
        docs, level = [docs[n] for n in keep], np.array([graded[n][1] for n in keep])
        have = Counter(g for d in docs for g in {g for _, ws in d for g in grams(ws)})
        least = max(LEAST_DOCUMENTS, len(docs) // 200)
        self.vocabulary = {g: k for k, g in enumerate(sorted((g for g, n in have.items() if n >= least), key=lambda g: g if isinstance(g, tuple) else (g,)))}
        self.words: dict[str, float] = {}
        self.pairs: dict[tuple[str, str], float] = {}
        self.cuts = np.array([-1.0, 0.0, 1.0])
        self.syntax = [0.0] * (5 + len(_MARKS))
        if len(set(level.tolist())) < 2:
            self.cuts = np.array([np.inf if level.size == 0 or l > level[0] else -np.inf for l in LEVELS[1:]])
            return
        kept = [[True] * len(d) for d in docs]
        for round_ in range(REFINED + 1):
            if round_:  # pairs of sentences that stand for their documents' grades
                own = [(l, x) for l, d, ks in zip(level.tolist(), docs, kept) for x, k in zip(d, ks) if k]
                self._rank([[x] for _, x in own], np.array([l for l, _ in own]))
            else:
                self._rank(docs, level)
            scores = [np.array([self.score(s, ws) for s, ws in d]) for d in docs]
            size = [np.array([len(ws) for _, ws in d]) for d in docs]
            self._calibrate(scores, size, level, kept)
            if round_ < REFINED:  # passages of another level than the document's grade don't teach its level
                own = [abs(1 + np.searchsorted(self.cuts, s, "right") - l) < REFINED - round_ for s, l in zip(scores, level)]
                kept = [o.tolist() if o.any() else k for o, k in zip(own, kept)]

    def _rank(self, docs: list[list[Clause]], level: np.ndarray) -> None:
        rows, n_syntax = _Rows(docs, self.vocabulary), len(self.syntax)
        order = np.random.default_rng(13).permutation(len(docs))
        parts = np.array_split(order, -(-len(docs) // BATCH))
        w = np.zeros(n_syntax + len(self.vocabulary))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, max(STEPS, 3 * len(parts)) + 1):  # Adam; every row takes part
            g = rows.gradient(parts[step % len(parts)], level, w)
            if g is None:
                continue
            g += PENALTY * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.syntax = w[:n_syntax].tolist()
        self.words = {g: float(w[n_syntax + k]) for g, k in self.vocabulary.items() if isinstance(g, str)}
        self.pairs = {g: float(w[n_syntax + k]) for g, k in self.vocabulary.items() if isinstance(g, tuple)}

    def score(self, sentence: str, ws: list[str]) -> float:
        syntax = sum(map(mul, self.syntax, _syntax(sentence, ws)))
        return syntax + (sum(map(self.words.get, ws, repeat(0.0))) + sum(map(self.pairs.get, zip(["<s>", *ws], ws), repeat(0.0)))) / len(ws) ** NORM

    def _calibrate(self, scores: list[np.ndarray], size: list[np.ndarray], level: np.ndarray, kept: list[list[bool]]) -> None:
        keep = np.concatenate([np.array(k) for k in kept])
        s, w = np.concatenate(scores)[keep], np.concatenate(size)[keep].astype(float)
        y = np.repeat(level, [len(a) for a in scores])[keep]
        order = np.argsort(s, kind="stable")
        s, w, y = s[order], w[order], y[order]
        share = {l: w[y == l].sum() for l in LEVELS}
        w = w / np.array([max(share[l], 1e-9) for l in y])  # levels count alike, however many were graded
        cuts = []
        for l in LEVELS[1:]:
            near = (y == l) | (y == l - 1)  # where neighbours meet
            if not near.any() or not (y[near] == l).any():
                cuts.append(np.inf)
                continue
            fit = isotonic((y[near] >= l).astype(float), w[near])
            above = np.flatnonzero(fit >= 0.5)
            at = s[near]
            k = int(above[0]) if len(above) else len(at) - 1
            cuts.append((at[k] + at[k - 1]) / 2 if k else -np.inf)
        self.cuts = np.maximum.accumulate(np.array(cuts))

    def level(self, text: str | None) -> int | None:
        """The level of most of a text's words; of equal shares the lower one; None without words."""
        n = np.zeros(len(LEVELS))
        for s, ws in clauses(text):
            n[int(np.searchsorted(self.cuts, self.score(s, ws), "right"))] += 1 + len(ws) / 1000
        return LEVELS[int(n.argmax())] if n.any() else None


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``y`` by squares weighted with ``w`` (pool adjacent violators)."""
    value, weight, count = [], [], []
    for a, b in zip(y.tolist(), w.tolist()):
        value.append(a)
        weight.append(b)
        count.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            b2, a2, c2 = weight.pop(), value.pop(), count.pop()
            total = weight[-1] + b2
            value[-1] = (value[-1] * weight[-1] + a2 * b2) / total if total else a2
            weight[-1] = total
            count[-1] += c2
    return np.repeat(value, count)


def fit(docs: DataFrame, grades: DataFrame, doc_id: str, text: str) -> ReadingLevels:
    own = grades.where(F.col("level").isin(*LEVELS)).groupBy(F.col(doc_id).alias("__id")).agg(F.max("level").alias("level"))
    own = own.orderBy(F.xxhash64("__id"), "__id").limit(MOST_GRADED)
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    rows = own.join(texts, "__id").orderBy(F.xxhash64("__id"), "__id", "t").select("t", "level").collect()
    return ReadingLevels([(r["t"], int(r["level"])) for r in rows])


def reading_levels(docs: DataFrame, grades: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, level``: every document of at least ``least_words`` parts between blanks, with undamaged characters.

    Defined cases: null, empty, short and damaged texts have no level, nor have texts without a word; whole texts are
    read; a document graded twice counts with its higher grade; a hand grade trains but is not copied to the result; without
    grades of two levels every document gets the one level there is (1 without any); repeated rows repeat their rows;
    other columns are not looked at. The corpus is mapped; the model is bounded by the graded documents.
    """
    model = fit(docs, grades, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            out = b[["doc_id"]].assign(level=[m.level(t) for t in b["t"]])
            yield out[out["level"].notna()].astype({"level": "int32"})

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    src = spread(src.where(F.col("t").isNotNull() & (n_words(F.col("t")) >= least_words) & undamaged(F.col("t"))))
    return src.mapInPandas(run, "doc_id long, level int")
