"""Subjects of documents by subject-specific interpolated n-gram language models.

A model of words and pairs is trained for each subject on hand-labelled documents: a word's probability is interpolated of
what the subject's documents have after the word before it, of what they have at all, and of the model of the whole corpus;
sentences of documents with several labels go to the label whose model fits best. The cross-entropy of each token of a
sentence is compared with that of a background model, the corpus's own or the balanced mixture of the subjects'; a sentence's
subject is the one whose model saves most bits on its tokens, if they save a margin. Which weights, which background and which
margin is calibrated on labelled documents that the models have not seen, a fold and a mixture to a task.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm.words import sentences, words
from trendloom.session import spread

#: (weight of pairs, tokens that the corpus lends to a subject's words, tokens that the subject's words lend to its pairs) tried.
MIXTURES = ((0.1, 2000.0, 2000.0), (0.5, 1000.0, 2000.0))
BACKGROUNDS = ("balanced", "corpus")
#: Tokens that the corpus's words lend to its pairs; what is taken off each count of a subject's model.
LENT_PAIRS, DISCOUNT = 2000.0, 0.5
#: Labelled documents that the models are trained on: all up to this bound, then those of the smallest hashes of their ids.
MOST_LABELLED = 20_000
#: Margins tried: bits that a subject's model must save on a sentence, its cross-entropies summed over the tokens.
LEAST_MARGIN, MOST_MARGIN = 1.0, 25.0
#: Several sentences on a subject are enough, too, if they save so many margins together; sentences below LEAST_BITS don't count.
TOGETHER, LEAST_BITS = (1.25, 1.5, 2.0, 9.0), 2.0
FOLDS = 4
KEPT = 500_000
START = "<s>"

Mixture = tuple[float, float, float]


class Background:
    """The model of the whole corpus: counts of words and pairs, as far as the labelled documents have them."""

    def __init__(self, counts: dict[str, int], total: int):
        self.counts, self.total = counts, max(1, total)

    def word(self, w: str) -> float:
        return (self.counts.get(w, 0) + 0.5) / (self.total + 1)

    def pair(self, v: str, w: str) -> float:
        return (self.counts.get(f"{v} {w}", 0) + LENT_PAIRS * self.word(w)) / (self.counts.get(v, 0) + LENT_PAIRS)


class SubjectModels:
    """The models of all subjects, and what each word in its context says for each of them."""

    def __init__(self, labelled: list[tuple[list[list[str]], list[str]]], background: Background, mixture: Mixture, held_to: str = BACKGROUNDS[0]):
        self.subjects = sorted({s for _, ls in labelled for s in ls})
        self.place = {s: k for k, s in enumerate(self.subjects)}
        self.background, self.mixture, self.held_to = background, mixture, held_to
        self.margin, self.together = 10.0, TOGETHER[-1]
        one = [(ws, ls[0]) for ss, ls in labelled if len(ls) == 1 for ws in ss]
        self._train(one)
        several = [(ws, ls) for ss, ls in labelled if len(ls) > 1 for ws in ss]
        if several:  # each sentence to the label that fits best, by the models of the single labels
            fits = [(ws, max(ls, key=lambda s: g[self.place[s]])) for ws, ls in several for g in (self.gains(ws),)]
            self._train(one + fits)

    def _train(self, rows: list[tuple[list[str], str]]) -> None:
        counts: defaultdict[tuple[str, ...], np.ndarray] = defaultdict(lambda: np.zeros(len(self.subjects)))
        for ws, s in rows:
            k = self.place[s]
            for v, w in zip([START, *ws], ws):
                for g in ((), (w,), ("", v), (v, w)):
                    counts[g][k] += 1
        self.counts = dict(counts)
        self.none = np.zeros(len(self.subjects))
        self._cache: dict[tuple[str, str], int] = {}
        self._rows: list[np.ndarray] = []

    def _gain(self, v: str, w: str) -> np.ndarray:
        """Bits that each subject's model saves over the background on the token ``w`` after ``v``.

        The balanced background is the mean of the subjects' models, which a hot subject can't dominate.
        """
        get, none, (pairs, lent, lent_pairs) = self.counts.get, self.none, self.mixture
        words = (np.maximum(get((w,), none) - DISCOUNT, 0) + lent * self.background.word(w)) / (get((), none) + lent)
        after = (np.maximum(get((v, w), none) - DISCOUNT, 0) + lent_pairs * words) / (get(("", v), none) + lent_pairs)
        p = (1 - pairs) * words + pairs * after
        base = p.mean() if self.held_to == "balanced" else (1 - pairs) * self.background.word(w) + pairs * self.background.pair(v, w)
        return np.log2(p / base)

    def gains(self, ws: list[str]) -> np.ndarray:
        """Bits that each subject's model saves over the background on a sentence."""
        if len(self._rows) > KEPT:
            self._cache.clear()
            self._rows.clear()
        total = self.none.copy()
        for key in zip([START, *ws], ws):
            at = self._cache.get(key)
            if at is None:
                at = self._cache[key] = len(self._rows)
                self._rows.append(self._gain(*key))
            total += self._rows[at]
        return total

    def evidence(self, parts: list[list[str]]) -> list[tuple[int, float, int]]:
        """(subject, bits saved, words) of each sentence of a text, by its best subject."""
        out = []
        for ws in parts:
            if self.subjects:
                g = self.gains(ws)
                k = int(g.argmax())
                out.append((k, float(g[k]), len(ws)))
        return out

    def reach(self, evidence: list[tuple[int, float, int]], together: float) -> dict[int, float]:
        """The margin up to which each subject is accepted: by one sentence, or by several together."""
        most, bits = defaultdict(float), Counter()
        for k, gain, _ in evidence:
            most[k] = max(most[k], gain)
            if gain >= LEAST_BITS:
                bits[k] += gain
        return {k: max(m, bits[k] / together) for k, m in most.items()}

    def accept(self, evidence: list[tuple[int, float, int]]) -> dict[str, int]:
        """The subjects that a document's sentences speak of, with the words spent on each."""
        size, least = Counter(), min(LEAST_BITS, self.margin)
        for k, gain, n in evidence:
            if gain >= least:
                size[k] += n
        return {self.subjects[k]: size[k] for k, m in sorted(self.reach(evidence, self.together).items()) if m >= self.margin}


def tokens(text: str | None) -> list[list[str]]:
    return [ws for s in sentences(text) if (ws := words(s))]


def calibrated(spark: SparkSession, rows: list[tuple[list[list[str]], list[str]]], background: Background) -> SubjectModels:
    """Models of all labelled documents, with the mixture, background and margin that do best on held-out folds."""
    if len(rows) < 2 * FOLDS:
        return SubjectModels(rows, background, MIXTURES[0])
    shared = spark.sparkContext.broadcast((rows, background))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f, m in zip(b["fold"], b["mixture"]):
                rows, background = shared.value
                for held_to in BACKGROUNDS:
                    part = SubjectModels([r for n, r in enumerate(rows) if n % FOLDS != f], background, MIXTURES[m], held_to)
                    out = []
                    for parts, ls in rows[f::FOLDS]:
                        e = part.evidence(parts)
                        out += [(m, held_to, x, t, part.subjects[k] in ls) for x in TOGETHER for k, t in part.reach(e, x).items()]
                    yield pd.DataFrame(out, columns=["mixture", "held_to", "together", "reach", "hit"])

    tasks = spark.createDataFrame([(f, m) for f in range(FOLDS) for m in range(len(MIXTURES))], "fold int, mixture int").repartition(FOLDS * len(MIXTURES), "fold", "mixture")
    tried = tasks.mapInPandas(run, "mixture int, held_to string, together double, reach double, hit boolean").toPandas()  # a row for each labelled document and subject at most
    choices = []
    for key, t in tried.groupby(["mixture", "held_to", "together"]):
        t = t.sort_values("reach", ascending=False)
        reach = t["reach"].to_numpy()
        score = np.cumsum(np.where(t["hit"], 1, -1))  # a case found counts as much as a false one
        some = np.flatnonzero((reach >= LEAST_MARGIN) & (reach <= MOST_MARGIN))
        if len(some):
            top = score[some].max()
            plateau = reach[some][score[some] >= top - 0.005 * len(rows)]
            choices.append((int(top), -BACKGROUNDS.index(key[1]), key[2], -key[0], float(np.median(plateau))))
    if not choices:
        return SubjectModels(rows, background, MIXTURES[0])
    _, held_to, together, mixture, margin = max(choices)
    models = SubjectModels(rows, background, MIXTURES[-mixture], BACKGROUNDS[-held_to])
    models.margin, models.together = margin, together
    return models


def corpus_counts(docs: DataFrame, text: str, vocabulary: set[str]) -> Background:
    """Counts over all documents of the words and pairs in ``vocabulary``; only those reach the driver."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, n = shared.value, Counter()
        for b in batches:
            for t in b["t"]:
                for s in dict.fromkeys(sentences(t)):  # a sentence repeated within a document counts once
                    ws = words(s)
                    n[""] += len(ws)
                    n.update(w for w in ws if w in known)
                    n.update(p for p in map(" ".join, zip([START, *ws], ws)) if p in known)
                    n[START] += 1
        yield pd.DataFrame({"g": list(n), "n": list(n.values())}, columns=["g", "n"]).astype({"g": str, "n": "int64"})

    src = spread(docs.select(F.col(text).cast("string").alias("t")).where("t IS NOT NULL"))
    rows = src.mapInPandas(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
    counts = {r["g"]: r["n"] for r in rows}
    return Background(counts, counts.pop("", 0))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label_id: str, subject: str) -> SubjectModels:
    """Models from the hand labels (at most ``MOST_LABELLED`` documents) and the background of all ``docs``."""
    own = labels.where(F.col(subject).isNotNull()).groupBy(F.col(label_id).alias("__id")).agg(F.array_sort(F.collect_set(subject)).alias("ls"))
    own = own.orderBy(F.xxhash64("__id"), "__id").limit(MOST_LABELLED)
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    rows = own.join(texts, "__id").orderBy(F.xxhash64("__id"), "__id", "t").select("t", "ls").collect()
    labelled = [(tokens(r["t"]), list(r["ls"])) for r in rows]
    vocabulary: set[str] = set()
    for parts, _ in labelled:
        for ws in parts:
            vocabulary.update(ws)
            vocabulary.update(map(" ".join, zip([START, *ws], ws)))
    return calibrated(docs.sparkSession, labelled, corpus_counts(docs, text, vocabulary))


def assign_subjects(docs: DataFrame, labels: DataFrame, doc_id: str = "id", text: str = "content", label_id: str = "post_id", subject: str = "subject") -> DataFrame:
    """``id, subject, n_words``: one row for each subject that a document spends a sentence or more on.

    Defined cases: null, empty and wordless texts have no subject; whole texts are read; without labels there are no
    subjects; a label of a missing document is left out; repeated rows repeat their rows; a hand label trains but is not
    copied to the result; other columns are not looked at. The corpus is mapped; the models go to every worker and are
    bounded by the labelled documents.
    """
    models = fit(docs, labels, doc_id, text, label_id, subject)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            out = []
            for i, t in zip(b["id"], b["t"]):
                out += [(i, s, n) for s, n in m.accept(m.evidence(tokens(t))).items()]
            yield pd.DataFrame(out, columns=["id", "subject", "n_words"])

    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    return spread(src).mapInPandas(run, "id long, subject string, n_words long")
