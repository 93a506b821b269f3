"""Matching posts to trends: by name, by keyword, by vector, and by fused ranks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from trendloom.functions import vectors
from trendloom.functions.text import tokens
from trendloom.session import materialise

#: Trends (or centroids) that a worker holds at once, and terms of one automaton; more are taken in blocks, one after the other.
BLOCK_TRENDS, BLOCK_TERMS = 65_536, 200_000
#: Products of posts and trends that a worker holds at once.
PRODUCTS = 2_000_000
#: Pairs of a post and a term that a worker holds before it passes them on, and posts whose terms are one row of bits.
PAIRS, POSTS = 100_000, 1024


def usable(v: Column, size: int) -> Column:
    """Whether a vector has ``size`` numbers, none null, NaN or infinite and not all zero."""
    return F.coalesce((F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def centroids(df: DataFrame, label: str, vector: str, size: int) -> DataFrame:
    """``label, centroid, n``: the mean vector of each label, summed map-side element by element."""
    return df.groupBy(label).agg(vectors.mean_vector(F.col(vector), size).alias("centroid"), F.count("*").alias("n"))


def _split(df: DataFrame, key: str, most: int) -> Iterator[tuple[DataFrame, Callable[[DataFrame], DataFrame]]]:
    """``df`` in blocks of about ``most`` rows at most, by a hash of ``key``, each with what takes the rows of its keys from
    another table with that column; few rows are one block and read once."""
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows <= most:
        yield rows, lambda other: other
        return
    del rows
    df = materialise(df)
    n = math.ceil(df.count() / most)
    for k in range(n):
        own = F.pmod(F.xxhash64(key), F.lit(n)) == k
        yield df.where(own).toArrow(), lambda other, own=own: other.where(own)


def _blocks(df: DataFrame, key: str, most: int) -> Iterator[list[dict]]:
    return (rows.to_pylist() for rows, _ in _split(df, key, most))


def _matrix(rows: Sequence) -> np.ndarray:
    return np.stack([np.asarray(r, float) for r in rows])


def _units(rows: Sequence) -> np.ndarray:
    x = _matrix(rows)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)


def over_blocks(posts: DataFrame, trends: DataFrame, vector: str, trend_id: str, trend_vector: str, make: Callable, schema: StructType, products: bool = False, owners: DataFrame | None = None, key: str = "") -> tuple[DataFrame, int]:
    """``make(batch, cosines, ids)`` over all posts for each block of trends, whose ids are sorted; posts of an odd length are left
    out. With ``products`` the plain products of the vectors are given instead of their cosines. With ``owners`` (``key, trend_id``)
    ``make`` also gets the places of the ids of each key, and cosines that aren't rounded. Also the number of blocks."""
    spark = posts.sparkSession
    out, n = None, 0
    for block, within in _split(trends.where(F.col(trend_vector).isNotNull()).select(trend_id, trend_vector), trend_id, BLOCK_TRENDS):
        if not block.num_rows:
            continue
        n += 1
        shape = _matrix if products else _units
        ids = block.column(0).to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        ids = [ids[k] for k in order]
        places = None
        if owners is not None:
            at, places = {t: k for k, t in enumerate(ids)}, {}
            for of, t in zip(*(c.to_pylist() for c in within(owners.select(key, trend_id)).toArrow().columns)):
                if t in at:
                    places.setdefault(of, []).append(at[t])
            places = {of: np.unique(np.array(p, np.int32)) for of, p in places.items()}
        shared = spark.sparkContext.broadcast((ids, shape(block.column(1).to_numpy())[order], places))

        def run(batches: Iterator[pd.DataFrame], shared=shared, shape=shape) -> Iterator[pd.DataFrame]:
            ids, c, places = shared.value
            step = max(1, min(512, PRODUCTS // len(ids)))
            for b in batches:
                b = b[[v is not None and len(v) == c.shape[1] for v in b[vector]]]
                for at in range(0, len(b), step):
                    part = b.iloc[at : at + step]
                    s = shape(part[vector].to_list()) @ c.T
                    yield make(part, np.round(s, 9), ids) if places is None else make(part, s, ids, places)

        one = posts.mapInPandas(run, schema)
        out = one if out is None else out.unionByName(one)
    return (out if out is not None else spark.createDataFrame([], schema)), n


def top_matches(posts: DataFrame, trends: DataFrame, post_id: str, vector: str, trend_id: str, trend_vector: str, floor: float | None = None, k: int = 1) -> DataFrame:
    """``post_id, trend_id, sim, rank``: the k most similar trends of each post, with ``sim >= floor`` if given.

    An Arrow batch of posts is multiplied with a block of trends at once; nothing is shuffled unless there are several blocks, whose
    best then meet. Of equal similarities the smaller id comes first; posts without a vector have no match.
    """
    ids = StructType([StructField(post_id, posts.schema[post_id].dataType), StructField(trend_id, trends.schema[trend_id].dataType), StructField("sim", DoubleType()), StructField("rank", IntegerType())])

    def best(part: pd.DataFrame, s: np.ndarray, known: list) -> pd.DataFrame:
        top = s.argmax(axis=1)[:, None] if k == 1 else np.argsort(-s, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({post_id: np.repeat(part[post_id].to_numpy(), top.shape[1]), trend_id: [known[t] for t in top.ravel()], "sim": np.take_along_axis(s, top, axis=1).ravel(), "rank": np.tile(np.arange(1, top.shape[1] + 1, dtype=np.int32), len(top))})

    out, blocks = over_blocks(posts.select(post_id, vector), trends, vector, trend_id, trend_vector, best, ids)
    if blocks > 1:
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(post_id).orderBy(F.desc("sim"), trend_id))).where(F.col("rank") <= k)
    return out if floor is None else out.where(F.col("sim") >= floor)


def keyword_matches(posts: DataFrame, terms: DataFrame, post_id: str, text: str, term_id: str, term: str) -> DataFrame:
    """``post_id, term_id``: posts whose lower-case text contains a term, inside a word or across words.

    All terms are one automaton (a block of ``BLOCK_TERMS``), which every text runs through once: the work grows with the texts and
    not with the product of texts and terms.
    """
    out = _found(posts, terms, post_id, text, term_id, term)
    return out.distinct() if out is not None else posts.sparkSession.createDataFrame([], _pair(posts, post_id, terms, term_id))


def _pair(a: DataFrame, a_id: str, b: DataFrame, b_id: str) -> StructType:
    return StructType([StructField(a_id, a.schema[a_id].dataType), StructField(b_id, b.schema[b_id].dataType)])


def _found(posts: DataFrame, terms: DataFrame, post_id: str, text: str, term_id: str, term: str) -> DataFrame | None:
    """As ``keyword_matches``, but a pair may come again; None without terms."""
    spark = posts.sparkSession
    schema = _pair(posts, post_id, terms, term_id)
    named = terms.select(F.col(term_id), F.lower(F.trim(term)).alias("__term")).where("__term <> ''").distinct()
    texts = posts.select(post_id, F.lower(text).alias("__text")).where("__text IS NOT NULL")
    out = None
    for block in _blocks(named, "__term", BLOCK_TERMS):
        of: dict[str, list] = {}
        for r in block:
            of.setdefault(r["__term"], []).append(r[term_id])
        if not of:
            continue
        shared = spark.sparkContext.broadcast(of)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for t, own in shared.value.items():
                automaton.add_word(t, own)
            automaton.make_automaton()
            for b in batches:
                pairs = []
                for p, x in zip(b[post_id], b["__text"]):
                    pairs += [(p, i) for i in {i for _, own in automaton.iter(x) for i in own}]
                    if len(pairs) >= PAIRS:
                        yield pd.DataFrame(pairs, columns=[post_id, term_id])
                        pairs = []
                yield pd.DataFrame(pairs, columns=[post_id, term_id])

        one = texts.mapInPandas(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def keyword_counts(posts: DataFrame, terms: DataFrame, post_id: str, text: str, term_id: str, term: str) -> DataFrame:
    """``term_id, n, nulls``: to how many ``post_id`` a text belongs that contains a term of ``term_id``, those that are null
    being counted as one in ``nulls``; only the ``term_id`` that have one.

    A post is a row with its terms. The ``term_id`` that they stand for are counted over bits, ``POSTS`` posts at once: as each
    new trend brings its keywords to as many posts as there are, pairs of a post and a ``term_id`` would grow with the product.
    """
    spark = posts.sparkSession
    named = terms.select(F.col(term_id), F.lower(F.trim(term)).alias("__term")).where("__term <> ''").distinct()
    kind = StructType([StructField(term_id, terms.schema[term_id].dataType), StructField("n", LongType()), StructField("nulls", LongType())])
    words = named.select("__term", F.col("__term").alias("__word")).distinct()
    found = _found(posts, words, post_id, text, "__word", "__term")
    if found is None:
        return spark.createDataFrame([], kind)
    own = found.groupBy(post_id).agg(F.collect_set("__word").alias("__words")).select(F.col(post_id).isNull().alias("__null"), "__words")
    blocks = _blocks(named, term_id, BLOCK_TERMS)
    first_two = list(islice(blocks, 2))
    own = materialise(own) if len(first_two) > 1 else own  # read for each block
    out = None
    for block in chain(first_two, blocks):
        ids: dict = {}
        numbers: dict[str, int] = {}
        pairs = sorted((ids.setdefault(r[term_id], len(ids)), numbers.setdefault(r["__term"], len(numbers))) for r in block)
        shared = spark.sparkContext.broadcast((list(ids), numbers, np.array(pairs, np.int64).reshape(-1, 2)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, numbers, pairs = shared.value
            n, nulls = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for b in batches:
                for at in range(0, len(b), POSTS):
                    part = b.iloc[at : at + POSTS]
                    seen = [(numbers[w], k) for k, ws in enumerate(part["__words"]) for w in ws if w in numbers]
                    if not seen:
                        continue
                    term_, post = np.array(seen).T
                    known, row = np.unique(term_, return_inverse=True)
                    bits = np.zeros((len(known), POSTS // 64), np.uint64)
                    np.bitwise_or.at(bits, (row, post >> 6), np.uint64(1) << (post & 63).astype(np.uint64))
                    place = np.full(len(numbers), -1)
                    place[known] = np.arange(len(known))
                    asked = pairs[place[pairs[:, 1]] >= 0]
                    first = np.flatnonzero(np.r_[True, asked[1:, 0] != asked[:-1, 0]])
                    any_ = np.bitwise_or.reduceat(bits[place[asked[:, 1]]], first, axis=0)
                    null = np.zeros(POSTS, bool)
                    null[: len(part)] = part["__null"]
                    null = np.packbits(null, bitorder="little").view(np.uint64)
                    n[asked[first, 0]] += np.bitwise_count(any_ & ~null).sum(axis=1, dtype=np.int64)
                    nulls[asked[first, 0]] += np.bitwise_count(any_ & null).sum(axis=1, dtype=np.int64)
            hit = np.flatnonzero(n + nulls)
            yield pd.DataFrame({term_id: pd.Series([ids[k] for k in hit], dtype=object), "n": n[hit], "nulls": nulls[hit]})

        one = own.mapInPandas(run, kind)
        out = one if out is None else out.unionByName(one)
    return out.groupBy(term_id).agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"))


def hybrid_matches(posts: DataFrame, trends: DataFrame, hits: DataFrame, post_id: str, vector: str, trend_id: str, trend_vector: str, floor: float = 0.65, k: int = 60, owners: DataFrame | None = None, key: str = "") -> DataFrame:
    """``post_id, trend_id, rrf, sim``: the trend of each post by the fused ranks of its cosine and of its keywords.

    ``hits`` has the pairs ``post_id, trend_id`` that share a keyword or, if ``owners`` has the pairs ``key, trend_id``, the pairs
    ``post_id, key`` of posts and keywords, which don't grow with the trends of a keyword. A trend's score is 1 / (k + its rank by
    cosine) + 1 / (k + its rank by keyword), where equal values share the better rank; the winner counts only if its cosine is at
    least ``floor``. Only the nearest trend with a keyword and the nearest one without can win, so that no pair of a post and a trend
    is ever a row. One block of trends is passed once, several twice: for the nearest, then for the ranks among all.
    """
    trends = materialise(trends.select(trend_id, trend_vector))  # read for each block, and in two passes
    if owners is None:
        key = trend_id
        pairs = trends.select(F.col(trend_id).alias("__key"), trend_id)
    else:
        pairs = materialise(owners.select(F.col(key).alias("__key"), trend_id))
    own = hits.groupBy(post_id).agg(F.collect_set(key).alias("__hits"))
    p = posts.where(F.col(vector).isNotNull()).select(post_id, vector).join(own, post_id, "left")
    named = trends.schema[trend_id].dataType
    kind = StructType([StructField(post_id, posts.schema[post_id].dataType), *[StructField(f"{c}{x}", named if x else DoubleType()) for c in ("hit", "non") for x in ("", "_id")], *[StructField(c, LongType()) for c in ("n_hits", "over_hit", "over_non")]])

    def nearest(part: pd.DataFrame, s: np.ndarray, known: list, places: dict) -> pd.DataFrame:
        m = np.zeros(s.shape, bool)
        for n, h in enumerate(part["__hits"]):
            for w in () if h is None else h:
                if w in places:
                    m[n, places[w]] = True
        flat = np.flatnonzero(m)
        row, at = np.divmod(flat, len(known))
        with_ = np.round(s.ravel()[flat], 9)
        s.ravel()[flat] = -9.0
        hit, hit_at = _first_best(row, at, with_, len(part))
        most = s.max(axis=1)
        close = np.flatnonzero(s >= (most - 2e-9)[:, None])  # those that may be equal when rounded
        close = close[s.ravel()[close] > -9]
        non, non_at = _first_best(close // len(known), close % len(known), np.round(s.ravel()[close], 9), len(part))
        out = {post_id: part[post_id].to_numpy()}
        for name, v, i in (("hit", hit, hit_at), ("non", non, non_at)):
            out[name], out[f"{name}_id"] = np.where(i >= 0, v, np.nan), pd.Series([known[t] if t >= 0 else None for t in i], dtype=object)
        # above the given best of all blocks, else of this one
        hit, non = (part[c].fillna(9.0).to_numpy(float) if c in part else np.where(i >= 0, v, 9.0) for c, v, i in (("hit", hit, hit_at), ("non", non, non_at)))
        count = lambda r: np.bincount(r, minlength=len(part))
        return pd.DataFrame(out | {"n_hits": count(row), "over_hit": np.count_nonzero(s > (hit + 5e-10)[:, None], axis=1), "over_non": count(row[with_ > non[row]])})

    x, blocks = over_blocks(p, trends, vector, trend_id, trend_vector, nearest, kind, owners=pairs, key="__key")
    if blocks > 1:
        far = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col(c)).alias("s"), F.col(f"{c}_id").alias("i")))).alias(c)
        best = x.groupBy(post_id).agg(far("hit"), far("non"), F.sum("n_hits").alias("n_hits"))
        best = materialise(best.select(post_id, (-F.col("hit.s")).alias("hit"), F.col("hit.i").alias("hit_id"), (-F.col("non.s")).alias("non"), F.col("non.i").alias("non_id"), "n_hits"))
        n = over_blocks(p.join(best.select(post_id, "hit", "non"), post_id), trends, vector, trend_id, trend_vector, nearest, kind, owners=pairs, key="__key")[0]
        x = best.join(n.groupBy(post_id).agg(F.sum("over_hit").alias("over_hit"), F.sum("over_non").alias("over_non")), post_id)
    one = F.struct((-(1.0 / (k + 1 + F.col("over_hit")) + 1.0 / (k + 1))).alias("r"), (-F.col("hit")).alias("s"), F.col("hit_id").alias("t"))
    two = F.struct((-(1.0 / (k + 1 + F.col("over_non")) + 1.0 / (k + 1 + F.col("n_hits")))).alias("r"), (-F.col("non")).alias("s"), F.col("non_id").alias("t"))
    won = x.select(post_id, F.least(F.when(F.col("hit").isNotNull(), one), F.when(F.col("non").isNotNull(), two)).alias("w"))
    return won.select(post_id, F.col("w.t").alias(trend_id), (-F.col("w.r")).alias("rrf"), (-F.col("w.s")).alias("sim")).where(F.col("sim") >= floor)


def _first_best(row: np.ndarray, at: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest value of each of ``n`` rows and the first place that has it (-1: none); rows and their places are in order."""
    best, place = np.full(n, -9.0), np.full(n, -1)
    np.maximum.at(best, row, value)
    top = np.flatnonzero(value == best[row])[::-1]
    place[row[top]] = at[top]  # the first of a row is written last
    return best, place


def merged_dictionary(rows: DataFrame, key: str, row_id: str, volume: str, keywords: str, least: int = 5) -> DataFrame:
    """``canonical, n_rows, volume, id, keywords``: rows under the shortest key of at least ``least`` characters that theirs contains (of
    equal length the first in order), else under their own; volumes added, keywords united, the smallest id."""
    keys = rows.select(F.col(key).alias("__key")).distinct()
    inside = keyword_matches(keys.select("__key", F.col("__key").alias("__text")), keys.where(F.length("__key") >= least).select(F.col("__key").alias("__part"), F.col("__key").alias("__term")), "__key", "__text", "__part", "__term")
    named = keys.join(inside, "__key", "left").withColumn("__part", F.coalesce("__part", "__key"))
    named = named.groupBy("__key").agg(F.min(F.struct(F.length("__part").alias("n"), F.col("__part").alias("k"))).alias("c")).select("__key", F.col("c.k").alias("canonical"))
    x = rows.join(named, F.col(key) == F.col("__key"))
    return x.groupBy("canonical").agg(F.count("*").alias("n_rows"), F.sum(volume).alias("volume"), F.min(row_id).alias("id"), F.array_distinct(F.flatten(F.collect_list(keywords))).alias("keywords"))


def reciprocal_ranks(scores: DataFrame, query: str, item: str, columns: Sequence[str], k: int = 60) -> DataFrame:
    """Adds ``rrf``: the sum over the score columns of 1 / (k + rank) within a query; equal scores rank by item."""
    total = F.lit(0.0)
    for c in columns:
        scores = scores.withColumn(f"__r_{c}", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(c), item)))
        total = total + 1.0 / (k + F.col(f"__r_{c}"))
    return scores.withColumn("rrf", total).drop(*[f"__r_{c}" for c in columns])


def fused_matches(clusters: DataFrame, trends: DataFrame, sparse: DataFrame, cluster_id: str, vector: str, trend_id: str, trend_vector: str, weight: float = 0.6, floor: float = 0.35) -> DataFrame:
    """``cluster_id, trend_id, fused, sim``: the trend of each cluster by ``weight`` of the cosine and the rest of BM25 (``sparse``:
    ``cluster_id, trend_id, bm25``), by the cluster's highest; only with a cosine of ``floor`` and at most 1.

    A trend without a word in common can only win by its cosine, so the nearest one joins those of ``sparse`` and no other pair is formed.
    """
    dense = top_matches(clusters, trends, cluster_id, vector, trend_id, trend_vector).select(cluster_id, trend_id)
    pairs = sparse.select(cluster_id, trend_id, "bm25").unionByName(dense.withColumn("bm25", F.lit(0.0))).groupBy(cluster_id, trend_id).agg(F.max("bm25").alias("bm25"))
    pairs = pairs.join(clusters.where(F.col(vector).isNotNull()).select(cluster_id, F.col(vector).alias("__a")), cluster_id).join(trends.where(F.col(trend_vector).isNotNull()).select(trend_id, F.col(trend_vector).alias("__b")), trend_id)
    x = pairs.select(cluster_id, trend_id, "bm25", F.round(vectors.cosine(F.col("__a"), F.col("__b")), 9).alias("sim"))
    top = sparse.groupBy(cluster_id).agg(F.max("bm25").alias("__most"))
    x = x.join(top, cluster_id, "left").where(F.col("sim") >= floor)
    score = F.round(F.least(F.lit(1.0), weight * F.col("sim") + (1 - weight) * F.when(F.col("__most") > 0, F.col("bm25") / F.col("__most")).otherwise(0.0)), 9)
    best = x.groupBy(cluster_id).agg(F.min(F.struct((-score).alias("f"), F.col(trend_id).alias("t"), "sim")).alias("w"))
    return best.select(cluster_id, F.col("w.t").alias(trend_id), (-F.col("w.f")).alias("fused"), "w.sim")


def linear_fusion(scores: DataFrame, query: str, dense: str, sparse: str, weight: float = 0.6) -> DataFrame:
    """Adds ``fused``: ``weight`` of the dense and the rest of the sparse score, the latter by the query's highest."""
    most = F.max(sparse).over(Window.partitionBy(query))
    return scores.withColumn("fused", weight * F.col(dense) + (1 - weight) * F.when(most > 0, F.col(sparse) / most).otherwise(0.0))


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, doc_words: str, query_id: str, query_words: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``query_id, doc_id, bm25`` for pairs that share a word; idf = ln(1 + (N - n + 0.5) / (n + 0.5)).

    Postings meet the queries' words only, so the shuffle carries the postings of asked words.
    """
    length = docs.select(doc_id, F.size(doc_words).alias("dl"), doc_words)
    total = length.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    asked = queries.select(query_id, F.explode(query_words).alias("w")).groupBy(query_id, "w").agg(F.count("*").alias("qtf"))
    postings = length.select(doc_id, "dl", F.explode(doc_words).alias("w")).join(asked.select("w").distinct(), "w", "left_semi").groupBy("w", doc_id, "dl").agg(F.count("*").alias("tf"))
    df = postings.groupBy("w").agg(F.count("*").alias("n"))
    p = postings.join(df, "w").crossJoin(F.broadcast(total))  # one row of totals
    weight = F.log(1 + (F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return p.select("w", doc_id, weight.alias("s")).join(asked, "w").groupBy(query_id, doc_id).agg(F.sum(F.col("s") * F.col("qtf")).alias("bm25"))


def tf_idf(words: DataFrame, doc_id: str, word: str, least_docs: int = 2, most_share: float = 0.95, most_terms: int | None = None) -> DataFrame:
    """``doc_id, w, weight``: unit-length weights tf * (ln((1 + N) / (1 + df)) + 1) of words in enough and not too many documents,
    and of the ``most_terms`` most frequent ones if given.

    ``words`` has one row for each occurrence, so that no document is ever one row.
    """
    tf = words.groupBy(doc_id, F.col(word).alias("w")).agg(F.count("*").alias("tf"))
    total = words.agg(F.countDistinct(doc_id).alias("N"))
    df = tf.groupBy("w").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).where((F.col("df") >= least_docs) & (F.col("df") <= F.col("N") * most_share))
    if most_terms is not None:
        frequent = tf.join(df.select("w"), "w").groupBy("w").agg(F.sum("tf").alias("__n")).orderBy(F.desc("__n"), "w").limit(most_terms)
        df = df.join(frequent.select("w"), "w", "left_semi")
    raw = tf.join(df, "w").select(doc_id, "w", (F.col("tf") * (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1)).alias("x"))
    length = raw.groupBy(doc_id).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    return raw.join(length, doc_id).select(doc_id, "w", (F.col("x") / F.col("len")).alias("weight"))
