"""Matching, retrieval and agreement queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import vectors
from trendloom.functions.text import fold, keyword_list, tokens, topic_of
from trendloom.operators import agreement, matching
from trendloom.session import table

SIZE = 64


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e, matching.centroids(e, "label", "embedding", SIZE)


def match_best(spark: SparkSession, d: str) -> DataFrame:
    """The nearest label centroid of every vector, without a floor."""
    e, c = _vectors(spark, d)
    return matching.top_matches(e.withColumnRenamed("label", "own"), c, "vec_id", "embedding", "label", "centroid").select("vec_id", "label", F.round("sim", 6).alias("sim"))


def match_floor(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose nearest centroid is similar enough, counted by label."""
    e, c = _vectors(spark, d)
    m = matching.top_matches(e.withColumnRenamed("label", "own"), c, "vec_id", "embedding", "label", "centroid", floor=0.2)
    return m.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("sim"), 6).alias("mean_sim"))


def match_names(spark: SparkSession, d: str) -> DataFrame:
    """Messages whose topic names a known trend, by the trend's smallest id."""
    posts = table(spark, d, "posts_stream_v1").select("msg_id", topic_of(F.col("final_topic")).alias("name")).where("name IS NOT NULL")
    trends = table(spark, d, "detected_trends").select(topic_of(F.col("trend_name")).alias("name"), "id").where("name IS NOT NULL").groupBy("name").agg(F.min("id").alias("trend_id"))
    return posts.join(trends, "name").select("msg_id", "trend_id")


def unmatched_names(spark: SparkSession, d: str) -> DataFrame:
    """Topics of messages that no trend has, with how many messages."""
    posts = table(spark, d, "posts_stream_v1").select(topic_of(F.col("final_topic")).alias("name")).where("name IS NOT NULL")
    trends = table(spark, d, "detected_trends").select(topic_of(F.col("trend_name")).alias("name"))
    return posts.join(trends, "name", "left_anti").groupBy("name").agg(F.count("*").alias("n"))


def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    """Articles that contain a keyword of a trend, per trend."""
    a = table(spark, d, "news_articles").select("url", F.concat_ws(" ", "title", "content").alias("text"))
    k = table(spark, d, "detected_trends").select("id", F.explode(keyword_list(F.col("keywords"))).alias("k"))
    return matching.keyword_counts(a, k, "url", "text", "id", "k").select("id", F.col("n").alias("n_articles"))


def bm25_articles(spark: SparkSession, d: str) -> DataFrame:
    """The three articles that fit each search trend best."""
    a = table(spark, d, "news_articles").groupBy("url").agg(F.min(F.concat_ws(" ", "title", "short_description")).alias("x")).select("url", tokens(F.col("x")).alias("words"))
    q = table(spark, d, "google_trends").select("row_id", tokens(F.concat_ws(" ", F.col("trend"), F.array_join(keyword_list(F.col("keywords")), " "))).alias("asked"))
    s = matching.bm25(a, q, "url", "words", "row_id", "asked").withColumn("bm25", F.round("bm25", 6))
    return _first(s, "row_id", [F.desc("bm25"), "url"], 3).select("row_id", "url", "bm25")


def _first(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


POST_SIZE = 96


def _topic_trends(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The posts with usable vectors, the topics' centroids, and the topics' keywords."""
    p = table(spark, d, "processed_posts").where(matching.usable(F.col("embedding"), POST_SIZE)).select("id", "content", "embedding", topic_of(F.col("final_topic")).alias("topic"))
    c = matching.centroids(p.where("topic IS NOT NULL"), "topic", "embedding", POST_SIZE)
    t = table(spark, d, "detected_trends").select(topic_of(F.col("trend_name")).alias("topic"), F.explode(keyword_list(F.col("keywords"))).alias("k")).where("topic IS NOT NULL AND length(k) >= 3")
    return p, c, t.join(c.select("topic"), "topic", "left_semi")


def rrf_match(spark: SparkSession, d: str) -> DataFrame:
    """The topic of each post by the fused ranks of its cosine with the topic's centroid and of the topic's keywords in the text."""
    p, c, k = _topic_trends(spark, d)
    words = k.select("topic", F.lower(F.trim("k")).alias("word")).distinct()
    hits = matching.keyword_matches(p, words.select("word", F.col("word").alias("k")), "id", "content", "word", "k")
    m = matching.hybrid_matches(p, c, hits, "id", "embedding", "topic", "centroid", owners=words, key="word")
    return m.select("id", "topic", F.round("rrf", 9).alias("rrf"), F.round("sim", 6).alias("sim"))


def linear_match(spark: SparkSession, d: str) -> DataFrame:
    """The trend of each topic by 0.6 of the cosine of their vectors and 0.4 of the BM25 of the topic's words in the trend's."""
    _, c, _ = _topic_trends(spark, d)
    t = table(spark, d, "detected_trends").select("id", "trend_name", "keywords", vectors.parsed(F.col("embedding")).alias("v")).where(matching.usable(F.col("v"), POST_SIZE))
    words = t.select("id", tokens(F.concat_ws(" ", F.col("trend_name"), F.array_join(keyword_list(F.col("keywords")), " "))).alias("words"))
    sparse = matching.bm25(words, c.select("topic", tokens(F.col("topic")).alias("asked")), "id", "words", "topic", "asked")
    m = matching.fused_matches(c, t, sparse, "topic", "centroid", "id", "v")
    return m.select("topic", "id", F.round("fused", 6).alias("fused"), F.round("sim", 6).alias("sim"))


def tfidf_topics(spark: SparkSession, d: str) -> DataFrame:
    """The five words that mark each source's headlines."""
    words = table(spark, d, "news_articles").select("source", F.explode(tokens(F.col("title"))).alias("word"))
    w = matching.tf_idf(words, "source", "word").withColumn("weight", F.round("weight", 6))
    return _first(w, "source", [F.desc("weight"), "w"], 5).select("source", "w", "weight")


def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How the nearest centroids agree with the labels."""
    e, c = _vectors(spark, d)
    m = matching.top_matches(e.withColumnRenamed("label", "own"), c, "vec_id", "embedding", "label", "centroid")
    x = agreement.agreement(e.select("vec_id", F.col("label").alias("truth")).join(m, "vec_id"), "truth", "label")
    return x.select(*[F.round(k, 6).alias(k) for k in x.columns])


def topic_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How the posts' topics agree with their categories."""
    p = table(spark, d, "processed_posts").select(topic_of(F.col("final_topic")).alias("t"), fold(F.col("category")).alias("c")).where("t IS NOT NULL AND c IS NOT NULL AND c <> ''")
    x = agreement.agreement(p, "t", "c")
    return x.select(*[F.round(k, 6).alias(k) for k in x.columns])


def label_cohesion(spark: SparkSession, d: str) -> DataFrame:
    """Cohesion of the labels' vectors."""
    x = agreement.cohesion(table(spark, d, "embeddings"), "label", "embedding", SIZE)
    return x.select("label", "n", F.round("cohesion", 6).alias("cohesion"), F.round("avg_pairwise", 6).alias("avg_pairwise"))


def outlier_share(spark: SparkSession, d: str) -> DataFrame:
    """Per label: members nearer to another label's centroid, and those below a similarity."""
    e, c = _vectors(spark, d)
    own = e.join(c, "label").select("label", vectors.cosine(F.col("embedding"), F.col("centroid")).alias("s"))
    return own.groupBy("label").agg(F.round(F.avg((F.col("s") < 0.2).cast("double")), 6).alias("below"), F.round(F.min("s"), 6).alias("least"))


def vector_health(spark: SparkSession, d: str) -> DataFrame:
    """Number, length, mean and spread of the vectors' norms."""
    n = vectors.norm(F.col("embedding"))
    return table(spark, d, "embeddings").select(F.size("embedding").alias("size"), n.alias("n")).agg(F.count("*").alias("n_vectors"), F.max("size").alias("size"), F.round(F.avg("n"), 6).alias("mean_norm"), F.round(F.stddev_pop("n"), 6).alias("std_norm"))


QUERIES = {
    "match_best": match_best, "match_floor": match_floor, "match_names": match_names, "unmatched_names": unmatched_names, "keyword_hits": keyword_hits, "bm25_articles": bm25_articles, "rrf_match": rrf_match,
    "linear_match": linear_match, "tfidf_topics": tfidf_topics, "label_agreement": label_agreement, "topic_agreement": topic_agreement, "label_cohesion": label_cohesion, "outlier_share": outlier_share, "vector_health": vector_health,
}
_DOT = "list_sum(list_transform(range(1, {n} + 1), lambda i: CAST({a}[i] AS DOUBLE) * {b}[i]))"


def _dot(a: str, b: str, n: int = SIZE) -> str:
    return _DOT.format(a=a, b=b, n=n)


_CENT = f"""c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, {SIZE + 1}) r(i) GROUP BY ALL) GROUP BY label),
s AS (SELECT vec_id, c.label, e.label AS own, e.embedding AS a, c.v AS b, {_dot('e.embedding', 'c.v')} / greatest(sqrt({_dot('e.embedding', 'e.embedding')}) * sqrt({_dot('c.v', 'c.v')}), 1e-8) AS sim FROM embeddings e, c),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) = 1)"""
_TOPIC = "trim(regexp_replace(lower(trim({})), '^new:', ''))"
from trendloom.functions.text import NO_TOPIC as _NO  # noqa: E402
from trendloom.plans.text_queries import _FOLD, _KEYS  # noqa: E402



def _words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{{{2,}}}}')".replace("{{2,}}", "{2,}")


_USABLE = "len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_POSTS = f"""p AS (SELECT id, content, embedding AS e, CASE WHEN {_TOPIC.format('final_topic')} NOT IN {_NO} THEN {_TOPIC.format('final_topic')} END AS topic FROM processed_posts WHERE {_USABLE}),
      c AS (SELECT topic, list(x ORDER BY i) AS v FROM (SELECT topic, i, avg(CAST(e[i] AS DOUBLE)) AS x FROM p, range(1, 97) r(i) WHERE topic IS NOT NULL GROUP BY ALL) GROUP BY topic)"""
_PARSED = "CASE WHEN NOT regexp_matches(lower(embedding), 'nan|inf|null|none') THEN list_transform(regexp_extract_all(embedding, '[-+]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][-+]?[0-9]+)?'), lambda x: TRY_CAST(x AS FLOAT)) END"
_AGREE = """cells AS (SELECT t, p, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY ALL), a AS (SELECT t, sum(n) AS nt FROM cells GROUP BY t), b AS (SELECT p, sum(n) AS np, max(n) AS top FROM cells GROUP BY p),
g AS (SELECT sum(n) AS N, sum(n*(n-1)/2) AS both_, sum(n*n/np) AS bp, sum(n*n/nt) AS br, sum(-n*log2(n/np)) AS h, sum(n*ln(n/(nt*np))) AS mi FROM cells JOIN a USING (t) JOIN b USING (p)),
k AS (SELECT * FROM g, (SELECT sum(nt*(nt-1)/2) AS pt, sum(-nt*ln(nt)) AS ht FROM a), (SELECT sum(np*(np-1)/2) AS pp, sum(-np*ln(np)) AS hp, sum(top) AS top FROM b)),
m AS (SELECT *, both_/pp AS p1, both_/pt AS r1, bp/N AS p3, br/N AS r3, pp*pt/(N*(N-1)/2) AS e FROM k)
SELECT round(p1,6) AS pair_precision, round(r1,6) AS pair_recall, round(2*p1*r1/(p1+r1),6) AS pair_f1, round(p3,6) AS b3_precision, round(r3,6) AS b3_recall, round(2*p3*r3/(p3+r3),6) AS b3_f1, round(top/N,6) AS purity, round(h/N,6) AS entropy,
round((both_-e)/((pp+pt)/2-e),6) AS ari, round((ln(N)+mi/N)/((ln(N)+ht/N+ln(N)+hp/N)/2),6) AS nmi FROM m"""
SQL = {
    "match_best": f"WITH {_CENT} SELECT vec_id, label, round(sim, 6) AS sim FROM best",
    "match_floor": f"WITH {_CENT} SELECT label, count(*) AS n, round(avg(sim), 6) AS mean_sim FROM best WHERE sim >= 0.2 GROUP BY label",
    "match_names": f"SELECT msg_id, trend_id FROM (SELECT msg_id, {_TOPIC.format('final_topic')} AS name FROM posts_stream_v1) p JOIN (SELECT {_TOPIC.format('trend_name')} AS name, min(id) AS trend_id FROM detected_trends GROUP BY 1) t USING (name) WHERE name NOT IN {_NO}",
    "unmatched_names": f"SELECT name, count(*) AS n FROM (SELECT {_TOPIC.format('final_topic')} AS name FROM posts_stream_v1) p WHERE name NOT IN {_NO} AND NOT EXISTS (SELECT 1 FROM detected_trends t WHERE {_TOPIC.format('t.trend_name')} = p.name) GROUP BY 1",
    "keyword_hits": f"SELECT id, count(DISTINCT url) AS n_articles FROM (SELECT id, lower(trim(unnest({_KEYS}))) AS k FROM detected_trends) g JOIN (SELECT url, lower(concat_ws(' ', title, content)) AS x FROM news_articles) a ON contains(a.x, g.k) WHERE g.k <> '' GROUP BY 1",
    "bm25_articles": f"""WITH d AS (SELECT url, {_words("min(concat_ws(' ', title, short_description))")} AS ws FROM news_articles GROUP BY url), z AS (SELECT count(*) AS nd, avg(len(ws)) AS avgdl FROM d),
      p AS (SELECT url, len(ws) AS dl, w, count(*) AS tf FROM (SELECT url, ws, unnest(ws) AS w FROM d) GROUP BY ALL), f AS (SELECT w, count(*) AS n FROM p GROUP BY w),
      q AS (SELECT row_id, w, count(*) AS qtf FROM (SELECT row_id, unnest({_words("concat_ws(' ', trend, array_to_string(" + _KEYS + ", ' '))")}) AS w FROM google_trends) GROUP BY ALL),
      r AS (SELECT row_id, url, round(sum(qtf * ln(1 + (nd - n + 0.5) / (n + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25 FROM p JOIN f USING (w) JOIN q USING (w), z GROUP BY ALL)
      SELECT row_id, url, bm25 FROM r QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY bm25 DESC, url) <= 3""",
    "rrf_match": f"""WITH {_POSTS}, k AS (SELECT topic, list_distinct(list(lower(trim(w)))) AS ks FROM (SELECT {_TOPIC.format('trend_name')} AS topic, unnest({_KEYS}) AS w FROM detected_trends) WHERE length(w) >= 3 GROUP BY topic),
      s AS (SELECT p.id, c.topic, round({_dot('p.e', 'c.v', 96)} / (sqrt({_dot('p.e', 'p.e', 96)}) * sqrt({_dot('c.v', 'c.v', 96)})), 9) AS sim, CASE WHEN len(list_filter(coalesce(k.ks, []), lambda w: contains(lower(p.content), w))) > 0 THEN 1 ELSE 0 END AS hit FROM p CROSS JOIN c LEFT JOIN k ON k.topic = c.topic),
      r AS (SELECT *, 1.0 / (60 + rank() OVER (PARTITION BY id ORDER BY sim DESC)) + 1.0 / (60 + rank() OVER (PARTITION BY id ORDER BY hit DESC)) AS rrf FROM s),
      w AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY rrf DESC, sim DESC, topic) = 1) SELECT id, topic, round(rrf, 9) AS rrf, round(sim, 6) AS sim FROM w WHERE sim >= 0.65""",
    "linear_match": f"""WITH {_POSTS}, t AS (SELECT * FROM (SELECT id, {_words("concat_ws(' ', trend_name, array_to_string(" + _KEYS + ", ' '))")} AS ws, {_PARSED} AS v FROM detected_trends) WHERE len(v) = 96 AND len(list_filter(v, lambda x: x <> 0)) > 0 AND len(list_filter(v, lambda x: isnan(x) OR isinf(x))) = 0),
      z AS (SELECT count(*) AS nd, avg(len(ws)) AS avgdl FROM t), q AS (SELECT id, len(ws) AS dl, w, count(*) AS tf FROM (SELECT id, ws, unnest(ws) AS w FROM t) GROUP BY ALL), f AS (SELECT w, count(*) AS n FROM q GROUP BY w),
      a AS (SELECT topic, w, count(*) AS qtf FROM (SELECT topic, unnest({_words('topic')}) AS w FROM c) GROUP BY ALL),
      b AS (SELECT topic, id, sum(qtf * ln(1 + (nd - n + 0.5) / (n + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM q JOIN f USING (w) JOIN a USING (w), z GROUP BY ALL),
      s AS (SELECT c.topic, t.id, round({_dot('c.v', 't.v', 96)} / greatest(sqrt({_dot('c.v', 'c.v', 96)}) * sqrt({_dot('t.v', 't.v', 96)}), 1e-8), 9) AS sim, coalesce(bm25, 0) AS bm25, max(bm25) OVER (PARTITION BY c.topic) AS most FROM c CROSS JOIN t LEFT JOIN b ON b.topic = c.topic AND b.id = t.id),
      r AS (SELECT *, round(least(1.0, 0.6 * sim + 0.4 * CASE WHEN most > 0 THEN bm25 / most ELSE 0 END), 9) AS fused FROM s WHERE sim >= 0.35)
      SELECT topic, id, round(fused, 6) AS fused, round(sim, 6) AS sim FROM r QUALIFY row_number() OVER (PARTITION BY topic ORDER BY fused DESC, id) = 1""",
    "tfidf_topics": f"""WITH t AS (SELECT source, w, count(*) AS tf FROM (SELECT source, unnest({_words('title')}) AS w FROM news_articles) GROUP BY ALL), n AS (SELECT count(DISTINCT source) AS N FROM news_articles),
      f AS (SELECT w, count(*) AS df FROM t GROUP BY w), x AS (SELECT source, w, tf * (ln((1 + N) / (1 + df)) + 1) AS x FROM t JOIN f USING (w), n WHERE df >= 2 AND df <= N * 0.95),
      y AS (SELECT source, w, round(x / sqrt(sum(x * x) OVER (PARTITION BY source)), 6) AS weight FROM x) SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY source ORDER BY weight DESC, w) <= 5""",
    "label_agreement": f"WITH {_CENT}, x AS (SELECT own AS t, label AS p FROM best), {_AGREE}",
    "topic_agreement": f"WITH x AS (SELECT * FROM (SELECT {_TOPIC.format('final_topic')} AS t, {_FOLD.format('category')} AS p FROM processed_posts) WHERE t NOT IN {_NO} AND p <> ''), {_AGREE}",
    "label_cohesion": f"""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda z: z / sqrt({_dot('embedding', 'embedding')})) AS u FROM embeddings),
      m AS (SELECT label, list(x ORDER BY i) AS m, any_value(n) AS n FROM (SELECT label, i, avg(u[i]) AS x, count(*) AS n FROM u, range(1, {SIZE + 1}) r(i) GROUP BY ALL) GROUP BY label)
      SELECT label, n, round(avg({_dot('u', 'm')} / (sqrt({_dot('u', 'u')}) * sqrt({_dot('m', 'm')}))), 6) AS cohesion, round((CAST(n AS DOUBLE) * n * any_value({_dot('m', 'm')}) - n) / (CAST(n AS DOUBLE) * (n - 1)), 6) AS avg_pairwise FROM u JOIN m USING (label) GROUP BY label, n""",
    "outlier_share": f"WITH {_CENT} SELECT label, round(avg(CASE WHEN sim < 0.2 THEN 1.0 ELSE 0.0 END), 6) AS below, round(min(sim), 6) AS least FROM s WHERE own = label GROUP BY label",
    "vector_health": f"SELECT count(*) AS n_vectors, CAST(max(len(embedding)) AS INT) AS size, round(avg(n), 6) AS mean_norm, round(stddev_pop(n), 6) AS std_norm FROM (SELECT embedding, sqrt({_dot('embedding', 'embedding')}) AS n FROM embeddings)",
}
