"""Quality of groupings, dictionaries, trend tables from posts, and state changes of the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trendloom.functions import vectors
from trendloom.functions.text import NO_TOPIC, fold, keyword_list, tokens, topic_of
from trendloom.operators import agreement, graph, matching, state
from trendloom.plans.match_queries import _CENT, _PARSED, _dot, _words
from trendloom.plans.text_queries import _FOLD, _KEYS
from trendloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
SIZE = 64
_T = "trim(regexp_replace(lower(trim({})), '^new:', ''))"
_PT = f"(SELECT * FROM (SELECT *, {_T.format('final_topic')} AS topic FROM processed_posts) WHERE topic NOT IN {NO_TOPIC})"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _posts(spark, d):
    return table(spark, d, "processed_posts").withColumn("topic", topic_of(F.col("final_topic")))


# --- quality of groupings


@query(f"""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda z: z / sqrt({_dot('embedding', 'embedding')})) AS u FROM embeddings),
m AS (SELECT label, list(x ORDER BY i) AS s, any_value(n) AS n FROM (SELECT label, i, sum(u[i]) AS x, count(*) AS n FROM u, range(1, {SIZE + 1}) r(i) GROUP BY ALL) GROUP BY label),
x AS (SELECT vec_id, u.label, any_value(CASE WHEN m.label = u.label THEN n END) AS n_own, max(CASE WHEN m.label = u.label AND n > 1 THEN 1 - ({_dot('u', 's')} - 1) / (n - 1) END) AS a, min(CASE WHEN m.label <> u.label THEN 1 - {_dot('u', 's')} / n END) AS b FROM u, m GROUP BY ALL)
SELECT label, count(*) AS n, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM x GROUP BY label""")
def silhouettes(spark, d):
    """The mean cosine silhouette of each label's vectors, exact by sums of unit vectors."""
    x = agreement.cosine_silhouette(table(spark, d, "embeddings"), "vec_id", "label", "embedding", SIZE)
    return x.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


_NOISE = f"(SELECT {_T.format('final_topic')} IN {NO_TOPIC} OR final_topic IS NULL AS truth, coalesce(category, '') = '' OR length(coalesce(content, '')) < 30 AS said FROM processed_posts)"


@query(f"SELECT round(tp / CAST(nullif(said, 0) AS DOUBLE), 6) AS noise_precision, round(tp / CAST(nullif(truth, 0) AS DOUBLE), 6) AS noise_recall, truth AS n_noise FROM (SELECT count(*) FILTER (truth AND said) AS tp, count(*) FILTER (said) AS said, count(*) FILTER (truth) AS truth FROM {_NOISE})")
def noise_quality(spark, d):
    """How well posts without a category or hardly any text foretell those without a topic."""
    p = _posts(spark, d).select(F.col("topic").isNull().alias("truth"), ((F.coalesce("category", F.lit("")) == "") | (F.length(F.coalesce("content", F.lit(""))) < 30)).alias("said"))
    return agreement.noise_quality(p, "truth", "said")


@query("SELECT round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(avg(CAST(s > 0.7 AS INT)), 6) AS share_sure, round(avg(CAST(s < 0.3 AS INT)), 6) AS share_unsure, count(*) AS n FROM (SELECT trend_score / 100 AS s FROM detected_trends WHERE trend_score IS NOT NULL)")
def confidence(spark, d):
    """Mean and median of the trends' scores, with the shares of sure and unsure ones."""
    s = table(spark, d, "detected_trends").where("trend_score IS NOT NULL").select((F.col("trend_score") / 100).alias("s"))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return s.agg(F.round(F.avg("s"), 6).alias("mean"), F.round(F.median("s"), 6).alias("median"), share(F.col("s") > 0.7).alias("share_sure"), share(F.col("s") < 0.3).alias("share_unsure"), F.count("*").alias("n"))


@query(f"WITH {_CENT} SELECT label, count(*) AS n, round(avg(sim), 6) AS mean_sim FROM s WHERE own = label GROUP BY label HAVING avg(sim) < 0.55 ORDER BY mean_sim, label")
def loose_labels(spark, d):
    """Labels whose vectors are not very similar to their centroid, the loosest first."""
    e = table(spark, d, "embeddings")
    c = matching.centroids(e, "label", "embedding", SIZE).select("label", "centroid")
    g = e.join(c, "label").groupBy("label").agg(F.count("*").alias("n"), F.avg(vectors.cosine(F.col("embedding"), F.col("centroid"))).alias("m"))
    return g.where("m < 0.55").select("label", "n", F.round("m", 6).alias("mean_sim")).orderBy("mean_sim", "label")


@query("SELECT source, round(avg(length(short_description) / CAST(length(content) AS DOUBLE)), 6) AS mean_ratio, round(sum(length(short_description)) / CAST(sum(length(content)) AS DOUBLE), 6) AS total_ratio, count(*) AS n FROM news_articles WHERE length(content) > 0 AND short_description IS NOT NULL GROUP BY source")
def compression(spark, d):
    """How much shorter the descriptions of articles are than the articles, by source."""
    a = table(spark, d, "news_articles").where("length(content) > 0 AND short_description IS NOT NULL").select("source", F.length("short_description").alias("s"), F.length("content").alias("c"))
    return a.groupBy("source").agg(F.round(F.avg(F.col("s") / F.col("c")), 6).alias("mean_ratio"), F.round(F.sum("s") / F.sum("c"), 6).alias("total_ratio"), F.count("*").alias("n"))


@query(f"SELECT round(avg(v), 6) AS mean_dim_variance, count(*) AS n_dims FROM (SELECT i, var_pop(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, range(1, {SIZE + 1}) r(i) GROUP BY i)")
def dimension_variance(spark, d):
    """The mean population variance of the vectors' dimensions."""
    v = table(spark, d, "embeddings").agg(F.array(*[F.var_pop(F.col("embedding")[i].cast("double")) for i in range(SIZE)]).alias("v"))
    return v.select(F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v"), 6).alias("mean_dim_variance"), F.size("v").cast("bigint").alias("n_dims"))


@query(f"""WITH w AS (SELECT DISTINCT source, article_id, unnest({_words('title')}) AS w FROM news_articles), n AS (SELECT count(DISTINCT article_id) AS n FROM news_articles), g AS (SELECT w, count(DISTINCT article_id) AS df FROM w GROUP BY w),
t AS (SELECT source, w FROM (SELECT source, w, count(*) AS c FROM w GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY c DESC, w) <= 10), k AS (SELECT w.source, w.article_id, w.w, df FROM w JOIN t USING (source, w) JOIN g USING (w)),
p AS (SELECT a.source, any_value(a.df) AS fa, any_value(b.df) AS fb, count(*) AS c FROM k a JOIN k b ON a.source = b.source AND a.article_id = b.article_id AND a.w < b.w GROUP BY a.source, a.w, b.w)
SELECT source, round(avg(CASE WHEN c = n THEN 0 ELSE ln(c * CAST(n AS DOUBLE) / (CAST(fa AS DOUBLE) * fb)) / -ln(c / CAST(n AS DOUBLE)) END), 6) AS npmi, count(*) AS n_pairs FROM p, n GROUP BY source""")
def source_coherence(spark, d):
    """Per source: the mean NPMI of pairs of its ten most frequent headline words, counted in its articles and divided by all."""
    a = table(spark, d, "news_articles")
    w = a.select("source", "article_id", F.explode(F.array_distinct(tokens(F.col("title")))).alias("w")).distinct()
    n = a.agg(F.countDistinct("article_id").alias("n"))
    g = w.groupBy("w").agg(F.countDistinct("article_id").alias("df"))
    top = w.groupBy("source", "w").agg(F.count("*").alias("c")).withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("c"), "w"))).where("r <= 10").select("source", "w")
    k = w.join(top, ["source", "w"]).join(g, "w").groupBy("source", "article_id").agg(F.array_sort(F.collect_list(F.struct("w", "df"))).alias("ws"))  # ten at most
    pairs = F.flatten(F.transform("ws", lambda x: F.transform(F.filter("ws", lambda y: y["w"] > x["w"]), lambda y: F.struct(x["w"].alias("a"), y["w"].alias("b"), x["df"].alias("fa"), y["df"].alias("fb")))))
    p = k.select("source", F.explode(pairs).alias("p")).groupBy("source", "p").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n))  # one row
    npmi = F.when(F.col("c") == F.col("n"), 0.0).otherwise(F.log(F.col("c") * F.col("n").cast("double") / (F.col("p.fa").cast("double") * F.col("p.fb"))) / -F.log(F.col("c") / F.col("n")))
    return p.groupBy("source").agg(F.round(F.avg(npmi), 6).alias("npmi"), F.count("*").alias("n_pairs"))


# --- words


_GRAMS = f"""g AS (SELECT source, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS w FROM (SELECT source, {_words('title')} AS ws FROM news_articles))"""


def _grams(words):
    return F.concat(words, F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.element_at(words, i + 1), w)))


@query(f"""WITH {_GRAMS}, t AS (SELECT source, w, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT count(DISTINCT source) AS N FROM g), f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
v AS (SELECT w FROM t JOIN f USING (w), n WHERE df >= 2 AND df <= N * 0.95 GROUP BY w ORDER BY sum(tf) DESC, w LIMIT 5000), x AS (SELECT source, w, tf * (ln((1 + N) / (1 + df)) + 1) AS x FROM t JOIN f USING (w) JOIN v USING (w), n),
y AS (SELECT source, w, round(x / sqrt(sum(x * x) OVER (PARTITION BY source)), 6) AS weight FROM x) SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY source ORDER BY weight DESC, w) <= 5""")
def tfidf_grams(spark, d):
    """The five words and pairs of words that mark each source's headlines, of the 5000 most frequent ones."""
    words = table(spark, d, "news_articles").select("source", F.explode(_grams(tokens(F.col("title")))).alias("word"))
    w = matching.tf_idf(words, "source", "word", most_terms=5000).withColumn("weight", F.round("weight", 6))
    return w.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("weight"), "w"))).where("r <= 5").select("source", "w", "weight")


@query(f"""WITH {_GRAMS}, c AS (SELECT w, count(*) AS n FROM g GROUP BY w ORDER BY n DESC, w LIMIT 1000), k AS (SELECT DISTINCT lower(trim(unnest({_KEYS}))) AS w FROM detected_trends UNION SELECT {_T.format('trend_name')} FROM detected_trends)
SELECT w, n FROM c WHERE w IN (SELECT w FROM k) ORDER BY n DESC, w LIMIT 20""")
def anchors(spark, d):
    """The twenty most frequent words and pairs of the headlines that are terms of a trend."""
    words = table(spark, d, "news_articles").select(F.explode(_grams(tokens(F.col("title")))).alias("w"))
    t = table(spark, d, "detected_trends")
    known = t.select(F.explode(F.transform(keyword_list(F.col("keywords")), F.lower)).alias("w")).unionByName(t.select(F.trim(F.regexp_replace(F.lower(F.trim("trend_name")), "^new:", "")).alias("w"))).distinct()
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1000)
    return top.join(known, "w", "left_semi").orderBy(F.desc("n"), "w").limit(20)


@query("SELECT count(*) AS n_lines, count(DISTINCT line) AS n_distinct FROM (SELECT trim(unnest(string_split(content, chr(10)))) AS line FROM news_articles) WHERE line <> ''")
def distinct_lines(spark, d):
    """Lines of the articles, and different ones."""
    x = table(spark, d, "news_articles").select(F.explode(F.transform(F.split("content", "\n"), F.trim)).alias("line")).where("line <> ''")
    return x.groupBy("line").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_distinct"))


@query(f"SELECT id, concat_ws('. ', CASE WHEN length(({_KEYS})[1]) > 0 THEN ({_KEYS})[1] END, summary) AS text FROM detected_trends WHERE summary IS NOT NULL")
def prefixed_summaries(spark, d):
    """Summaries with the trend's first keyword in front."""
    t = table(spark, d, "detected_trends").where("summary IS NOT NULL")
    return t.select("id", F.concat_ws(". ", F.get(keyword_list(F.col("keywords")), F.lit(0)), "summary").alias("text"))


@query("SELECT msg_id, round(x / (max(x) OVER () + 5), 6) AS share FROM (SELECT msg_id, CAST(interaction AS DOUBLE) AS x FROM posts_stream_v1 WHERE interaction IS NOT NULL)")
def damped_shares(spark, d):
    """Interactions of messages as a share of the highest, damped by five."""
    p = table(spark, d, "posts_stream_v1").where("interaction IS NOT NULL").select("msg_id", F.col("interaction").cast("double").alias("x"))
    return p.crossJoin(F.broadcast(p.agg((F.max("x") + 5).alias("m")))).select("msg_id", F.round(F.col("x") / F.col("m"), 6).alias("share"))  # one row


# --- dictionaries


@query(f"""WITH t AS (SELECT {_FOLD.format('trend_name')} AS key, id, volume, list_transform({_KEYS}, lambda k: lower(k)) AS ks FROM detected_trends WHERE trend_name IS NOT NULL), k AS (SELECT DISTINCT key FROM t),
m AS (SELECT a.key, arg_min(b.key, struct_pack(n := length(b.key), k := b.key)) AS canonical FROM k a JOIN k b ON contains(a.key, b.key) AND (length(b.key) >= 5 OR a.key = b.key) GROUP BY a.key)
SELECT canonical, count(*) AS n_rows, CAST(sum(volume) AS BIGINT) AS volume, min(id) AS id, CAST(len(list_distinct(flatten(list(ks)))) AS INT) AS n_keywords FROM t JOIN m USING (key) GROUP BY canonical""")
def trend_dictionary(spark, d):
    """Trends under the shortest name that theirs contains: volumes added, keywords united."""
    t = table(spark, d, "detected_trends").where("trend_name IS NOT NULL").select("id", "volume", fold(F.col("trend_name")).alias("key"), F.transform(keyword_list(F.col("keywords")), F.lower).alias("ks"))
    return matching.merged_dictionary(t, "key", "id", "volume", "ks").select("canonical", "n_rows", "volume", "id", F.size("keywords").alias("n_keywords"))


# --- trends from posts


@query(f"""WITH k AS (SELECT id, lower(trim(unnest({_KEYS}))) AS k FROM detected_trends), h AS (SELECT DISTINCT k.id, p.id AS post FROM k JOIN processed_posts p ON contains(lower(p.content), k.k) WHERE k.k <> '')
SELECT id, count(*) AS post_count, least(95, 50 + count(*)) AS score FROM h GROUP BY id HAVING count(*) >= 2""")
def keyword_trends(spark, d):
    """Trends with the posts that contain any of their keywords, if at least two do."""
    k = table(spark, d, "detected_trends").select("id", F.explode(keyword_list(F.col("keywords"))).alias("k"))
    h = matching.keyword_counts(table(spark, d, "processed_posts").select(F.col("id").alias("post"), "content"), k, "post", "content", "id", "k")
    return h.select("id", (F.col("n") + F.col("nulls")).alias("post_count")).where("post_count >= 2").withColumn("score", F.least(F.lit(95).cast("bigint"), 50 + F.col("post_count")))


@query(f"SELECT topic, post_count, rep_ids FROM (SELECT topic, max(n) AS post_count, list(id ORDER BY id) FILTER (r <= 10) AS rep_ids FROM (SELECT topic, id, count(*) OVER (PARTITION BY topic) AS n, row_number() OVER (PARTITION BY topic ORDER BY id) AS r FROM {_PT}) GROUP BY topic) WHERE post_count >= 2")
def topic_trends(spark, d):
    """Topics of at least two posts as trends, with their first ten posts."""
    p = _posts(spark, d).where("topic IS NOT NULL")
    n = p.groupBy("topic").agg(F.count("*").alias("post_count")).where("post_count >= 2")
    few = p.select("topic", "id").withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy("id"))).where("r <= 10")  # cut before the shuffle
    return few.groupBy("topic").agg(F.array_sort(F.collect_list("id")).alias("rep_ids")).join(n, "topic").select("topic", "post_count", "rep_ids")


@query(f"SELECT msg_id, 'New: ' || CASE WHEN length(content) > 30 THEN substr(content, 1, 30) || '...' ELSE content END AS name, 1 AS post_count FROM (SELECT msg_id, content, {_T.format('final_topic')} AS topic FROM posts_stream_v1) p WHERE content IS NOT NULL AND (topic IS NULL OR topic IN {NO_TOPIC} OR NOT EXISTS (SELECT 1 FROM detected_trends t WHERE {_T.format('t.trend_name')} = p.topic))")
def discovered_trends(spark, d):
    """A trend of its own for each message that no known trend's name fits."""
    known = table(spark, d, "detected_trends").select(topic_of(F.col("trend_name")).alias("topic")).where("topic IS NOT NULL").distinct()
    p = table(spark, d, "posts_stream_v1").where("content IS NOT NULL").select("msg_id", "content", topic_of(F.col("final_topic")).alias("topic")).join(known, "topic", "left_anti")
    return p.select("msg_id", F.concat(F.lit("New: "), F.when(F.length("content") > 30, F.concat(F.substring("content", 1, 30), F.lit("..."))).otherwise(F.col("content"))).alias("name"), F.lit(1).alias("post_count"))


# --- the trend table


@query("SELECT id, trend_name, post_count, summary FROM detected_trends WHERE id = (SELECT min(id) FROM detected_trends)")
def trend_by_id(spark, d):
    """One trend by its id, here the smallest."""
    t = table(spark, d, "detected_trends")
    return t.where(F.col("id") == t.agg(F.min("id")).first()[0]).select("id", "trend_name", "post_count", "summary")


@query("SELECT id, trend_name FROM detected_trends WHERE category = 'T5'")
def trends_of_category(spark, d):
    """The trends of one category."""
    return table(spark, d, "detected_trends").where("category = 'T5'").select("id", "trend_name")


@query("SELECT id FROM detected_trends WHERE topic_type = 'Discovery' OR trend_score > 30")
def refinement_candidates(spark, d):
    """Trends that are worth a second look: discovered ones and those of a score."""
    return table(spark, d, "detected_trends").where("topic_type = 'Discovery' OR trend_score > 30").select("id")


@query("""SELECT id, post_count FROM detected_trends WHERE (summary IS NULL OR trim(summary) = '' OR lower(summary) LIKE '%waiting%' OR (topic_type = 'Seeded' AND post_count >= 5)) AND post_count >= 3 ORDER BY post_count DESC, id LIMIT 15""")
def analysis_queue(spark, d):
    """The fifteen largest trends that wait for a summary, or are seeded and have grown."""
    waits = F.col("summary").isNull() | (F.trim("summary") == "") | F.lower("summary").contains("waiting")
    t = table(spark, d, "detected_trends").where((waits | ((F.col("topic_type") == "Seeded") & (F.col("post_count") >= 5))) & (F.col("post_count") >= 3))
    return t.orderBy(F.desc("post_count"), "id").limit(15).select("id", "post_count")


@query(f"SELECT id, CASE WHEN length(y) < 4 OR y IN {NO_TOPIC} THEN 'ignored' ELSE coalesce(topic_type, 'none') END AS topic_type, CASE WHEN length(y) < 4 OR y IN {NO_TOPIC} THEN 0.0 ELSE trend_score END AS score FROM (SELECT *, {_T.format('trend_name')} AS y FROM detected_trends WHERE trend_name IS NOT NULL)")
def marked_ignored(spark, d):
    """The trend table after those whose name says nothing were marked as ignored."""
    t = table(spark, d, "detected_trends").where("trend_name IS NOT NULL")
    name = F.trim(F.regexp_replace(F.lower(F.trim("trend_name")), "^new:", ""))
    bad = (F.length(name) < 4) | name.isin(*NO_TOPIC)
    return t.select("id", F.when(bad, "ignored").otherwise(F.coalesce("topic_type", F.lit("none"))).alias("topic_type"), F.when(bad, 0.0).otherwise(F.col("trend_score")).alias("score"))


@query("""WITH r AS (SELECT a.trend, min(a.row_id) AS row_id FROM google_trends a GROUP BY a.trend) SELECT t.id, coalesce(r.trend, t.trend_name) AS name, coalesce('Search: ' || g.keywords, t.summary) AS summary, r.row_id IS NOT NULL AS renamed
FROM detected_trends t LEFT JOIN r ON lower(trim(r.trend)) = lower(trim(t.trend_name)) AND r.row_id = (SELECT min(x.row_id) FROM google_trends x WHERE lower(trim(x.trend)) = lower(trim(t.trend_name))) LEFT JOIN google_trends g ON g.row_id = r.row_id""")
def analysed_trends(spark, d):
    """The trend table after a frame of results was joined: names and summaries set where there is one."""
    r = table(spark, d, "google_trends").groupBy(F.lower(F.trim("trend")).alias("key")).agg(F.min(F.struct("row_id", "trend", "keywords")).alias("r"))
    t = table(spark, d, "detected_trends").withColumn("key", F.lower(F.trim("trend_name"))).join(r, "key", "left")
    return t.select("id", F.coalesce("r.trend", "trend_name").alias("name"), F.coalesce(F.concat(F.lit("Search: "), F.col("r.keywords")), "summary").alias("summary"), F.col("r").isNotNull().alias("renamed"))


@query(f"SELECT topic, list(msg_id ORDER BY msg_id) AS kept FROM (SELECT {_T.format('final_topic')} AS topic, msg_id FROM posts_stream_v1 WHERE {_T.format('final_topic')} NOT IN {NO_TOPIC} QUALIFY row_number() OVER (PARTITION BY topic ORDER BY msg_id DESC) <= 100) GROUP BY topic")
def appended_posts(spark, d):
    """The hundred newest messages of each topic, appended in order of arrival."""
    p = table(spark, d, "posts_stream_v1").select(topic_of(F.col("final_topic")).alias("topic"), "msg_id").where("topic IS NOT NULL")
    last = p.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("msg_id")))).where("r <= 100")
    return last.groupBy("topic").agg(F.array_sort(F.collect_list("msg_id")).alias("kept"))


@query("""WITH x AS (SELECT lower(trim(trend_name)) AS name, min(id) AS trend_id, CAST(sum(post_count) AS BIGINT) AS post_count, CAST(sum(interactions) AS BIGINT) AS interactions, max(google_vol) AS google_vol,
 list(id ORDER BY id) AS order_ FROM detected_trends WHERE trend_name IS NOT NULL GROUP BY 1), c AS (SELECT *, CASE WHEN google_vol > 0 THEN least(100, 100 * log10(CAST(google_vol AS DOUBLE) + 1) / log10(5010001)) ELSE 0 END AS g, CASE WHEN interactions > 0 THEN least(100, 100 * log10(CAST(interactions AS DOUBLE) + 1) / log10(20001)) ELSE 0 END AS f, CASE WHEN post_count > 0 THEN least(100, 100 * log10(post_count + 1) / log10(11)) ELSE 0 END AS k FROM x)
SELECT trend_id, name, post_count, array_to_string(order_, ',') AS post_order, round(least(100, (0.40 * g + 0.35 * f + 0.25 * k) * CASE CAST(g > 10 AS INT) + CAST(f > 10 AS INT) + CAST(k > 10 AS INT) WHEN 3 THEN 1.2 WHEN 2 THEN 1.1 ELSE 1.0 END), 6) AS score FROM c""")
def rescored_trends(spark, d):
    """Trends of one name merged: their posts one after the other by id, the score taken anew."""
    t = table(spark, d, "detected_trends").where("trend_name IS NOT NULL")
    post = F.array(F.struct(F.col("id").cast("string").alias("content"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("time"), F.lit(1.0).alias("similarity")))
    s = t.select(F.col("id").alias("trend_id"), F.col("trend_name").alias("name"), F.col("post_count").cast("long").alias("post_count"), "interactions", "google_vol", F.lit(0.0).alias("score"), post.alias("posts"))
    m = state.merge_names(s, t.select(F.col("id").alias("trend_id"), F.lower(F.trim("trend_name")).alias("canonical")))
    return m.select("trend_id", "name", "post_count", F.array_join(F.transform("posts", lambda p: p["content"]), ",").alias("post_order"), F.round("score", 6).alias("score"))


@query(f"""WITH v AS (SELECT id, {_FOLD.format('trend_name')} AS c, CASE WHEN len({_PARSED}) = 96 THEN {_PARSED} END AS v FROM detected_trends WHERE trend_name IS NOT NULL)
SELECT a.id, CASE WHEN a.id = b.id OR {_dot('a.v', 'b.v', 96)} / greatest(sqrt({_dot('a.v', 'a.v', 96)}) * sqrt({_dot('b.v', 'b.v', 96)}), 1e-8) >= 0.7 THEN b.id ELSE a.id END AS merged_into FROM v a JOIN (SELECT c, min(id) AS id, first(v ORDER BY id) AS v FROM v GROUP BY c) b USING (c)""")
def guarded_merges(spark, d):
    """Each trend with the first of its name, but kept apart where their vectors aren't similar or there are none."""
    v = vectors.parsed(F.col("embedding"))
    t = table(spark, d, "detected_trends").where("trend_name IS NOT NULL").select("id", fold(F.col("trend_name")).alias("c"), v.alias("v")).withColumn("v", F.when(F.size("v") == 96, F.col("v")))
    first = t.groupBy("c").agg(F.min(F.struct("id", "v")).alias("f"))
    same = F.coalesce(vectors.cosine(F.col("v"), F.col("f.v")) >= 0.7, F.lit(False)) | (F.col("id") == F.col("f.id"))
    return t.join(first, "c").select("id", F.when(same, F.col("f.id")).otherwise(F.col("id")).alias("merged_into"))


_EPS = 0.4


@query(f"""WITH RECURSIVE u AS (SELECT vec_id, list_transform(embedding, lambda z: z / sqrt({_dot('embedding', 'embedding')})) AS u FROM embeddings),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE round({_dot('a.u', 'b.u')}, 9) >= {_EPS}), r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT a AS vec_id, min(b) AS component FROM r GROUP BY a""".replace("{_dot('a.u', 'b.u')}", _dot("a.u", "b.u")))
def epsilon_components(spark, d):
    """Components of the graph that ties all vectors of a cosine of at least 0.4."""
    e = table(spark, d, "embeddings")
    return graph.components(graph.similar_pairs(e, "vec_id", "embedding", _EPS), "a", "b").withColumnRenamed("node", "vec_id")
