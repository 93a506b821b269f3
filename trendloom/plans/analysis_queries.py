"""Further projections, joins, aggregates and rankings of the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trendloom.functions import vectors
from trendloom.functions.text import NO_TOPIC, fold, keyword_list, sentiment_label, tokens, topic_of
from trendloom.operators import agreement, density, matching
from trendloom.plans.match_queries import SQL as _MATCH_SQL
from trendloom.plans.match_queries import _CENT, _dot, _words
from trendloom.plans.text_queries import _FOLD, _KEYS
from trendloom.session import numbered, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
SIZE = 64
_BM25 = _MATCH_SQL["bm25_articles"]
_T = "trim(regexp_replace(lower(trim(final_topic)), '^new:', ''))"
_PT = f"(SELECT * FROM (SELECT *, {_T} AS topic FROM processed_posts) WHERE topic NOT IN {NO_TOPIC})"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _topics(spark, d):
    return table(spark, d, "processed_posts").withColumn("topic", topic_of(F.col("final_topic"))).where("topic IS NOT NULL")


@query("SELECT source, CASE WHEN contains(source, 'Face') THEN 'FACEBOOK' WHEN source IS NULL THEN NULL ELSE upper(source) END AS shown, CASE WHEN contains(source, 'Face') THEN 'FACEBOOK' WHEN kind = 'news' THEN 'NEWS' END AS bucket FROM source_sites")
def source_names(spark, d):
    """How sources are shown and bucketed."""
    social = F.contains("source", F.lit("Face"))
    return table(spark, d, "source_sites").select("source", F.when(social, "FACEBOOK").otherwise(F.upper("source")).alias("shown"), F.when(social, "FACEBOOK").when(F.col("kind") == "news", "NEWS").alias("bucket"))


@query(f"SELECT id, CASE WHEN len(hits) > 0 THEN '[Keywords: ' || array_to_string(hits, ' ') || '] ' ELSE '' END || coalesce(summary, '') AS guided FROM (SELECT id, summary, list_filter({_KEYS}, lambda k: contains(lower(summary), lower(k))) AS hits FROM detected_trends)")
def guided_summaries(spark, d):
    """Trend summaries with the keywords that they contain in front."""
    hits = F.coalesce(F.filter(keyword_list(F.col("keywords")), lambda k: F.contains(F.lower("summary"), F.lower(k))), F.array().cast("array<string>"))
    t = table(spark, d, "detected_trends").select("id", "summary", hits.alias("hits"))
    return t.select("id", F.concat(F.when(F.size("hits") > 0, F.concat(F.lit("[Keywords: "), F.array_join("hits", " "), F.lit("] "))).otherwise(""), F.coalesce("summary", F.lit(""))).alias("guided"))


@query("SELECT id, concat_ws(chr(10), CASE WHEN trend_name IS NOT NULL THEN 'What: ' || trend_name END, CASE WHEN advice_state <> '' THEN 'State: ' || advice_state END, CASE WHEN advice_business <> '' THEN 'Business: ' || advice_business END) AS brief FROM detected_trends")
def briefs(spark, d):
    """The parts of a trend's analysis in one text."""
    part = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c)))
    return table(spark, d, "detected_trends").select("id", F.concat_ws("\n", F.when(F.col("trend_name").isNotNull(), F.concat(F.lit("What: "), F.col("trend_name"))), part("State: ", "advice_state"), part("Business: ", "advice_business")).alias("brief"))


@query("SELECT id, metric, round(ln(1 + value), 6) AS logged FROM (UNPIVOT (SELECT id, CAST(google_vol AS BIGINT) AS google_vol, CAST(interactions AS BIGINT) AS interactions, CAST(post_count AS BIGINT) AS post_count FROM detected_trends) ON google_vol, interactions, post_count INTO NAME metric VALUE value)")
def long_counts(spark, d):
    """Counts of trends, one row each, on a log scale."""
    t = table(spark, d, "detected_trends").select("id", *[F.col(c).cast("bigint").alias(c) for c in ("google_vol", "interactions", "post_count")])
    return t.unpivot("id", ["google_vol", "interactions", "post_count"], "metric", "value").select("id", "metric", F.round(F.log1p("value"), 6).alias("logged"))


@query("SELECT row_id, regexp_matches(lower(trend), 'xổ số|kết quả|lịch thi|thời tiết|giá vàng|lottery|weather|schedule') AS routine FROM google_trends")
def routine_searches(spark, d):
    """Searches that come up every day."""
    return table(spark, d, "google_trends").select("row_id", F.lower("trend").rlike("xổ số|kết quả|lịch thi|thời tiết|giá vàng|lottery|weather|schedule").alias("routine"))


@query("""SELECT id, CASE WHEN generic AND routine THEN CASE WHEN trend_score < 60 THEN 'noise' ELSE 'kept' END WHEN generic AND topic_type = 'Discovery' THEN 'generic noise' WHEN routine THEN CASE WHEN trend_score < 30 THEN 'routine noise' ELSE 'kept' END
WHEN generic THEN 'generic' ELSE 'kept' END AS rule FROM (SELECT *, coalesce(len(string_split(trim(trend_name), ' ')) <= 2, false) AS generic, coalesce(category = 'T7', false) AS routine FROM detected_trends)""")
def noise_rules(spark, d):
    """The rule by which a classified trend is noise, or only generic (a name of one or two words), in order of the rules."""
    generic, routine = F.coalesce(F.size(F.split(F.trim("trend_name"), " ")) <= 2, F.lit(False)) & F.col("trend_name").isNotNull(), F.coalesce(F.col("category") == "T7", F.lit(False))
    s = F.col("trend_score")
    both = F.when(s < 60, "noise").otherwise("kept")
    rule = F.when(generic & routine, both).when(generic & (F.col("topic_type") == "Discovery"), "generic noise").when(routine, F.when(s < 30, "routine noise").otherwise("kept")).when(generic, "generic").otherwise("kept")
    return table(spark, d, "detected_trends").select("id", rule.alias("rule"))


@query(f"""WITH k AS (SELECT lower(trim(regexp_replace(lower(trim(trend_name)), '^new:', ''))) AS topic, list_distinct(flatten(list({_KEYS}))) AS ks FROM detected_trends WHERE trend_name IS NOT NULL GROUP BY 1)
SELECT topic, count(*) AS n, CAST(sum(CAST(len(list_filter(ks, lambda w: length(w) >= 3 AND contains(lower(content), lower(w)))) > 0 AS INT)) AS BIGINT) AS n_verified FROM {_PT} JOIN k USING (topic) WHERE content IS NOT NULL GROUP BY topic""")
def verified_members(spark, d):
    """Posts of each topic, and those that contain one of its trend's keywords."""
    k = table(spark, d, "detected_trends").where("trend_name IS NOT NULL").groupBy(topic_of(F.col("trend_name")).alias("topic")).agg(F.array_distinct(F.flatten(F.collect_list(keyword_list(F.col("keywords"))))).alias("ks"))
    p = _topics(spark, d).where("content IS NOT NULL").join(k, "topic")
    hit = F.exists("ks", lambda w: (F.length(w) >= 3) & F.contains(F.lower("content"), F.lower(w)))
    return p.groupBy("topic").agg(F.count("*").alias("n"), F.count_if(F.coalesce(hit, F.lit(False))).alias("n_verified"))


_REPS = "struct<content:string,source:string,similarity:double>"


@query("SELECT id, count(*) AS n_items, CAST(count_if(CAST(json_extract_string(x, '$.similarity') AS DOUBLE) >= 0.8) AS BIGINT) AS n_similar, count(DISTINCT json_extract_string(x, '$.source')) AS n_sources FROM (SELECT id, unnest(from_json(representative_posts, '[\"JSON\"]')) AS x FROM detected_trends WHERE json_valid(representative_posts) AND json_type(representative_posts) = 'ARRAY') GROUP BY id")
def representative_items(spark, d):
    """Representative posts of the trends whose list is whole: all, similar ones, and their sources."""
    t = table(spark, d, "detected_trends").where(F.try_parse_json("representative_posts").isNotNull() & F.ltrim("representative_posts").startswith("["))
    x = t.select("id", F.explode(F.from_json("representative_posts", f"array<{_REPS}>")).alias("x"))
    return x.groupBy("id").agg(F.count("*").alias("n_items"), F.count_if(F.coalesce(F.col("x.similarity") >= 0.8, F.lit(False))).alias("n_similar"), F.countDistinct("x.source").alias("n_sources"))


@query("SELECT a.rn, a.id AS post_id, b.id AS trend_id FROM (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM processed_posts) a JOIN (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM detected_trends) b USING (rn)")
def positional_join(spark, d):
    """Rows of two tables by their place in the order of the ids."""
    a, b = (numbered(table(spark, d, n).select("id"), "rn", "id") for n in ("processed_posts", "detected_trends"))
    return a.withColumnRenamed("id", "post_id").join(b.withColumnRenamed("id", "trend_id"), "rn").select("rn", "post_id", "trend_id")


@query("SELECT CAST(count_if(h) AS BIGINT) AS n_hits, CAST(count_if(NOT h) AS BIGINT) AS n_misses FROM (SELECT md5(content) IN (SELECT md5(content) FROM processed_posts WHERE content IS NOT NULL) AS h FROM posts_stream_v1 WHERE content IS NOT NULL)")
def cache_hits(spark, d):
    """Messages whose text was handled before, by its hash."""
    known = table(spark, d, "processed_posts").where("content IS NOT NULL").select(F.md5("content").alias("h")).distinct().withColumn("hit", F.lit(True))
    m = table(spark, d, "posts_stream_v1").where("content IS NOT NULL").select(F.md5("content").alias("h")).join(known, "h", "left")
    return m.agg(F.count("hit").alias("n_hits"), F.count_if(F.col("hit").isNull()).alias("n_misses"))


@query(f"SELECT topic, CAST(n * (n - 1) / 2 AS BIGINT) AS n_pairs FROM (SELECT topic, count(*) AS n FROM {_PT} GROUP BY topic) WHERE n > 1")
def positive_pairs(spark, d):
    """Pairs of posts of one topic, counted and not formed."""
    n = _topics(spark, d).groupBy("topic").agg(F.count("*").alias("n")).where("n > 1")
    return n.select("topic", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("n_pairs"))


@query(f"SELECT key, count(*) AS n_rows, CAST(sum(volume) AS BIGINT) AS volume, min(id) AS id FROM (SELECT id, volume, {_FOLD.format('trend_name')} AS key FROM detected_trends WHERE trend_name IS NOT NULL) GROUP BY key")
def merged_dictionary(spark, d):
    """Trends by their name without case and accents: volumes added."""
    t = table(spark, d, "detected_trends").where("trend_name IS NOT NULL").select("id", "volume", fold(F.col("trend_name")).alias("key"))
    return t.groupBy("key").agg(F.count("*").alias("n_rows"), F.sum("volume").alias("volume"), F.min("id").alias("id"))


@query("SELECT s.msg_id, p.id FROM (SELECT msg_id, substr(content, 1, 100) AS k FROM posts_stream_v1 WHERE length(content) >= 100) s JOIN (SELECT substr(content, 1, 100) AS k, min(id) AS id FROM processed_posts WHERE length(content) >= 100 GROUP BY 1) p USING (k)")
def reidentified(spark, d):
    """Messages and handled posts that share their first 100 characters."""
    k = F.substring("content", 1, 100).alias("k")
    p = table(spark, d, "processed_posts").where(F.length("content") >= 100).groupBy(k).agg(F.min("id").alias("id"))
    return table(spark, d, "posts_stream_v1").where(F.length("content") >= 100).select("msg_id", k).join(p, "k").select("msg_id", "id")


_ORDER = ("T1", "T2", "T3", "T6", "T4", "T5", "T7")


@query(f"SELECT topic, list_extract({list(_ORDER)}, coalesce(min(nullif(list_position({list(_ORDER)}, category), 0)), 7)) AS category FROM {_PT} GROUP BY topic")
def priority_categories(spark, d):
    """The category of a topic: the first in the order of priority that one of its posts has."""
    order = F.array(*map(F.lit, _ORDER))
    place = F.nullif(F.array_position(order, F.col("category")), F.lit(0))
    return _topics(spark, d).groupBy("topic").agg(F.element_at(order, F.coalesce(F.min(place), F.lit(7)).cast("int")).alias("category"))


@query(f"SELECT count(*) AS n_topics, min(n) AS least, max(n) AS most, round(median(n), 6) AS median_size, round(quantile_cont(n, 0.9), 6) AS p90, CAST(count_if(n > 100) AS BIGINT) AS n_mega, CAST(count_if(n < 10) AS BIGINT) AS n_micro FROM (SELECT topic, count(*) AS n FROM {_PT} GROUP BY topic)")
def topic_sizes(spark, d):
    """Sizes of the topics, with the 90th percentile from which one counts as large."""
    n = _topics(spark, d).groupBy("topic").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_topics"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.median("n"), 6).alias("median_size"), F.round(F.percentile("n", 0.9), 6).alias("p90"), F.count_if(F.col("n") > 100).alias("n_mega"), F.count_if(F.col("n") < 10).alias("n_micro"))


@query("SELECT round((pos - neg) / CAST(n AS DOUBLE), 6) AS polarity, n FROM (SELECT count(*) FILTER (s IN ('POS', 'POSITIVE', 'LABEL_2', 'TÍCH CỰC')) AS pos, count(*) FILTER (s IN ('NEG', 'NEGATIVE', 'LABEL_0', 'TIÊU CỰC')) AS neg, count(s) AS n FROM (SELECT upper(trim(sentiment)) AS s FROM processed_posts))")
def polarity(spark, d):
    """Positive less negative posts among those with a sentiment."""
    p = table(spark, d, "processed_posts").select("sentiment", sentiment_label(F.col("sentiment")).alias("l"))
    x = p.agg(F.count_if(F.col("l") == "Positive").alias("p"), F.count_if(F.col("l") == "Negative").alias("g"), F.count("sentiment").alias("n"))
    return x.select(F.round((F.col("p") - F.col("g")) / F.col("n"), 6).alias("polarity"), "n")


@query(f"""WITH w AS (SELECT DISTINCT article_id, unnest({_words('title')}) AS w FROM news_articles), n AS (SELECT count(DISTINCT article_id) AS n FROM news_articles), f AS (SELECT w, count(*) AS df FROM w GROUP BY w ORDER BY df DESC, w LIMIT 10),
k AS (SELECT w.article_id, f.w, f.df FROM w JOIN f USING (w)), p AS (SELECT a.w AS a, b.w AS b, any_value(a.df) AS fa, any_value(b.df) AS fb, count(*) AS c FROM k a JOIN k b ON a.article_id = b.article_id AND a.w < b.w GROUP BY ALL)
SELECT a, b, round(CASE WHEN c = n THEN 0 ELSE ln((c / CAST(n AS DOUBLE)) / ((fa / CAST(n AS DOUBLE)) * (fb / CAST(n AS DOUBLE)))) / -ln(c / CAST(n AS DOUBLE)) END, 6) AS npmi FROM p, n""")
def word_coherence(spark, d):
    """How much more often the ten most frequent headline words stand together than by chance."""
    a = table(spark, d, "news_articles")
    w = a.select("article_id", F.explode(F.array_distinct(tokens(F.col("title")))).alias("w")).distinct()
    n = a.agg(F.countDistinct("article_id").alias("n"))
    top = w.groupBy("w").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "w").limit(10)
    k = w.join(F.broadcast(top), "w")  # ten rows
    p = k.select("article_id", F.col("w").alias("a"), F.col("df").alias("fa")).join(k.select("article_id", F.col("w").alias("b"), F.col("df").alias("fb")), "article_id").where("a < b").groupBy("a", "b", "fa", "fb").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n))
    share = lambda c: F.col(c) / F.col("n")
    return p.select("a", "b", F.round(F.when(F.col("c") == F.col("n"), 0.0).otherwise(F.log(share("c") / (share("fa") * share("fb"))) / -F.log(share("c"))), 6).alias("npmi"))


@query("SELECT category, count(trend_score) AS n, round(avg(trend_score), 6) AS mean, round(stddev_samp(trend_score), 6) AS std, round(min(trend_score), 6) AS least, round(quantile_cont(trend_score, 0.5), 6) AS p50, round(quantile_cont(trend_score, 0.95), 6) AS p95, round(max(trend_score), 6) AS most FROM detected_trends GROUP BY category")
def described_scores(spark, d):
    """The scores of each category described."""
    s = F.col("trend_score")
    r = lambda c, a: F.coalesce(F.round(c, 6), F.lit(None)).alias(a)
    return table(spark, d, "detected_trends").groupBy("category").agg(F.count(s).alias("n"), r(F.avg(s), "mean"), r(F.stddev_samp(s), "std"), r(F.min(s), "least"), r(F.percentile(s, 0.5), "p50"), r(F.percentile(s, 0.95), "p95"), r(F.max(s), "most"))


@query(f"SELECT key, n, names FROM (SELECT {_FOLD.format('trend_name')} AS key, count(*) AS n, count(DISTINCT trend_name) AS names FROM detected_trends WHERE trend_name IS NOT NULL GROUP BY 1) WHERE n > 1")
def name_collisions(spark, d):
    """Trends that share a name without case and accents."""
    t = table(spark, d, "detected_trends").where("trend_name IS NOT NULL").groupBy(fold(F.col("trend_name")).alias("key"))
    return t.agg(F.count("*").alias("n"), F.countDistinct("trend_name").alias("names")).where("n > 1")


@query("SELECT subject, count(*) AS n, round((SELECT count(*) FROM subject_labels) / (CAST(count(*) AS DOUBLE) * (SELECT count(DISTINCT subject) FROM subject_labels)), 6) AS weight FROM subject_labels GROUP BY subject")
def class_weights(spark, d):
    """Weights that balance the hand labels."""
    n = table(spark, d, "subject_labels").groupBy("subject").agg(F.count("*").alias("n"))
    t = n.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    return n.crossJoin(F.broadcast(t)).select("subject", "n", F.round(F.col("t") / (F.col("n") * F.col("k")), 6).alias("weight"))


@query()
def split_labels(spark, d):
    """A split of the hand labels by a hash of the id: nine tenths to train, in every subject alike."""
    part = F.when(F.pmod(F.xxhash64("post_id", F.lit(42)), F.lit(10)) == 0, "test").otherwise("train")
    return table(spark, d, "subject_labels").groupBy("subject", part.alias("part")).agg(F.count("*").alias("n"))


@query(f"SELECT CAST(count_if(n > 0) AS BIGINT) AS n_covered, CAST(count_if(n = 0) AS BIGINT) AS n_uncovered FROM (SELECT t.id, count(p.topic) AS n FROM detected_trends t LEFT JOIN (SELECT DISTINCT topic FROM {_PT}) p ON p.topic = trim(regexp_replace(lower(trim(t.trend_name)), '^new:', '')) GROUP BY t.id)")
def trend_coverage(spark, d):
    """Trends with and without posts of their name."""
    p = _topics(spark, d).select("topic").distinct().withColumn("hit", F.lit(1))
    t = table(spark, d, "detected_trends").select("id", topic_of(F.col("trend_name")).alias("topic")).join(p, "topic", "left").groupBy("id").agg(F.count("hit").alias("n"))
    return t.agg(F.count_if(F.col("n") > 0).alias("n_covered"), F.count_if(F.col("n") == 0).alias("n_uncovered"))


@query(f"SELECT topic, w, n FROM (SELECT topic, w, count(*) AS n FROM (SELECT DISTINCT id, topic, unnest({_words('content')}) AS w FROM {_PT}) WHERE length(w) > 4 GROUP BY ALL) WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, w) <= 15")
def shared_words(spark, d):
    """The fifteen words that most posts of a topic share."""
    w = _topics(spark, d).select("id", "topic", F.explode(F.array_distinct(tokens(F.col("content")))).alias("w")).where(F.length("w") > 4).distinct().groupBy("topic", "w").agg(F.count("*").alias("n")).where("n >= 2")
    return w.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "w"))).where("r <= 15").select("topic", "w", "n")


@query(f"SELECT count(*) AS n, round((CAST(count(*) AS DOUBLE) * count(*) * any_value(q) - count(*)) / (CAST(count(*) AS DOUBLE) * (count(*) - 1)), 6) AS mean_cosine FROM embeddings, (SELECT sum(m * m) AS q FROM (SELECT avg(embedding[i] / sqrt({_dot('embedding', 'embedding')})) AS m FROM embeddings, range(1, {SIZE + 1}) r(i) GROUP BY i))")
def mean_pairwise(spark, d):
    """The mean cosine over all pairs of vectors, in closed form."""
    x = agreement.cohesion(table(spark, d, "embeddings").withColumn("all", F.lit(1)), "all", "embedding", SIZE)
    return x.select("n", F.round("avg_pairwise", 6).alias("mean_cosine"))


@query(f"""WITH {_CENT}, w AS (SELECT label, count(*) AS n, avg({_dot('a', 'a')}) AS aa, any_value({_dot('b', 'b')}) AS bb, avg(sqrt(greatest(0, {_dot('a', 'a')} - 2 * {_dot('a', 'b')} + {_dot('b', 'b')}))) AS spread FROM s WHERE own = label GROUP BY label),
g AS (SELECT sum(m * m) AS gg FROM (SELECT avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, {SIZE + 1}) r(i) GROUP BY i)), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * (aa - bb)) AS inside, sum(n * bb) AS sb FROM w),
r AS (SELECT x.label, max((wx.spread + wy.spread) / sqrt({_dot('x.v', 'x.v')} - 2 * {_dot('x.v', 'y.v')} + {_dot('y.v', 'y.v')})) AS r FROM c x, c y, w wx, w wy WHERE x.label <> y.label AND wx.label = x.label AND wy.label = y.label GROUP BY x.label)
SELECT round((SELECT avg(r) FROM r), 6) AS davies_bouldin, round(((sb - n * gg) / (k - 1)) / (inside / (n - k)), 6) AS calinski_harabasz FROM t, g""")
def shape_indices(spark, d):
    """Davies-Bouldin and Calinski-Harabasz of the labels, from sums and centroids."""
    e = table(spark, d, "embeddings")
    c = matching.centroids(e, "label", "embedding", SIZE)
    v, m = F.col("embedding"), F.col("centroid")
    gap = F.sqrt(F.greatest(F.lit(0.0), vectors.dot(v, v) - 2 * vectors.dot(v, m) + vectors.dot(m, m)))
    w = e.join(c.select("label", "centroid"), "label").groupBy("label").agg(F.count("*").alias("n"), F.avg(vectors.dot(v, v)).alias("aa"), F.first(vectors.dot(m, m)).alias("bb"), F.avg(gap).alias("spread"), F.first("centroid").alias("c"))
    g = e.agg(vectors.mean_vector(v, SIZE).alias("g")).select(vectors.dot(F.col("g"), F.col("g")).alias("gg"))
    t = w.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (F.col("aa") - F.col("bb"))).alias("inside"), F.sum(F.col("n") * F.col("bb")).alias("sb"), F.collect_list(F.struct("label", "spread", "c")).alias("all"))
    near = lambda a, b: F.sqrt(vectors.dot(a["c"], a["c"]) - 2 * vectors.dot(a["c"], b["c"]) + vectors.dot(b["c"], b["c"]))
    worst = F.transform("all", lambda a: F.array_max(F.transform(F.filter("all", lambda b: b["label"] != a["label"]), lambda b: (a["spread"] + b["spread"]) / near(a, b))))
    x = t.crossJoin(F.broadcast(g)).select("*", worst.alias("worst"))
    return x.select(F.round(F.aggregate("worst", F.lit(0.0), lambda s, y: s + y) / F.col("k"), 6).alias("davies_bouldin"), F.round(((F.col("sb") - F.col("n") * F.col("gg")) / (F.col("k") - 1)) / (F.col("inside") / (F.col("n") - F.col("k"))), 6).alias("calinski_harabasz"))


@query("SELECT id, similarity FROM (SELECT id, round(trend_score / 100, 6) AS similarity FROM (SELECT * FROM detected_trends ORDER BY last_updated DESC, id LIMIT 50)) ORDER BY similarity DESC NULLS LAST, id LIMIT 3")
def top_of_recent(spark, d):
    """The three highest of the fifty newest trends: the order of the two limits matters."""
    recent = table(spark, d, "detected_trends").orderBy(F.desc("last_updated"), "id").limit(50)
    return recent.select("id", F.round(F.col("trend_score") / 100, 6).alias("similarity")).orderBy(F.col("similarity").desc_nulls_last(), "id").limit(3)


@query("SELECT id, post_count FROM detected_trends ORDER BY post_count DESC, id LIMIT 5 OFFSET 5")
def second_page(spark, d):
    """The second page of five trends."""
    return table(spark, d, "detected_trends").select("id", "post_count").orderBy(F.desc("post_count"), "id").offset(5).limit(5)


@query(f"SELECT topic, count(*) AS post_count, 10 + count(*) AS score FROM {_PT} GROUP BY topic HAVING count(*) >= 2")
def trends_of_topics(spark, d):
    """Topics of at least two posts as new trends."""
    n = _topics(spark, d).groupBy("topic").agg(F.count("*").alias("post_count")).where("post_count >= 2")
    return n.select("topic", "post_count", (10 + F.col("post_count")).alias("score"))


@query("SELECT event_type, count(DISTINCT user_id) AS n_users, count(DISTINCT user_id) >= 10 AS promoted FROM events GROUP BY event_type")
def promoted_kinds(spark, d):
    """Kinds of events that enough different users had."""
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users")).withColumn("promoted", F.col("n_users") >= 10)


@query("SELECT b, a_n, b_n, b_n > 1.2 * a_n AS grown FROM (SELECT source AS b, count(*) FILTER (msg_id <= m / 2) AS a_n, count(*) AS b_n FROM posts_stream_v1, (SELECT max(msg_id) AS m FROM posts_stream_v1) WHERE source IS NOT NULL GROUP BY source)")
def grown_sources(spark, d):
    """Sources that grew by more than a fifth since the middle of the stream."""
    s = table(spark, d, "posts_stream_v1")
    m = s.agg((F.max("msg_id") / 2).alias("m"))
    g = s.where("source IS NOT NULL").crossJoin(F.broadcast(m)).groupBy(F.col("source").alias("b")).agg(F.count(F.when(F.col("msg_id") <= F.col("m"), 1)).alias("a_n"), F.count("*").alias("b_n"))
    return g.withColumn("grown", F.col("b_n") > 1.2 * F.col("a_n"))


@query()
def density_labels(spark, d):
    """Density clusters of the vectors within each label, by size."""
    x = density.density_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", "label", radius=1.15, least_cohesion=0.2)
    return x.groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def plane_map(spark, d):
    """The vectors on their two main axes, with the share of variance that those hold."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    m = PCA(k=2, inputCol="v", outputCol="p").fit(e)
    return m.transform(e).select("vec_id", vector_to_array("p").alias("p"), F.lit(float(m.explainedVariance.toArray().sum())).alias("share"))


_TOPIC_WORDS = f"""t AS (SELECT topic, w, count(*) AS tf FROM (SELECT topic, unnest({_words('content')}) AS w FROM {_PT}) GROUP BY ALL), n AS (SELECT count(DISTINCT topic) AS N FROM t),
f AS (SELECT w, count(*) AS df FROM t GROUP BY w), x AS (SELECT topic, w, tf * (ln((1 + N) / (1 + df)) + 1) AS x FROM t JOIN f USING (w), n WHERE df >= 1 AND df <= N * 0.5),
y AS (SELECT topic, w, round(x / sqrt(sum(x * x) OVER (PARTITION BY topic)), 6) AS weight FROM x)"""


@query(f"WITH {_TOPIC_WORDS} SELECT topic, string_agg(w, ' ' ORDER BY r) AS name FROM (SELECT topic, w, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, w) AS r FROM y) WHERE r <= 2 GROUP BY topic")
def topic_names(spark, d):
    """The two words that mark each topic's posts, as its name."""
    words = _topics(spark, d).select("topic", F.explode(tokens(F.col("content"))).alias("word"))
    w = matching.tf_idf(words, "topic", "word", least_docs=1, most_share=0.5).withColumn("weight", F.round("weight", 6))
    two = w.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "w"))).where("r <= 2")
    return two.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]), " ").alias("name"))


@query(f"SELECT id, min(id) OVER (PARTITION BY {_FOLD.format('trend_name')}) AS first_id FROM detected_trends WHERE trend_name IS NOT NULL")
def consolidated_names(spark, d):
    """Each trend with the smallest id of its name."""
    t = table(spark, d, "detected_trends").where("trend_name IS NOT NULL").select("id", fold(F.col("trend_name")).alias("key"))
    return t.join(t.groupBy("key").agg(F.min("id").alias("first_id")), "key").select("id", "first_id")


@query(f"""WITH h AS (SELECT {_T} AS topic, msg_id > (SELECT max(msg_id) / 2 FROM posts_stream_v1) AS late, interaction FROM posts_stream_v1),
a AS (SELECT topic, count(*) AS n, sum(interaction) AS s FROM h WHERE NOT late AND topic NOT IN {NO_TOPIC} GROUP BY topic), b AS (SELECT topic, count(*) AS n, sum(interaction) AS s FROM h WHERE late AND topic NOT IN {NO_TOPIC} GROUP BY topic)
SELECT topic, coalesce(b.n, 0) - coalesce(a.n, 0) AS more_posts, CAST(coalesce(b.s, 0) - coalesce(a.s, 0) AS BIGINT) AS more_interactions FROM a FULL JOIN b USING (topic)""")
def state_deltas(spark, d):
    """What the second half of the stream has more of than the first, by topic."""
    s = table(spark, d, "posts_stream_v1").withColumn("topic", topic_of(F.col("final_topic"))).where("topic IS NOT NULL")
    half = table(spark, d, "posts_stream_v1").agg((F.max("msg_id") / 2).alias("half"))
    sign = F.when(F.col("msg_id") > F.col("half"), 1).otherwise(-1)
    return s.crossJoin(F.broadcast(half)).groupBy("topic").agg(F.sum(sign).alias("more_posts"), F.sum(sign * F.coalesce("interaction", F.lit(0))).alias("more_interactions"))


@query("SELECT category, CASE category WHEN 'the-thao' THEN 'T5' WHEN 'giai-tri' THEN 'T5' WHEN 'suc-khoe' THEN 'T2' WHEN 'giao-duc' THEN 'T2' WHEN 'phap-luat' THEN 'T6' WHEN 'kinh-te' THEN 'T4' WHEN 'du-lich' THEN 'T7' ELSE 'Unclassified' END AS code, count(*) AS n FROM processed_posts GROUP BY ALL")
def category_slugs(spark, d):
    """Category slugs with their codes."""
    codes = {"the-thao": "T5", "giai-tri": "T5", "suc-khoe": "T2", "giao-duc": "T2", "phap-luat": "T6", "kinh-te": "T4", "du-lich": "T7"}
    known = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return table(spark, d, "processed_posts").groupBy("category").agg(F.count("*").alias("n")).select("category", F.coalesce(F.try_element_at(known, "category"), F.lit("Unclassified")).alias("code"), "n")


@query(f"""WITH l AS ({_MATCH_SQL['label_agreement']}), t AS ({_MATCH_SQL['topic_agreement']}), a AS (UNPIVOT l ON COLUMNS(*) INTO NAME metric VALUE value), b AS (UNPIVOT t ON COLUMNS(*) INTO NAME metric VALUE value)
SELECT metric, CASE WHEN (CASE WHEN metric = 'entropy' THEN -a.value ELSE a.value END) >= (CASE WHEN metric = 'entropy' THEN -b.value ELSE b.value END) THEN 'labels' ELSE 'topics' END AS best FROM a JOIN b USING (metric)""")
def best_metrics(spark, d):
    """Which of two groupings is better by each measure of agreement; of entropy less is better."""
    from trendloom.plans.match_queries import label_agreement, topic_agreement

    both = label_agreement(spark, d).withColumn("run", F.lit("labels")).unionByName(topic_agreement(spark, d).withColumn("run", F.lit("topics")))
    long = both.unpivot("run", [c for c in both.columns if c != "run"], "metric", "value")
    return long.groupBy("metric").agg(F.max_by("run", F.when(F.col("metric") == "entropy", -F.col("value")).otherwise(F.col("value"))).alias("best"))


@query(f"""WITH a AS (SELECT url, min(concat_ws(' ', title, short_description)) AS x FROM news_articles GROUP BY url), b AS ({_BM25}), w AS (SELECT row_id, list(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{3,}}') ORDER BY bm25 DESC, url) AS xs FROM b JOIN a USING (url) GROUP BY row_id),
e AS (SELECT row_id, f[i] AS w, i FROM (SELECT row_id, flatten(xs) AS f FROM w), range(1, 2000) r(i) WHERE i <= len(f)), k AS (SELECT row_id, w, min(i) AS i FROM e GROUP BY ALL) SELECT row_id, list(w ORDER BY i) AS terms FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY i) <= 10) GROUP BY row_id""")
def feedback_terms(spark, d):
    """Ten further terms for each search from its three best articles, in the order of the articles' words."""
    from trendloom.plans.match_queries import bm25_articles

    a = table(spark, d, "news_articles").groupBy("url").agg(F.min(F.concat_ws(" ", "title", "short_description")).alias("x"))
    w = bm25_articles(spark, d).join(a, "url").select("row_id", F.struct(-F.col("bm25"), "url", "x").alias("k"))
    texts = w.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list("k")), lambda s: s["x"]).alias("xs"))  # three texts at most
    return texts.select("row_id", F.slice(F.array_distinct(F.flatten(F.transform("xs", lambda x: tokens(x, 3)))), 1, 10).alias("terms"))


@query("""WITH w AS (SELECT article_id, list_distinct(list_filter(regexp_extract_all(lower(title), '[\\p{L}\\p{M}\\p{N}_]{3,}'), lambda x: NOT regexp_matches(x, '^\\d+$'))) AS ws FROM news_articles)
SELECT article_id, list_slice(list_transform(list_sort(list_transform(ws, lambda x: struct_pack(n := -length(x), w := x))), lambda x: x.w), 1, 5) AS keywords FROM w""")
def post_keywords(spark, d):
    """Up to five keywords of each article's headline: its longest words, each once."""
    w = F.array_distinct(F.filter(tokens(F.col("title"), 3), lambda x: ~x.rlike(r"^\d+$")))
    ranked = F.array_sort(F.transform(w, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w"))))
    return table(spark, d, "news_articles").select("article_id", F.slice(F.transform(ranked, lambda x: x["w"]), 1, 5).alias("keywords"))


@query()
def staged_stories(spark, d):
    """Stories in three steps: news by density within their topic, social posts attached to the nearest story, the rest by density.

    The labels of the last step follow those of the first; posts in none have -1.
    """
    size = 96
    sites = table(spark, d, "source_sites").select("source", "kind")
    usable = (F.size("embedding") == size) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    p = _topics(spark, d).join(sites, "source").where(F.coalesce(usable, F.lit(False))).select("id", "topic", "kind", vectors.unit(F.col("embedding")).alias("v"))
    own = density.density_clusters(p.where("kind = 'news'"), "id", "v", "topic", radius=0.8, most_size=5000, least_cohesion=0.0).where("cluster >= 0")
    named = own.withColumn("story", F.concat_ws("#", F.col("topic"), F.col("cluster").cast("string"))).select("id", "story")
    centres = matching.centroids(named.join(p, "id"), "story", "v", size)
    near = matching.top_matches(p.where("kind = 'social'").select("id", "v"), centres, "id", "v", "story", "centroid", floor=0.65).select("id", "story")
    rest = p.where("kind = 'social'").join(near, "id", "left_anti")
    late = density.density_clusters(rest, "id", "v", "topic", radius=0.8, most_size=5000, least_cohesion=0.0)
    late = late.select("id", F.when(F.col("cluster") >= 0, F.concat_ws("#", F.col("topic"), F.lit("rest"), F.col("cluster").cast("string"))).alias("story"))
    return named.unionByName(near).unionByName(late).groupBy("story").agg(F.count("*").alias("n"))
