"""Aggregates, rankings, set operations and scores: the reports of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.functions.text import source_type, topic_of
from trendloom.operators import scoring
from trendloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, d) under its name, with the SQL that must give the same."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posts_stream_v1").withColumns({"topic": topic_of(F.col("final_topic")), "kind": source_type(F.col("source"))})


_TOPIC = "trim(regexp_replace(lower(trim(final_topic)), '^new:', ''))"
_NO = "('unknown', 'unassigned', 'n/a', '', 'noise', '[noise]', 'discovery', 'none', 'null', '-1')"
_POSTS = f"(SELECT *, CASE WHEN {_TOPIC} NOT IN {_NO} THEN {_TOPIC} END AS topic, CASE WHEN source IS NULL THEN NULL WHEN contains(source, 'Face') THEN 'social' ELSE 'news' END AS kind FROM posts_stream_v1)"


@query(f"SELECT topic, count(*) AS n_posts, CAST(sum(interaction) AS BIGINT) AS interactions, count(DISTINCT source) AS n_sources FROM {_POSTS} WHERE topic IS NOT NULL GROUP BY topic HAVING count(*) >= 3")
def trend_stats(spark, d):
    """Posts, interactions and sources of each topic of at least three posts."""
    g = _posts(spark, d).where("topic IS NOT NULL").groupBy("topic")
    return g.agg(F.count("*").alias("n_posts"), F.sum("interaction").alias("interactions"), F.countDistinct("source").alias("n_sources")).where("n_posts >= 3")


@query(f"SELECT topic, count(DISTINCT CASE WHEN kind = 'news' THEN substr(content, 1, 100) END) AS n_distinct, count(*) FILTER (kind = 'news') AS n_news FROM {_POSTS} WHERE topic IS NOT NULL GROUP BY topic")
def news_per_topic(spark, d):
    """Distinct news texts by their first 100 characters, and news posts, of each topic."""
    g = _posts(spark, d).where("topic IS NOT NULL").groupBy("topic")
    return g.agg(F.countDistinct(F.when(F.col("kind") == "news", F.substring("content", 1, 100))).alias("n_distinct"), F.count_if(F.coalesce(F.col("kind") == "news", F.lit(False))).alias("n_news"))


@query(f"SELECT topic, label FROM (SELECT topic, sentiment AS label, count(*) AS n, min(id) AS first FROM (SELECT id, sentiment, {_TOPIC} AS topic FROM processed_posts) WHERE topic NOT IN {_NO} AND sentiment IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, first) = 1")
def majority_sentiment(spark, d):
    """The most frequent sentiment of each topic; of equals the one seen first."""
    p = table(spark, d, "processed_posts").select(topic_of(F.col("final_topic")).alias("topic"), F.col("sentiment").alias("label"), "id").where("topic IS NOT NULL AND label IS NOT NULL")
    n = p.groupBy("topic", "label").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return n.groupBy("topic").agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("label"))


@query(f"SELECT topic, label, round(n / sum(n) OVER (PARTITION BY topic), 6) AS share FROM (SELECT {_TOPIC} AS topic, sentiment AS label, count(*) AS n FROM processed_posts WHERE sentiment IS NOT NULL GROUP BY 1, 2) WHERE topic NOT IN {_NO}")
def sentiment_shares(spark, d):
    """Shares of the sentiments within each topic."""
    p = table(spark, d, "processed_posts").select(topic_of(F.col("final_topic")).alias("topic"), F.col("sentiment").alias("label")).where("topic IS NOT NULL AND label IS NOT NULL")
    n = p.groupBy("topic", "label").agg(F.count("*").alias("n"))
    return n.select("topic", "label", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("topic")), 6).alias("share"))


@query("SELECT category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM processed_posts GROUP BY category")
def category_counts(spark, d):
    """Posts by category as written, with their share of all."""
    n = table(spark, d, "processed_posts").groupBy("category").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("category", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("pct"))


@query("SELECT count(*) AS n_trends, round(max(trend_score), 6) AS top_score, CAST(sum(post_count) AS BIGINT) AS n_posts, CAST(count_if(trend_score > 30) AS BIGINT) AS n_active, round(avg(trend_score), 6) AS mean_score, round(median(trend_score), 6) AS median_score FROM detected_trends")
def overview(spark, d):
    """Key figures of the trend table."""
    s = F.col("trend_score")
    return table(spark, d, "detected_trends").agg(F.count("*").alias("n_trends"), F.round(F.max(s), 6).alias("top_score"), F.sum("post_count").alias("n_posts"), F.count_if(s > 30).alias("n_active"), F.round(F.avg(s), 6).alias("mean_score"), F.round(F.median(s), 6).alias("median_score"))


@query(f"SELECT topic, CASE WHEN fb > 2 * nw AND nw > 0 THEN 'social' WHEN nw > 2 * fb AND fb > 0 THEN 'news' END AS gap FROM (SELECT topic, count(*) FILTER (kind = 'social') AS fb, count(*) FILTER (kind = 'news') AS nw FROM {_POSTS} WHERE topic IS NOT NULL GROUP BY topic)")
def source_gaps(spark, d):
    """Topics that one kind of source covers more than twice as much as the other."""
    g = _posts(spark, d).where("topic IS NOT NULL").groupBy("topic").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(a) for k, a in (("social", "fb"), ("news", "nw"))])
    return g.select("topic", F.when((F.col("fb") > 2 * F.col("nw")) & (F.col("nw") > 0), "social").when((F.col("nw") > 2 * F.col("fb")) & (F.col("fb") > 0), "news").alias("gap"))


@query("SELECT round(p50, 6) AS p50, round(p90, 6) AS p90, round(p99, 6) AS p99, round(m, 6) AS mean, round(s, 6) AS std, n FROM (SELECT quantile_cont(interaction, 0.5) AS p50, quantile_cont(interaction, 0.9) AS p90, quantile_cont(interaction, 0.99) AS p99, avg(interaction) AS m, stddev_samp(interaction) AS s, count(interaction) AS n FROM posts_stream_v1)")
def engagement_quantiles(spark, d):
    """Quantiles (between values), mean and spread of the interactions."""
    p = F.percentile("interaction", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    x = table(spark, d, "posts_stream_v1").agg(p.alias("p"), F.round(F.avg("interaction"), 6).alias("mean"), F.round(F.stddev_samp("interaction"), 6).alias("std"), F.count("interaction").alias("n"))
    return x.select(*[F.round(F.col("p")[i], 6).alias(a) for i, a in enumerate(("p50", "p90", "p99"))], "mean", "std", "n")


@query("""WITH d AS (SELECT date_trunc('day', ingested_at) AS day, count(*) AS n, sum(interaction) AS s FROM posts_stream_v1 GROUP BY 1)
SELECT strftime(c.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n, CAST(coalesce(s, 0) AS BIGINT) AS interactions FROM (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS day) c LEFT JOIN d USING (day)""")
def daily_posts(spark, d):
    """Posts and interactions of each day; days without posts are kept."""
    n = table(spark, d, "posts_stream_v1").groupBy(F.to_date("ingested_at").alias("day")).agg(F.count("*").alias("n"), F.sum("interaction").alias("interactions"))
    days = n.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return days.join(n, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("interactions", F.lit(0)).alias("interactions"))


@query(f"SELECT topic, count(*) FILTER (kind = 'social') AS social, count(*) FILTER (kind = 'news') AS news FROM {_POSTS} WHERE topic IS NOT NULL GROUP BY topic")
def topic_by_kind(spark, d):
    """Posts by topic and kind of source."""
    return _posts(spark, d).where("topic IS NOT NULL").groupBy("topic").pivot("kind", ["social", "news"]).count().na.fill(0, ["social", "news"])


@query(f"SELECT round(avg(n), 6) AS mean_sources, max(n) AS most_sources, CAST(count_if(n > 1) AS BIGINT) AS n_multi, CAST(count_if(n = 1) AS BIGINT) AS n_single FROM (SELECT topic, count(DISTINCT source) AS n FROM {_POSTS} WHERE topic IS NOT NULL GROUP BY topic)")
def sources_per_topic(spark, d):
    """How many sources the topics have."""
    n = _posts(spark, d).where("topic IS NOT NULL").groupBy("topic").agg(F.countDistinct("source").alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("mean_sources"), F.max("n").alias("most_sources"), F.count_if(F.col("n") > 1).alias("n_multi"), F.count_if(F.col("n") == 1).alias("n_single"))


@query(f"SELECT round(avg(h), 6) AS mean_hours, round(max(h), 6) AS most_hours, round(greatest(0, 1 - avg(h) / 168), 6) AS coherence FROM (SELECT (epoch_us(max(ingested_at)) - epoch_us(min(ingested_at))) / 3.6e9 AS h FROM {_POSTS} WHERE topic IS NOT NULL GROUP BY topic HAVING count(*) >= 2)")
def temporal_coherence(spark, d):
    """Hours from first to last post of the topics, and 1 minus their mean in weeks."""
    us = F.unix_micros(F.col("ingested_at").cast("timestamp"))
    h = _posts(spark, d).where("topic IS NOT NULL").groupBy("topic").agg(F.count("*").alias("n"), ((F.max(us) - F.min(us)) / 3.6e9).alias("h")).where("n >= 2")
    return h.agg(F.round(F.avg("h"), 6).alias("mean_hours"), F.round(F.max("h"), 6).alias("most_hours"), F.round(F.greatest(F.lit(0.0), 1 - F.avg("h") / 168), 6).alias("coherence"))


@query("SELECT head, n, first_id FROM (SELECT substr(content, 1, 100) AS head, count(*) AS n, min(msg_id) AS first_id FROM posts_stream_v1 WHERE content IS NOT NULL GROUP BY 1) WHERE n > 1")
def prefix_duplicates(spark, d):
    """Messages that share their first 100 characters."""
    p = table(spark, d, "posts_stream_v1").where("content IS NOT NULL").groupBy(F.substring("content", 1, 100).alias("head"))
    return p.agg(F.count("*").alias("n"), F.min("msg_id").alias("first_id")).where("n > 1")


@query("SELECT bin, count(*) AS n FROM (SELECT CAST(least(floor(length(content) / 50), 19) AS BIGINT) AS bin FROM posts_stream_v1 WHERE content IS NOT NULL) GROUP BY bin")
def length_histogram(spark, d):
    """Messages by length in bins of 50 characters, the last one open."""
    p = table(spark, d, "posts_stream_v1").where("content IS NOT NULL")
    return p.select(F.least(F.floor(F.length("content") / 50), F.lit(19)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query("SELECT CAST(count_if(content IS NULL) AS BIGINT) AS n_null, CAST(count_if(trim(content) = '') AS BIGINT) AS n_blank, count(*) AS n FROM processed_posts")
def empty_audit(spark, d):
    """Posts without text."""
    return table(spark, d, "processed_posts").agg(F.count_if(F.col("content").isNull()).alias("n_null"), F.count_if(F.trim("content") == "").alias("n_blank"), F.count("*").alias("n"))


@query(f"SELECT topic, string_agg(DISTINCT source, ' | ' ORDER BY source) AS sources, min(msg_id) AS first_post FROM {_POSTS} WHERE topic IS NOT NULL GROUP BY topic")
def topic_sources(spark, d):
    """The sources of each topic in one line."""
    g = _posts(spark, d).where("topic IS NOT NULL").groupBy("topic")
    return g.agg(F.array_join(F.array_sort(F.collect_set("source")), " | ").alias("sources"), F.min("msg_id").alias("first_post")).withColumn("sources", F.nullif("sources", F.lit("")))


@query("SELECT category, id, rank FROM (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY trend_score DESC NULLS LAST, id) AS rank FROM detected_trends) WHERE rank <= 10")
def top_per_category(spark, d):
    """The ten highest trends of each category."""
    w = Window.partitionBy("category").orderBy(F.col("trend_score").desc_nulls_last(), "id")
    return table(spark, d, "detected_trends").select("category", "id", F.row_number().over(w).cast("bigint").alias("rank")).where("rank <= 10")


@query("SELECT id, trend_name, round(trend_score, 6) AS trend_score FROM detected_trends WHERE trend_score >= 30 ORDER BY last_updated DESC, id LIMIT 50")
def recent_trends(spark, d):
    """The newest 50 trends above a score."""
    return table(spark, d, "detected_trends").where("trend_score >= 30").orderBy(F.desc("last_updated"), "id").limit(50).select("id", "trend_name", F.round("trend_score", 6).alias("trend_score"))


@query("SELECT source, CASE WHEN r <= 8 THEN source ELSE 'Other' END AS shown, n FROM (SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS r FROM (SELECT source, count(*) AS n FROM posts_stream_v1 WHERE source IS NOT NULL GROUP BY source))")
def top_sources_or_other(spark, d):
    """The eight largest sources by name, the rest as Other."""
    n = table(spark, d, "posts_stream_v1").where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "source"))).select("source", F.when(F.col("r") <= 8, F.col("source")).otherwise("Other").alias("shown"), "n")


@query("SELECT url, msg_id FROM posts_stream_v1 WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY msg_id) = 1")
def first_deliveries(spark, d):
    """The first message of each address."""
    return table(spark, d, "posts_stream_v1").where("url IS NOT NULL").groupBy("url").agg(F.min("msg_id").alias("msg_id"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT url FROM news_articles) a WHERE NOT EXISTS (SELECT 1 FROM posts_stream_v1 p WHERE p.url = a.url)")
def unseen_articles(spark, d):
    """Articles that no message refers to."""
    a = table(spark, d, "news_articles").select("url").distinct()
    return a.join(table(spark, d, "posts_stream_v1").select("url"), "url", "left_anti").agg(F.count("*").alias("n"))


@query("SELECT p.msg_id, a.article_id FROM posts_stream_v1 p JOIN (SELECT url, min(article_id) AS article_id FROM news_articles GROUP BY url) a USING (url)")
def message_articles(spark, d):
    """Messages with the article that they refer to."""
    a = table(spark, d, "news_articles").groupBy("url").agg(F.min("article_id").alias("article_id"))
    return table(spark, d, "posts_stream_v1").select("msg_id", "url").join(a, "url").select("msg_id", "article_id")


@query("SELECT source FROM posts_stream_v1 INTERSECT SELECT source FROM processed_posts EXCEPT SELECT source FROM source_sites WHERE kind = 'social'")
def common_news_sources(spark, d):
    """Sources in both logs that are not social ones."""
    a, b = table(spark, d, "posts_stream_v1").select("source"), table(spark, d, "processed_posts").select("source")
    return a.intersect(b).exceptAll(table(spark, d, "source_sites").where("kind = 'social'").select("source")).distinct()


@query("SELECT source, count(*) AS n FROM (SELECT source FROM posts_stream_v1 UNION ALL SELECT source FROM processed_posts UNION ALL SELECT source FROM news_articles) GROUP BY source")
def all_sources(spark, d):
    """Rows of the three logs by source."""
    parts = [table(spark, d, n).select("source") for n in ("posts_stream_v1", "processed_posts", "news_articles")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count("*").alias("n"))


_LOG = "CASE WHEN {v} > 0 THEN least(100, 100 * log10({v} + 1) / log10({c} + 1)) ELSE 0 END"
_GFN = f"SELECT id, {_LOG.format(v='CAST(google_vol AS DOUBLE)', c=1e6)} AS g, {_LOG.format(v='CAST(interactions AS DOUBLE)', c=2e4)} AS f, {_LOG.format(v='CAST(post_count AS DOUBLE)', c=10)} AS n, abs(epoch_us(last_updated) - epoch_us(created_at)) / 8.64e10 AS days FROM detected_trends"
_SYN = "CASE CAST(g > 10 AS INT) + CAST(f > 10 AS INT) + CAST(n > 10 AS INT) WHEN 3 THEN 1.2 WHEN 2 THEN 1.1 ELSE 1.0 END"


def _components(spark, d):
    t = table(spark, d, "detected_trends")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    c = scoring.BATCH
    return t.select("id", "google_vol", "interactions", "post_count", ((us("last_updated") - us("created_at")) / 8.64e10).alias("days"), scoring.log_score(F.col("google_vol"), c.g).alias("g"), scoring.log_score(F.col("interactions"), c.f).alias("f"), scoring.log_score(F.col("post_count"), c.n).alias("n"))


@query(f"SELECT id, round(least(100, (0.40 * g + 0.35 * f + 0.25 * n) * {_SYN} * pow(0.8, days)), 6) AS score FROM ({_GFN})")
def unified_scores(spark, d):
    """The full score of every trend, with synergy and decay over its age."""
    return _components(spark, d).select("id", F.round(scoring.unified(F.col("google_vol"), F.col("interactions"), F.col("post_count"), F.col("days")), 6).alias("score"))


@query(f"SELECT id, CASE WHEN f > 40 OR n > 40 OR (g > 40 AND (f > 15 OR n > 15)) THEN 'Trending' ELSE 'Emerging / Noise' END AS class, round(least(100, (0.40 * g + 0.35 * f + 0.25 * n) * {_SYN}), 6) AS score FROM ({_GFN})")
def composite_scores(spark, d):
    """The score without decay, with the class of two."""
    return _components(spark, d).select("id", scoring.two_classes(F.col("g"), F.col("f"), F.col("n")).alias("class"), F.round(scoring.unified(F.col("google_vol"), F.col("interactions"), F.col("post_count")), 6).alias("score"))


@query(f"SELECT id, CASE WHEN g > 40 AND f > 40 AND n > 40 THEN 'Strong Multi-source' WHEN g > 40 AND f > 40 THEN 'Search & Social' WHEN f > 40 AND n > 40 THEN 'Social & News' WHEN f > 40 THEN 'Social-Driven' WHEN n > 40 THEN 'News-Driven' WHEN g > 40 THEN 'Search-Driven' ELSE 'Emerging' END AS class FROM (SELECT id, g, f, least(100, 100.0 * post_count / 50) AS n FROM ({_GFN}) JOIN (SELECT id, post_count FROM detected_trends) USING (id))")
def driver_classes(spark, d):
    """Which kinds of sources drive each trend; coverage on a linear scale."""
    return _components(spark, d).select("id", scoring.seven_classes(F.col("g"), F.col("f"), scoring.linear_score(F.col("post_count"))).alias("class"))


@query(f"SELECT r.row_id, count(t.id) AS n_trends FROM google_trends r LEFT JOIN detected_trends t ON lower(trim(t.trend_name)) = lower(trim(r.trend)) GROUP BY r.row_id")
def searches_with_trends(spark, d):
    """Trends that carry each search term's name."""
    t = table(spark, d, "detected_trends").select("id", F.lower(F.trim("trend_name")).alias("name"))
    return table(spark, d, "google_trends").select("row_id", F.lower(F.trim("trend")).alias("name")).join(t, "name", "left").groupBy("row_id").agg(F.count("id").alias("n_trends"))


@query("SELECT date_part('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_by_hour(spark, d):
    """Events and their values by hour of the day and type."""
    return table(spark, d, "events").groupBy(F.hour("ts").cast("bigint").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def orders_by_nation(spark, d):
    """A star join: orders and their value by nation."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))  # before the join: one row a customer
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.sum("n").alias("n_orders"), F.round(F.sum("s"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount FROM lineitem GROUP BY ALL")
def line_summary(spark, d):
    """Lines, quantity and revenue by flag and status."""
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("mean_discount"))


@query("SELECT event_id, coalesce(prev_id, -1) AS prev_id FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_id FROM events)")
def previous_events(spark, d):
    """Each user's event before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.coalesce(F.lag("event_id").over(w), F.lit(-1)).alias("prev_id"))



