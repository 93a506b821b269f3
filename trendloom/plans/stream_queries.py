"""Streaming, state and clustering queries."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.operators import graph, matching
from trendloom.operators.state import StateTable, merge_names
from trendloom.session import own_folder, table
from trendloom.streaming import jobs

SIZE = 64


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return jobs.file_messages(spark, f"{d}/event[s].parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type from a stream in complete mode."""
    s = _events(spark, d).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return jobs.last_of_complete(s.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n"))


def stream_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Events in windows of two hours that begin every half hour."""
    s = _events(spark, d).groupBy(F.window("ts", "2 hours", "30 minutes")).agg(F.count("*").alias("n"))
    return jobs.last_of_complete(s.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Users' sessions with gaps under half an hour, by number of events."""
    s = _events(spark, d).groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return jobs.last_of_complete(s.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")).groupBy("n").agg(F.count("*").alias("n_sessions"))


def stream_averages(spark: SparkSession, d: str) -> DataFrame:
    """The moving average of each event type's values, kept as state."""
    base = own_folder(spark, "ema")
    s = jobs.moving_average(_events(spark, d).select("event_type", "value", "ts", "event_id"), "event_type", "value")
    jobs.run_to_end(s, "update", lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(base))
    x = spark.read.schema("event_type string, n long, ema double, batch long").parquet(base)
    return x.groupBy("event_type").agg(F.max_by("n", "batch").alias("n"), F.round(F.max_by("ema", "batch"), 6).alias("ema"))


def stream_hours(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type as a watermark of ten minutes gives them out: each hour once, when it is over."""
    s = jobs.run_to_end(jobs.tumbling_counts(_events(spark, d), "ts", "event_type"))
    return s.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def stream_unique(spark: SparkSession, d: str) -> DataFrame:
    """Users by type of event, each counted once within the watermark."""
    return jobs.run_to_end(jobs.once_each(_events(spark, d), "ts", ["user_id", "event_type"], "3650 days")).groupBy("event_type").agg(F.count("*").alias("n_users"))


def _stream_state(spark: SparkSession, d: str) -> DataFrame:
    state = StateTable(spark, own_folder(spark, "state"))
    messages = jobs.file_messages(spark, f"{d}/posts_stream_v[1].parquet", table(spark, d, "posts_stream_v1").schema, 1)
    jobs.update_trends(messages, state, table(spark, d, "detected_trends"))
    return state.current()


def stream_trend_state(spark: SparkSession, d: str) -> DataFrame:
    """The trend table after all messages: counts, interactions and score."""
    return _stream_state(spark, d).select("trend_id", "post_count", "interactions", F.round("score", 6).alias("score"), F.size("posts").alias("n_kept"))


def merged_trends(spark: SparkSession, d: str) -> DataFrame:
    """Trends of one name in any spelling of case merged into the smallest id."""
    t = table(spark, d, "detected_trends").where("trend_name IS NOT NULL")
    state = t.select(F.col("id").alias("trend_id"), F.col("trend_name").alias("name"), F.col("post_count").cast("long").alias("post_count"), "interactions", "google_vol", F.lit(0.0).alias("score"), F.array().cast("array<struct<content:string,source:string,time:string,similarity:double>>").alias("posts"))
    return merge_names(state, t.select(F.col("id").alias("trend_id"), F.lower(F.trim("trend_name")).alias("canonical"))).select("trend_id", "name", "post_count", "interactions", "google_vol")


def vector_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the graph in which each vector is tied to its nearest label centroid's vectors' smallest id."""
    e = table(spark, d, "embeddings")
    c = matching.centroids(e, "label", "embedding", SIZE)
    m = matching.top_matches(e.withColumnRenamed("label", "own"), c, "vec_id", "embedding", "label", "centroid", floor=0.2)
    first = m.groupBy("label").agg(F.min("vec_id").alias("first"))
    return graph.components(m.join(first, "label"), "vec_id", "first").withColumnsRenamed({"node": "vec_id"})


def pruned_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels after dropping members below a similarity, with the member nearest the centroid."""
    x = graph.pruned_members(table(spark, d, "embeddings"), "label", "embedding", SIZE, 0.2, 3)
    return graph.representatives(x, "label", "vec_id", "sim").withColumn("mean_sim", F.round("mean_sim", 6))


def k_means_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of ten clusters by the library's k-means, seeded."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=10, seed=42, maxIter=20).fit(e).transform(e).groupBy("prediction").agg(F.count("*").alias("n"))


def related_topics(spark: SparkSession, d: str) -> DataFrame:
    """The four labels most similar to each label, itself left out."""
    c = matching.centroids(table(spark, d, "embeddings"), "label", "embedding", SIZE)
    m = matching.top_matches(c.select(F.col("label").alias("of"), F.col("centroid").alias("v")), c, "of", "v", "label", "centroid", k=5)
    return m.where("of <> label").withColumn("sim", F.round("sim", 6)).select("of", "label", "sim")


QUERIES = {
    "stream_hours": stream_hours, "stream_unique": stream_unique, "stream_event_counts": stream_event_counts, "stream_bursts": stream_bursts, "stream_sessions": stream_sessions, "stream_averages": stream_averages, "stream_trend_state": stream_trend_state,
    "merged_trends": merged_trends, "vector_components": vector_components, "pruned_labels": pruned_labels, "k_means_sizes": k_means_sizes, "related_topics": related_topics,
}
from trendloom.plans.match_queries import _CENT, _NO, _TOPIC, _dot  # noqa: E402

SQL = {
    "stream_hours": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    "stream_unique": "SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type",
    "stream_averages": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(n) AS n, round(sum(value * CASE WHEN k = 1 THEN 1 ELSE 0.3 END * pow(0.7, n - k)), 6) AS ema FROM r GROUP BY event_type",
    "stream_event_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_bursts": "SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events, range(4) r(k) GROUP BY 1",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), z AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT n, count(*) AS n_sessions FROM z GROUP BY n",
    "stream_trend_state": f"""WITH t AS (SELECT topic, min(id) AS trend_id, arg_min(google_vol, id) AS vol FROM (SELECT *, {_TOPIC.format('trend_name')} AS topic FROM detected_trends) WHERE topic NOT IN {_NO} GROUP BY topic),
      p AS (SELECT trend_id, max(vol) AS vol, count(*) AS n FROM (SELECT {_TOPIC.format('final_topic')} AS topic FROM posts_stream_v1) JOIN t USING (topic) GROUP BY trend_id),
      c AS (SELECT *, CASE WHEN vol > 0 THEN least(100, 100 * log10(CAST(vol AS DOUBLE) + 1) / log10(5010001)) ELSE 0 END AS g, least(100, 100 * log10(10.0 * n + 1) / log10(20001)) AS f, least(100, 100 * log10(n + 1) / log10(11)) AS k FROM p)
      SELECT trend_id, n AS post_count, 10 * n AS interactions, round(least(100, (0.40 * g + 0.35 * f + 0.25 * k) * CASE CAST(g > 10 AS INT) + CAST(f > 10 AS INT) + CAST(k > 10 AS INT) WHEN 3 THEN 1.2 WHEN 2 THEN 1.1 ELSE 1.0 END), 6) AS score, CAST(least(n, 1000) AS INT) AS n_kept FROM c""",
    "merged_trends": "SELECT min(id) AS trend_id, lower(trim(trend_name)) AS name, CAST(sum(post_count) AS BIGINT) AS post_count, CAST(sum(interactions) AS BIGINT) AS interactions, max(google_vol) AS google_vol FROM detected_trends WHERE trend_name IS NOT NULL GROUP BY 2",
    "vector_components": f"WITH {_CENT}, m AS (SELECT vec_id, label FROM best WHERE sim >= 0.2) SELECT vec_id, min(vec_id) OVER (PARTITION BY label) AS component FROM m QUALIFY count(*) OVER (PARTITION BY label) > 1",
    "pruned_labels": f"WITH {_CENT}, k AS (SELECT vec_id, label, sim FROM s WHERE own = label AND sim >= 0.2 QUALIFY count(*) OVER (PARTITION BY label) >= 3) SELECT label, arg_max(vec_id, ROW(round(sim, 9), -vec_id)) AS representative, count(*) AS n, round(avg(sim), 6) AS mean_sim FROM k GROUP BY label",
    "related_topics": f"WITH {_CENT}, p AS (SELECT x.label AS of, y.label, {_dot('x.v', 'y.v')} / (sqrt({_dot('x.v', 'x.v')}) * sqrt({_dot('y.v', 'y.v')})) AS sim FROM c x, c y WHERE x.label <> y.label) SELECT of, label, round(sim, 6) AS sim FROM p QUALIFY row_number() OVER (PARTITION BY of ORDER BY sim DESC, label) <= 4",
}
