"""Readers over the small files of ``sources/fixtures``, and posts assigned in phases as a batch and as a stream."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions.text import topic_of
from trendloom.operators import pipeline
from trendloom.plans.match_queries import _NO, _POSTS, _TOPIC, _dot
from trendloom.session import own_folder, table
from trendloom.sources import readers
from trendloom.streaming import jobs

FIXTURES = f"file://{Path(readers.__file__).parent / 'fixtures'}"
SIZE = 96


def read_social(spark: SparkSession, d: str) -> DataFrame:
    """Posts of a JSON array: those of twenty characters and more, with their counts."""
    return readers.social_posts(spark, f"{FIXTURES}/social.json").select("content", "source", "time", "url", F.col("stats.likes").alias("likes"), F.col("stats.comments").alias("comments"), F.col("stats.shares").alias("shares"))


def read_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles of a CSV file with lines within fields; the source is the folder."""
    return readers.news_articles(spark, f"{FIXTURES}/daily/articles.csv").select("article_id", "title", "source", "text")


def read_searches(spark: SparkSession, d: str) -> DataFrame:
    """Search trends of several exports, the newest of each."""
    return readers.search_trends(spark, f"{FIXTURES}/trends_*.csv").select("trend", "volume", F.size("keywords").alias("n_keywords"), F.date_format("file_time", "yyyy-MM-dd HH:mm").alias("file_time"))


def read_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Posts by the first of their texts that isn't empty."""
    return readers.summarised_posts(spark, f"{FIXTURES}/summaries.csv").select("content", "source", "url", "time", "interaction")


def read_labels(spark: SparkSession, d: str) -> DataFrame:
    """Hand labels of a file with a mark before its header."""
    return readers.labelled_rows(spark, f"{FIXTURES}/labels.csv")


def read_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Word vectors of a text file."""
    return readers.word_vectors(spark, f"{FIXTURES}/vectors.txt").select("word", F.transform("vector", lambda x: F.round(x.cast("double"), 6)).alias("vector"))


def read_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first two objects of a file with one on each line."""
    return readers.json_lines(spark, f"{FIXTURES}/rows.jsonl", "text string, label string", 2)


def read_named(spark: SparkSession, d: str) -> DataFrame:
    """Trends of a file that is one object of objects."""
    return readers.named_objects(spark, f"{FIXTURES}/trends.json", "keywords array<string>, volume long").select("name", "volume", F.size("keywords").alias("n_keywords"))


def file_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What each file holds, by its header."""
    names = ("daily/articles.csv", "summaries.csv", "labels.csv", "trends_20250102-0930.csv")
    return spark.createDataFrame([(n, readers.kind_of_csv(spark, f"{FIXTURES}/{n}")) for n in names], "file string, kind string")


def _posts(df: DataFrame) -> DataFrame:
    return df.select("id", "content", topic_of(F.col("final_topic")).alias("topic"), F.col("embedding").alias("v"))


def assigned_posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts assigned to trends by name, by vector, and as trends of their own; trends are the topics that have a vector."""
    p = _posts(table(spark, d, "processed_posts"))
    return pipeline.assigned(p, pipeline.trend_vectors(p, SIZE), SIZE).select("id", "phase", "trend", F.round("sim", 6).alias("sim"))


def stream_phases(spark: SparkSession, d: str) -> DataFrame:
    """Posts of a stream assigned in phases, batch by batch, counted by phase."""
    base = own_folder(spark, "phases")
    trends = pipeline.trend_vectors(_posts(table(spark, d, "processed_posts")), SIZE)
    s = jobs.file_messages(spark, f"{d}/processed_post[s].parquet", table(spark, d, "processed_posts").schema)
    jobs.run_to_end(s, "append", lambda b, n: pipeline.assigned(_posts(b), trends, SIZE).write.mode("overwrite").parquet(f"{base}/batch={n}"))
    return spark.read.schema("id long, phase string, trend string, sim double").parquet(f"{base}/batch=*").groupBy("phase").agg(F.count("*").alias("n"))


QUERIES = {
    "read_social": read_social, "read_articles": read_articles, "read_searches": read_searches, "read_summaries": read_summaries, "read_labels": read_labels, "read_vectors": read_vectors,
    "read_lines": read_lines, "read_named": read_named, "file_kinds": file_kinds, "assigned_posts": assigned_posts, "stream_phases": stream_phases,
}
_COS = f"round({_dot('{a}', '{b}', 96)} / greatest(sqrt({_dot('{a}', '{a}', 96)}) * sqrt({_dot('{b}', '{b}', 96)}), 1e-8), 9)"


def _cos(a: str, b: str) -> str:
    return _COS.format(a=a, b=b)


_PHASES = f"""WITH RECURSIVE {_POSTS}, named AS (SELECT p.id, CASE WHEN c.topic IS NULL THEN 'new name' ELSE 'named' END AS phase, p.topic AS trend, CASE WHEN c.topic IS NULL THEN 1.0 ELSE 0.95 END AS sim FROM (SELECT id, {_TOPIC.format('final_topic')} AS topic FROM processed_posts) p LEFT JOIN c USING (topic) WHERE p.topic NOT IN {_NO}),
near AS MATERIALIZED (SELECT p.id, c.topic AS trend, {_cos('p.e', 'c.v')} AS sim FROM p, c WHERE p.topic IS NULL QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY sim DESC, c.topic) = 1),
rest AS MATERIALIZED (SELECT id, content, list_transform(e, lambda x: CAST(x AS DOUBLE)) AS e FROM p WHERE topic IS NULL AND id NOT IN (SELECT id FROM near WHERE sim >= 0.65)),
edge AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM rest a JOIN rest b ON a.id <> b.id WHERE {_cos('a.e', 'b.e')} >= 0.65), reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a), m AS (SELECT component, list(x ORDER BY i) AS v FROM (SELECT component, i, avg(e[i]) AS x FROM comp JOIN rest USING (id), range(1, 97) r(i) GROUP BY ALL) GROUP BY component),
own AS (SELECT component, id, content, {_cos('e', 'v')} AS sim FROM comp JOIN rest USING (id) JOIN m USING (component) WHERE {_cos('e', 'v')} >= 0.65 QUALIFY count(*) OVER (PARTITION BY component) >= 3),
story AS (SELECT component, arg_max(content, ROW(sim, -id)) AS content FROM own GROUP BY component HAVING avg(sim) >= 0.75)
SELECT id, phase, trend, round(sim, 6) AS sim FROM (SELECT * FROM named UNION ALL SELECT id, 'vector', trend, sim FROM near WHERE sim >= 0.65 UNION ALL
SELECT id, 'discovered', 'New: ' || CASE WHEN length(story.content) > 30 THEN substr(story.content, 1, 30) || '...' ELSE story.content END, sim FROM own JOIN story USING (component))"""
SQL = {
    "read_social": "SELECT * FROM (VALUES ('Mưa lớn gây ngập nhiều tuyến phố trong sáng nay', 'Face: Tin phố', '3 giờ', 'http://s.example/1', 12, 3, 1), ('Chợ hoa xuân khai mạc vào cuối tuần này', 'Face: Chợ', 'Hôm qua', 'http://s.example/2', 1200, 5, 0)) t(content, source, time, url, likes, comments, shares)",
    "read_articles": "SELECT * FROM (VALUES ('a1', 'Cầu mới thông xe', 'DAILY', 'Cầu mới thông xe' || chr(10) || 'Dòng một' || chr(10) || 'Dòng hai'), ('a2', 'Giá \"vàng\" tăng', 'DAILY', 'Giá \"vàng\" tăng' || chr(10) || 'Nội dung')) t(article_id, title, source, text)",
    "read_searches": "SELECT * FROM (VALUES ('bão số 3', 50000, 2, '2025-01-02 09:30'), ('giá vàng', 2000000, 2, '2025-01-03 09:30')) t(trend, volume, n_keywords, file_time)",
    "read_summaries": "SELECT * FROM (VALUES ('Tóm tắt', 'Báo', 'http://m.example/1', '2025-01-02', 6), ('Chỉ nội dung', 'Báo', 'http://m.example/2', NULL, 4)) t(content, source, url, time, interaction)",
    "read_labels": "SELECT * FROM (VALUES (1, 5), (2, -1)) t(id, label)",
    "read_vectors": "SELECT * FROM (VALUES ('mưa', [0.5, -1.0, 2.0]), ('nắng', [0.1, 0.0, 3.0])) t(word, vector)",
    "read_lines": "SELECT * FROM (VALUES ('một', 'T1'), ('hai', 'T2')) t(text, label)",
    "read_named": "SELECT * FROM (VALUES ('bão số 3', 50000, 2), ('giá vàng', 200, 0)) t(name, volume, n_keywords)",
    "file_kinds": "SELECT * FROM (VALUES ('daily/articles.csv', 'articles'), ('summaries.csv', 'summaries'), ('labels.csv', 'labels'), ('trends_20250102-0930.csv', 'searches')) t(file, kind)",
    "assigned_posts": _PHASES,
    "stream_phases": f"SELECT phase, count(*) AS n FROM ({_PHASES}) GROUP BY phase",
}
