"""Queries of problem 1: texts that were cut off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import truncation
from trendloom.session import table


def _judged(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "posts_stream_v1").select(F.lit("posts_stream_v1").alias("tbl"), F.col("msg_id").alias("row_id"), F.lit(-1).alias("pos"), "source", F.col("content").alias("text"), F.lit(False).alias("broken_off"))
    items = truncation.items_of(table(spark, d, "detected_trends"), "id", "representative_posts").select(F.lit("detected_trends").alias("tbl"), "row_id", "pos", "source", "text", "broken_off")
    return truncation.find_truncated(posts.unionByName(items))


def found(spark: SparkSession, d: str) -> DataFrame:
    """The texts of posts and of trends' representative posts that were cut."""
    return _judged(spark, d).where("cut").select("tbl", "row_id", "pos")


def rates(spark: SparkSession, d: str) -> DataFrame:
    """Texts and cut texts of each source."""
    return _judged(spark, d).groupBy("tbl", "source").agg(F.count("*").alias("n_texts"), F.sum(F.col("cut").cast("int")).alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("share_cut"))


QUERIES = {"p1_found": found, "p1_rates": rates}
SQL: dict[str, str] = {}
