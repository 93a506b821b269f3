"""Queries of problem 5: posts that tell one story."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import clusters
from trendloom.session import table


def found(spark: SparkSession, d: str) -> DataFrame:
    """Posts in a cluster of at least 3 posts."""
    members = clusters.cluster(table(spark, d, "processed_posts"), labels=("final_topic",))
    several = members.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n >= 3").select("cluster_id")
    return members.join(several, "cluster_id").select("id", "cluster_id")


def described(spark: SparkSession, d: str) -> DataFrame:
    """Those clusters with their size, their 5 most typical posts and their most frequent topic."""
    posts = table(spark, d, "processed_posts")
    members = clusters.materialise(clusters.cluster(posts, labels=("final_topic",)))
    topics = members.join(posts.select("id", "final_topic"), "id").where("final_topic IS NOT NULL").groupBy("cluster_id", "final_topic").agg(F.count("*").alias("n"))
    topic = topics.groupBy("cluster_id").agg(F.expr("max_by(final_topic, struct(n, final_topic))").alias("topic"))
    return clusters.describe(posts, members).join(topic, "cluster_id", "left")


QUERIES = {"p5_found": found, "p5_clusters": described}
SQL: dict[str, str] = {}
