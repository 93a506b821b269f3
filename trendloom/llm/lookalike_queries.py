"""Queries of problem 6: texts that look the same but differ in their characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import lookalike
from trendloom.session import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "processed_posts").select(F.lit("processed_posts").alias("tbl"), "id", F.col("content").alias("text"))
    return posts.unionByName(table(spark, d, "detected_trends").select(F.lit("detected_trends").alias("tbl"), "id", F.col("trend_name").alias("text")))


def found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rows of one table whose texts look the same and aren't the same string."""
    return lookalike.lookalike_pairs(_texts(spark, d), "id", "text", "tbl").withColumnRenamed("by", "tbl")


def classes(spark: SparkSession, d: str) -> DataFrame:
    """The same as classes: each row of one with the smallest id of its class and of its spelling."""
    return lookalike.lookalike_classes(_texts(spark, d), "id", "text", "tbl").withColumnRenamed("by", "tbl")


def normalised(spark: SparkSession, d: str) -> DataFrame:
    """Every post text in its one consistent form."""
    return lookalike.normalise_texts(table(spark, d, "processed_posts"), "id", "content")


QUERIES = {"p6_found": found, "p6_classes": classes, "p6_normalised": normalised}
SQL: dict[str, str] = {}
