"""Queries of problem 4: the posts with the most similar vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import neighbours
from trendloom.session import table

NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def vector_of(text: Column) -> Column:
    """The numbers of a vector written as text, in any spelling; null if one is NaN, infinite or null."""
    numbers = F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1)
    return F.when(~F.lower(text).rlike("nan|inf|null|none"), F.transform(numbers, lambda x: x.try_cast("float")))


def found(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar posts of every post and of every trend with a usable vector."""
    posts = table(spark, d, "processed_posts").select("id", F.col("embedding").alias("v"))
    trends = table(spark, d, "detected_trends").select(F.lit("trend").alias("src"), F.col("id").alias("src_id"), vector_of(F.col("embedding")).alias("v"), F.lit(None).cast("long").alias("own"))
    asked = posts.select(F.lit("post").alias("src"), F.col("id").alias("src_id"), "v", F.col("id").alias("own")).unionByName(trends)
    return neighbours.nearest_vectors(posts, asked, 5)


QUERIES = {"p4_found": found}
SQL: dict[str, str] = {}
