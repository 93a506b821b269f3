"""Queries of problem 3: the subjects of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import subjects
from trendloom.session import table


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign_subjects(table(spark, d, "processed_posts"), table(spark, d, "subject_labels"))


def found(spark: SparkSession, d: str) -> DataFrame:
    """Every post with each of its subjects."""
    return _assigned(spark, d).select("id", "subject")


def composition(spark: SparkSession, d: str) -> DataFrame:
    """The make-up of the log: posts and words by subject, for every subject of the list."""
    n = _assigned(spark, d).groupBy("subject").agg(F.count("*").alias("n_posts"), F.sum("n_words").alias("n_words"))
    return table(spark, d, "subject_areas").select("subject").join(n, "subject", "left").na.fill(0)


QUERIES = {"p3_found": found, "p3_composition": composition}
SQL: dict[str, str] = {}
