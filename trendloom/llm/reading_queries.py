"""Queries of problem 10: the reading level of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import reading
from trendloom.session import table


def found(spark: SparkSession, d: str) -> DataFrame:
    """The level of every undamaged document of at least 40 words."""
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def profile(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by document type and level: documents and characters."""
    docs = table(spark, d, "documents").select("doc_id", "doc_type", F.length("text").alias("n"))
    return docs.join(found(spark, d), "doc_id").groupBy("doc_type", "level").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chars"))


QUERIES = {"p10_found": found, "p10_profile": profile}
SQL: dict[str, str] = {}
