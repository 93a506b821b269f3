"""Queries of problem 2: time texts of posts as instants in UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.operators import timestamps
from trendloom.session import table

FIELDS = ("time", "created_time")


def normalised(spark: SparkSession, d: str) -> DataFrame:
    """Every time text of the stream with its instant, or null where it names none."""
    return timestamps.normalise_timestamps(table(spark, d, "posts_stream_v1"), table(spark, d, "source_sites"), "msg_id", FIELDS)


def found(spark: SparkSession, d: str) -> DataFrame:
    """The time texts that name exactly one instant."""
    return normalised(spark, d).where("utc_us IS NOT NULL").select("msg_id", "field", "utc_us")


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per field: values, values with one instant, and values without."""
    x = normalised(spark, d).groupBy("field")
    return x.agg(F.count("value").alias("n_values"), F.count("utc_us").alias("n_instants"), F.sum(F.when(F.col("value").isNotNull() & F.col("utc_us").isNull(), 1).otherwise(0)).alias("n_without"))


QUERIES = {"p2_found": found, "p2_coverage": coverage}
SQL: dict[str, str] = {}
