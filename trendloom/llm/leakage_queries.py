"""Queries of problem 9: test items in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import leakage
from trendloom.session import table


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items that they hold at least half of."""
    return _cases(spark, d).select("doc_id", "item_id")


def items(spark: SparkSession, d: str) -> DataFrame:
    """Every item with the number of documents that hold it."""
    n = _cases(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return table(spark, d, "eval_items").select("item_id", "suite").join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


QUERIES = {"p9_found": found, "p9_items": items}
SQL: dict[str, str] = {}
