"""Queries of problem 8: the token ids of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import bpe
from trendloom.session import table


def ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every document by the byte-level BPE of 50,257 entries, without special tokens."""
    return bpe.encode_corpus(table(spark, d, "documents"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens by document type."""
    docs = table(spark, d, "documents")
    n = bpe.encode_corpus(docs.select("doc_id", "text")).select("doc_id", F.size("ids").alias("n"))
    return docs.select("doc_id", "doc_type").join(n, "doc_id").groupBy("doc_type").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))


QUERIES = {"p8_ids": ids, "p8_token_counts": token_counts}
SQL: dict[str, str] = {}
