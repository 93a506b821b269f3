"""Lines that a source adds to many of its documents: finding them and taking them out.

Documents that repeat one another are collapsed first (one fingerprint of the whole normalised text), then each
line is counted over the distinct documents of its source, and over their publication dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_key(text: Column) -> Column:
    """What two texts share that differ only in letter case or blanks."""
    return F.lower(F.regexp_replace(text, r"[\s\p{Z}\p{Cc}\p{Cf}]+", ""))


def line_key(line: Column) -> Column:
    """What two lines share that differ only in letter case, blanks or numbers; empty for a blank line."""
    return F.regexp_replace(text_key(line), r"\p{Nd}+(?:[.,]\p{Nd}+)*", "0")


def _lines(df: DataFrame, id_col: str, source: str, content: str) -> DataFrame:
    """One row for each line that isn't blank: id, source, line_no, key (128 bits of it)."""
    key = line_key(F.col("line"))
    rows = df.where(F.col(source).isNotNull() & F.col(content).isNotNull())
    lines = rows.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), F.col("__cluster"), F.col("__date"), F.posexplode(F.split(F.col(content), "\n", -1)).alias("pos", "line"))
    return lines.withColumn("k", key).where("k <> ''").select("id", "source", "__cluster", "__date", (F.col("pos") + 1).cast("int").alias("line_no"), "line", F.xxhash64("k").alias("k1"), F.hash("k").alias("k2"))


def _prepared(df: DataFrame, content: str, date: str | None) -> DataFrame:
    # the fingerprint of a document: its text without case and blanks, so that a republished copy counts once
    return df.withColumns({"__cluster": F.xxhash64(text_key(F.col(content))), "__date": F.col(date).cast("date") if date else F.lit(None).cast("date")})


def repeated_lines(df: DataFrame, id_col: str, source: str, content: str, date: str | None = None, min_documents: int = 5) -> DataFrame:
    """``source, k1, k2, line, n_documents, n_dates``: the lines that stand in ``min_documents`` different documents of a source.

    ``line`` is one spelling (the least). The distinct (source, line, document) triples are formed map-side first,
    so a line that stands in every document of a hot source is spread over the documents' fingerprints and not
    gathered in one task; only counts meet at the line's key.
    """
    lines = _lines(_prepared(df, content, date), id_col, source, content)
    each = lines.groupBy("source", "k1", "k2", "__cluster").agg(F.min("line").alias("line"), F.min("__date").alias("__date"))
    days = each.groupBy("source", "k1", "k2", "__date").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    total = days.groupBy("source", "k1", "k2").agg(F.sum("n").alias("n_documents"), F.count("__date").alias("n_dates"), F.min("line").alias("line"))
    return total.where(F.col("n_documents") >= min_documents)


def find_repeated_lines(df: DataFrame, id_col: str = "id", source: str = "source", content: str = "content", date: str | None = None, min_documents: int = 5) -> DataFrame:
    """``id, line_no``: every line, in every document, that is repeated in its source.

    Defined cases: rows with a null source or content have none; a blank line is none; a text without line feed is
    one line; a CR before the line feed is a blank; repeated rows of one text count as one document but each gets its
    rows; an empty table gives none; other columns are not looked at.
    """
    lines = _lines(_prepared(df, content, date), id_col, source, content)
    flagged = repeated_lines(df, id_col, source, content, date, min_documents).select("source", "k1", "k2")
    return lines.join(flagged, ["source", "k1", "k2"], "left_semi").select("id", "line_no")


def without_repeated_lines(df: DataFrame, id_col: str = "id", source: str = "source", content: str = "content", date: str | None = None, min_documents: int = 5) -> DataFrame:
    """``id, cleaned, n_removed``: every document without its repeated lines; null content stays null.

    The ids must be unique: lines are taken out by id and line number.
    """
    hits = find_repeated_lines(df, id_col, source, content, date, min_documents).groupBy("id").agg(F.collect_set("line_no").alias("__drop"))
    out = df.select(F.col(id_col).alias("id"), F.col(content).alias("__text")).join(hits, "id", "left")
    kept = F.filter(F.split("__text", "\n", -1), lambda _, i: ~F.coalesce(F.array_contains("__drop", (i + 1).cast("int")), F.lit(False)))
    return out.select("id", F.concat_ws("\n", kept).alias("__c"), "__text", F.coalesce(F.size("__drop"), F.lit(0)).alias("n_removed")).select("id", F.when(F.col("__text").isNotNull(), F.col("__c")).alias("cleaned"), F.greatest("n_removed", F.lit(0)).alias("n_removed"))
