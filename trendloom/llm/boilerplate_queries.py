"""Queries of problem 7: lines repeated within a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trendloom.llm import boilerplate
from trendloom.session import table


def found(spark: SparkSession, d: str) -> DataFrame:
    """The lines that stand in at least 5 different posts of their source."""
    return boilerplate.find_repeated_lines(table(spark, d, "processed_posts"), date="processed_at")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Those lines per source, with the numbers of posts and of dates."""
    return boilerplate.repeated_lines(table(spark, d, "processed_posts"), "id", "source", "content", "processed_at").select("source", "line", "n_documents", "n_dates")


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every post without those lines."""
    return boilerplate.without_repeated_lines(table(spark, d, "processed_posts"), date="processed_at")


_TEXT = r"lower(regexp_replace({}, '[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+', '', 'g'))"
_KEY = r"regexp_replace(lower(regexp_replace({}, '[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+', '', 'g')), '\p{{Nd}}+(?:[.,]\p{{Nd}}+)*', '0', 'g')"
_LINES = f"""
WITH posts AS (
  SELECT id, source, content, CAST(processed_at AS DATE) AS day, {_TEXT.format("content")} AS cluster
  FROM processed_posts WHERE source IS NOT NULL AND content IS NOT NULL),
split AS (SELECT id, source, cluster, day, string_split(content, chr(10)) AS parts FROM posts),
lines AS (SELECT id, source, cluster, day, CAST(n AS INTEGER) AS line_no, parts[n] AS line FROM split, UNNEST(range(1, len(parts) + 1)) AS r(n)),
keyed AS (SELECT *, {_KEY.format("line")} AS k FROM lines),
firsts AS (SELECT source, k, cluster, min(day) AS day, min(line) AS line FROM keyed WHERE k <> '' GROUP BY ALL),
hot AS (SELECT source, k, count(*) AS n_documents, count(DISTINCT day) AS n_dates, min(line) AS line FROM firsts GROUP BY ALL HAVING count(*) >= 5)
"""
QUERIES = {"p7_found": found, "p7_lines": lines, "p7_cleaned": cleaned}
SQL = {
    "p7_found": _LINES + "SELECT id, line_no FROM keyed JOIN hot USING (source, k)",
    "p7_lines": _LINES + "SELECT source, line, n_documents, n_dates FROM hot",
    "p7_cleaned": _LINES + """, hits AS (SELECT id, line_no FROM keyed JOIN hot USING (source, k)),
      kept AS (SELECT l.id, string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (h.id IS NULL) AS cleaned, count(h.id) AS n_removed
        FROM (SELECT id, CAST(n AS INTEGER) AS line_no, parts[n] AS line FROM (SELECT id, string_split(content, chr(10)) AS parts FROM processed_posts), UNNEST(range(1, len(parts) + 1)) AS r(n)) l
        LEFT JOIN hits h ON h.id = l.id AND h.line_no = l.line_no GROUP BY l.id)
      SELECT p.id, CASE WHEN p.content IS NOT NULL THEN coalesce(k.cleaned, '') END AS cleaned, CAST(coalesce(k.n_removed, 0) AS INTEGER) AS n_removed
      FROM processed_posts p LEFT JOIN kept k ON k.id = p.id""",
}
