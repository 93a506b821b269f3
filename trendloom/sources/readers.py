"""Readers of the input files: each gives one fixed schema, whatever the spelling of the fields."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions.text import collapse, keyword_list, strip_credit, volume

SOCIAL = "text string, content string, time string, time_label string, timestamp string, pageName string, page_name string, url string, postUrl string, stats struct<likes:string,comments:string,shares:string>, likes string, comments string, shares string"
NEWS = "article_id string, url string, title string, short_description string, author string, category string, published_at string, content string"


def _count(c: Column) -> Column:
    """A count written as 12, 12.0 or 1.2K; 0 if it is none."""
    x = F.upper(F.trim(c))
    n = F.regexp_extract(x, r"^([\d.]+)", 1).try_cast("double") * F.when(x.endswith("K"), 1000).when(x.endswith("M"), 1_000_000).otherwise(1)
    return F.coalesce(n.cast("bigint"), F.lit(0).cast("bigint"))


def social_posts(spark: SparkSession, path: str, least_chars: int = 20) -> DataFrame:
    """Posts from JSON arrays of social posts: text or content, page names and counts in any of their places."""
    raw = spark.read.schema(SOCIAL).option("multiLine", True).json(path)
    text = strip_credit(collapse(F.coalesce("text", "content")))
    page = F.coalesce("pageName", "page_name", F.lit("Unknown"))
    stat = lambda k: _count(F.coalesce(F.col(f"stats.{k}"), F.col(k)))
    out = raw.select(text.alias("content"), F.concat(F.lit("Face: "), page).alias("source"), F.coalesce("time", "time_label").alias("time"), F.col("timestamp").alias("published_at"), F.coalesce("url", "postUrl").alias("url"), F.struct(*[stat(k).alias(k) for k in ("likes", "comments", "shares")]).alias("stats"))
    return out.where(F.length("content") >= least_chars)


def news_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles from CSV files with multi-line fields; the source is the folder of the file."""
    raw = spark.read.schema(NEWS).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    folder = F.upper(F.element_at(F.split(F.input_file_name(), "/"), -2))
    return raw.select("*", folder.alias("source"), F.concat_ws("\n", "title", "content").alias("text"))


def search_trends(spark: SparkSession, path: str) -> DataFrame:
    """Search trends from exported CSV files, by position; of a trend in several files the latest by the file's name wins."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if len(raw.columns) < 5:
        return spark.createDataFrame([], "trend string, volume bigint, started string, ended string, keywords array<string>, file_time timestamp")
    c = [F.col(f"`{x}`") for x in raw.columns[:5]]
    when = F.try_to_timestamp(F.regexp_extract(F.input_file_name(), r"(\d{8}-\d{4})", 1), F.lit("yyyyMMdd-HHmm"))
    x = raw.select(F.trim(c[0]).alias("trend"), volume(c[1]).alias("volume"), c[2].alias("started"), c[3].alias("ended"), keyword_list(c[4]).alias("keywords"), when.alias("file_time")).where("trend IS NOT NULL AND trend <> ''")
    last = x.groupBy("trend").agg(F.max_by(F.struct(*[k for k in x.columns if k != "trend"]), F.struct("file_time", "volume")).alias("r"))
    return last.select("trend", "r.*")


def summarised_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts from CSV files that may have a summary: the first text that isn't empty, of the summary, the title and the content."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[x.strip().lstrip("﻿").lower() for x in raw.columns])
    has = lambda k: F.nullif(F.trim(F.col(f"`{k}`")), F.lit("")) if k in raw.columns else F.lit(None).cast("string")
    total = sum((_count(has(k)) for k in ("likes", "comments", "shares", "topreactionscount")), F.lit(0))
    return raw.select(F.coalesce(has("summaried_text"), has("summary"), has("title"), has("content"), has("text")).alias("content"), F.coalesce(has("source"), has("pagename")).alias("source"), F.coalesce(has("url"), has("posturl"), has("link")).alias("url"), F.coalesce(has("published_at"), has("created_time"), has("time")).alias("time"), total.alias("interaction"))


def labelled_rows(spark: SparkSession, path: str) -> DataFrame:
    """``id, label`` of a hand-labelled CSV: header cleaned, a misspelt name understood, rows without numbers left out."""
    raw = spark.read.option("header", True).csv(path)
    names = {"grouth_truth": "label", "ground_truth": "label", "ground_truth_event_id": "label"}
    raw = raw.toDF(*[names.get(k, k) for k in (x.strip().lstrip("﻿").lower() for x in raw.columns)])
    return raw.select(F.col("id").try_cast("bigint").alias("id"), F.col("label").try_cast("bigint").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects from whole JSON files: a list, a list under posts, data, articles or items, or one object."""
    text = spark.read.option("wholetext", True).text(path)
    item = f"array<struct<{schema}>>"
    lists = [F.from_json(F.get_json_object("value", f"$.{k}"), item) for k in ("posts", "data", "articles", "items")]
    one = F.from_json("value", f"struct<{schema}>")
    every = F.coalesce(F.when(F.ltrim("value").startswith("["), F.from_json("value", item)), *lists, F.array(one))
    return text.select(F.explode(every).alias("x")).select("x.*")


def named_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``name`` and the fields of each object of a JSON file that is one object of objects."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", f"map<string,struct<{schema}>>")).alias("name", "x")).select("name", "x.*")


def json_lines(spark: SparkSession, path: str, schema: str, most: int | None = None) -> DataFrame:
    """Objects of a file with one on each line, the first ``most`` of them in the file's order if given; broken lines are null."""
    rows = spark.read.schema(schema).json(path)
    return rows if most is None else rows.limit(most)


#: Columns that tell an export of searches, articles or posts by its header, whatever their case and order.
KINDS = {"articles": {"article_id", "title"}, "summaries": {"summaried_text"}, "posts": {"pagename"}, "labels": {"ground_truth", "grouth_truth", "label"}}


def kind_of_csv(spark: SparkSession, path: str) -> str:
    """What a CSV file holds, by its header alone: articles, summaries, posts, labels or searches."""
    first = spark.read.text(path).limit(1).collect()
    names = {x.strip().strip('"').lstrip("\ufeff").lower() for x in first[0][0].split(",")} if first else set()
    return next((k for k, has in KINDS.items() if has & names == has or k == "labels" and has & names), "searches" if len(names) >= 5 else "unknown")


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word, vector`` from lines of a word and its numbers."""
    parts = F.split("value", " ")
    return spark.read.text(path).select(parts[0].alias("word"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("float")).alias("vector")).where(F.size("vector") > 0)


class _Page(HTMLParser):
    """Title, description, author, time and paragraphs of an article page."""

    SKIP = {"script", "style", "nav", "footer", "aside"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.meta, self.time, self.parts, self.skip, self.inside = "", {}, "", [], 0, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "meta" and (k := a.get("name") or a.get("property")):
            self.meta[k.lower()] = a.get("content") or ""
        elif tag == "time" and not self.time:
            self.time = a.get("datetime") or ""
        elif tag in ("p", "h1", "title") and not self.skip:
            self.inside = tag
            if tag == "p":
                self.parts.append("")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == self.inside:
            self.inside = None

    def handle_data(self, data):
        if self.skip or not self.inside:
            return
        if self.inside == "p":
            self.parts[-1] += data
        elif self.inside == "h1" or not self.title:
            self.title = data.strip() or self.title


def parse_page(text: str | None) -> dict[str, str | None]:
    """The fields of one article page; nulls for an empty one."""
    if not text:
        return {"title": None, "description": None, "author": None, "published_at": None, "content": None}
    p = _Page()
    p.feed(text)
    paragraphs = [re.sub(r"\s+", " ", x).strip() for x in p.parts]
    none = lambda x: html.unescape(x) if x else None
    return {
        "title": none(p.title or p.meta.get("og:title", "")), "description": none(p.meta.get("description") or p.meta.get("og:description", "")), "author": none(p.meta.get("author", "")),
        "published_at": none(p.time or p.meta.get("article:published_time", "")), "content": none("\n".join(x for x in paragraphs if x)),
    }


def article_pages(df: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``url`` and the fields of each page: HTML needs a parser, so the pages go through Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[["url"]].reset_index(drop=True), pd.DataFrame([parse_page(x) for x in b["html"]], columns=["title", "description", "author", "published_at", "content"])], axis=1)

    src = df.select(F.col(url).alias("url"), F.col(page).alias("html"))
    return src.mapInPandas(run, "url string, title string, description string, author string, published_at string, content string")


def latest_file(spark: SparkSession, path: str, kind: str = "csv", **options) -> DataFrame:
    """The rows of the file that was changed last; of equal times the last by name."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")  # the contents aren't read
    last = files.orderBy(F.desc("modificationTime"), F.desc("path")).first()
    if last is None:
        raise FileNotFoundError(path)
    return spark.read.options(**options).format(kind).load(last["path"])


def article_parts(text: Column) -> Column:
    """``author, lead, body`` of an article's text: what stands before a line with a date, the line after it, and the rest."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    dated = F.array_position(F.transform(lines, lambda x: x.rlike(r"\d{1,2}/\d{1,2}/\d{4}")), True)
    at = dated.cast("int")
    return F.struct(
        F.when(at > 1, F.trim(F.element_at(lines, 1))).alias("author"), F.trim(F.get(lines, at)).alias("lead"), F.array_join(F.slice(lines, at + 2, F.greatest(F.size(lines) - at - 1, F.lit(0))), "\n").alias("body")
    )
