"""Text projections and filters over the posts, articles, trends and search terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.functions import text as t
from trendloom.session import table

POSTS, ARTICLES, TRENDS, SEARCHES = "processed_posts", "news_articles", "detected_trends", "google_trends"


def _lazy(name, make):
    """A query that builds its columns when it runs: columns need a session."""
    return lambda spark, d: make(table(spark, d, name))


def guard(df):
    return df.select("id", "trend_name", t.guard_reason(F.col("trend_name")).alias("reason")).where("trend_name IS NOT NULL").select("id", F.coalesce("reason", F.lit("kept")).alias("reason"))


def hashtag_counts(df):
    return df.select(F.explode(t.hashtags(F.col("content"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(15)


def keyword_counts(df):
    k = df.select(F.explode(t.keyword_list(F.col("keywords"))).alias("k")).select(F.lower("k").alias("keyword"))
    return k.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(30)


def word_counts(df):
    w = df.select(F.explode(t.tokens(F.col("title"), 3)).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)


QUERIES = {
    "fold_accents": _lazy(ARTICLES, lambda x: x.select("article_id", t.fold(F.col("title")).alias("folded"))),
    "collapse_blanks": _lazy(ARTICLES, lambda x: x.select("article_id", t.collapse(F.col("content")).alias("collapsed"))),
    "plain_urls": _lazy("posts_stream_v1", lambda x: x.select("msg_id", t.plain_url(F.col("url")).alias("plain"))),
    "url_ids": _lazy(ARTICLES, lambda x: x.select("url", F.sha1("url").alias("sha"), F.md5("url").alias("md"), (F.sha1("url") == F.col("article_id")).alias("same"))),
    "source_types": _lazy("posts_stream_v1", lambda x: x.groupBy(t.source_type(F.col("source")).alias("source_type")).agg(F.count("*").alias("n"))),
    "volumes": _lazy(SEARCHES, lambda x: x.select("row_id", t.volume(F.col("volume_text")).alias("volume"))),
    "trend_guard": _lazy(TRENDS, guard),
    "short_names": _lazy("posts_stream_v1", lambda x: x.where("content IS NOT NULL").select("msg_id", t.short_name(F.col("content")).alias("name"))),
    "hash_names": _lazy(SEARCHES, lambda x: x.select("row_id", F.when((F.length("trend") > 30) & ~F.contains("trend", F.lit(" ")), F.get(t.keyword_list(F.col("keywords")), F.lit(0))).otherwise(F.col("trend")).alias("name"))),
    "smart_queries": _lazy(TRENDS, lambda x: x.where("trend_name IS NOT NULL").select("id", t.smart_query(F.col("trend_name"), t.keyword_list(F.col("keywords"))).alias("query"))),
    "categories": _lazy(ARTICLES, lambda x: x.select("article_id", t.category(F.col("title")).alias("code"))),
    "sentiments": _lazy(ARTICLES, lambda x: x.select("article_id", t.sentiment(F.col("title")).alias("label"))),
    "sentiment_labels": _lazy(POSTS, lambda x: x.groupBy(t.sentiment_label(F.col("sentiment")).alias("label")).agg(F.count("*").alias("n"))),
    "topics": _lazy(POSTS, lambda x: x.select("id", t.topic_of(F.col("final_topic")).alias("topic"))),
    "hashtag_counts": _lazy("posts_stream_v1", hashtag_counts),
    "keyword_counts": _lazy(TRENDS, keyword_counts),
    "word_counts": _lazy(ARTICLES, word_counts),
    "garbage_keywords": _lazy(TRENDS, lambda x: x.select(F.explode(t.keyword_list(F.col("keywords"))).alias("k")).agg(F.count("*").alias("n"), F.count_if(t.garbage_keyword(F.lower("k"))).alias("n_garbage"))),
    "english_texts": _lazy(ARTICLES, lambda x: x.select("article_id", (t.english_share(F.col("title")) > 0.5).alias("english"))),
    "long_posts": _lazy(POSTS, lambda x: x.where(F.length("content") > 500).select("id", F.substring("content", 1, 256).alias("head"))),
    "text_lengths": _lazy(POSTS, lambda x: x.where(F.length("content").between(20, 799)).select("id", F.length("content").alias("n"))),
    "title_or_content": _lazy(ARTICLES, lambda x: x.select("article_id", F.when(F.length("title") >= 5, F.col("title")).otherwise(F.substring("content", 1, 100)).alias("headline"))),
    "dated_titles": _lazy(ARTICLES, lambda x: x.select("article_id", t.dated(F.concat_ws(" ", "title", "short_description")).alias("dated"))),
    "trend_status": _lazy(TRENDS, lambda x: x.select("id", (F.coalesce(F.length("summary") > 20, F.lit(False))).alias("analysed"), F.coalesce(F.col("trend_score") < 30, F.lit(True)).alias("is_noise"))),
    "work_queue": _lazy(TRENDS, lambda x: x.where((F.col("summary").isNull() | (F.trim("summary") == "")) & (F.col("post_count") >= 3)).orderBy(F.desc("post_count"), "id").limit(15).select("id", "post_count")),
}
_FOLD = "trim(regexp_replace(regexp_replace(strip_accents(lower({})), '\\p{{M}}+', '', 'g'), '\\s+', ' ', 'g'))"
_VOL = "regexp_replace(coalesce(upper(volume_text), ''), '[.,]', '', 'g')"
_KW = "CASE WHEN ltrim(keywords) LIKE '[%' THEN CAST(json_extract_string(keywords, '$[*]') AS VARCHAR[]) ELSE string_split(keywords, ',') END"
_KEYS = f"list_filter(list_transform({_KW}, lambda x: trim(x)), lambda x: x <> '')"


def _hit(k: str, c: str) -> str:
    return f"regexp_matches({c}, '(^|[^\\p{{L}}\\p{{N}}]){k}($|[^\\p{{L}}\\p{{N}}])')" if len(k) <= 3 else f"contains({c}, '{k}')"


_CATEGORY = "CASE " + " ".join(f"WHEN {' OR '.join(_hit(k, 'lower(title)') for k in keys)} THEN '{code}'" for code, keys in t.TAXONOMY) + f" ELSE '{t.NO_CATEGORY}' END"
_COUNT = lambda keys: "(" + " + ".join(f"CAST(contains(lower(title), '{k}') AS INT)" for k in keys) + ")"
_G = _FOLD.format("trend_name")
_DIG, _LET, _ALLOWED = f"length(regexp_replace({_G}, '\\P{{Nd}}', '', 'g'))", f"length(regexp_replace({_G}, '\\P{{L}}', '', 'g'))", f"length(regexp_replace({_G}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\s]', '', 'g'))"
SQL = {
    "fold_accents": f"SELECT article_id, {_FOLD.format('title')} AS folded FROM news_articles",
    "collapse_blanks": "SELECT article_id, trim(regexp_replace(content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS collapsed FROM news_articles",
    "plain_urls": "SELECT msg_id, regexp_replace(regexp_replace(url, '[#?].*$', ''), '/$', '') AS plain FROM posts_stream_v1",
    "url_ids": "SELECT url, sha1(url) AS sha, md5(url) AS md, sha1(url) = article_id AS same FROM news_articles",
    "source_types": "SELECT CASE WHEN source IS NULL THEN NULL WHEN contains(source, 'Face') THEN 'social' ELSE 'news' END AS source_type, count(*) AS n FROM posts_stream_v1 GROUP BY 1",
    "volumes": f"SELECT row_id, coalesce(try_cast(regexp_extract({_VOL}, '(\\d+)', 1) AS BIGINT), 0) * CASE WHEN regexp_matches({_VOL}, 'TR|M') THEN 1000000 WHEN regexp_matches({_VOL}, 'N|K') THEN 1000 ELSE 1 END AS volume FROM google_trends",
    "trend_guard": f"""SELECT id, CASE WHEN length(y) < 4 THEN 'short'
      WHEN trim(y) LIKE '% vs' OR (contains(y, ' vs ') AND (length(trim(split_part(y, ' vs ', 1))) < 3 OR length(trim(split_part(y, ' vs ', 2))) < 3)) THEN 'versus'
      WHEN digits >= greatest(1, floor(length(y) * 0.6)) AND letters <= 1 AND length(y) <= 6 THEN 'numeric'
      WHEN 1 - allowed / length(y) > 0.30 THEN 'symbols' WHEN regexp_matches(y, '\\d{{1,2}}[/-]\\d{{1,2}}([/-]\\d{{2,4}})?') THEN 'date'
      WHEN regexp_matches(y, '^\\d+$') THEN 'digits' ELSE 'kept' END AS reason
      FROM (SELECT id, {_G} AS y, {_DIG} AS digits, {_LET} AS letters, {_ALLOWED} AS allowed FROM detected_trends WHERE trend_name IS NOT NULL)""",
    "short_names": "SELECT msg_id, 'New: ' || CASE WHEN length(content) > 40 THEN substr(content, 1, 40) || '...' ELSE content END AS name FROM posts_stream_v1 WHERE content IS NOT NULL",
    "hash_names": f"SELECT row_id, CASE WHEN length(trend) > 30 AND NOT contains(trend, ' ') THEN ({_KEYS})[1] ELSE trend END AS name FROM google_trends",
    "categories": f"SELECT article_id, CASE WHEN title IS NOT NULL THEN {_CATEGORY} END AS code FROM news_articles",
    "sentiments": f"SELECT article_id, CASE WHEN {_COUNT(t.POSITIVE)} > {_COUNT(t.NEGATIVE)} THEN 'Positive' WHEN {_COUNT(t.NEGATIVE)} > {_COUNT(t.POSITIVE)} THEN 'Negative' WHEN title IS NOT NULL THEN 'Neutral' END AS label FROM news_articles",
    "sentiment_labels": "SELECT CASE WHEN upper(trim(sentiment)) IN ('POS','POSITIVE','LABEL_2','TÍCH CỰC') THEN 'Positive' WHEN upper(trim(sentiment)) IN ('NEG','NEGATIVE','LABEL_0','TIÊU CỰC') THEN 'Negative' WHEN upper(trim(sentiment)) IN ('NEU','NEUTRAL','LABEL_1','TRUNG TÍNH','TRUNG LẬP') THEN 'Neutral' END AS label, count(*) AS n FROM processed_posts GROUP BY 1",
    "topics": f"SELECT id, CASE WHEN y NOT IN {t.NO_TOPIC} THEN y END AS topic FROM (SELECT id, trim(regexp_replace(lower(trim(final_topic)), '^new:', '')) AS y FROM processed_posts)",
    "keyword_counts": f"SELECT lower(k) AS keyword, count(*) AS n FROM (SELECT unnest({_KEYS}) AS k FROM detected_trends) GROUP BY 1 ORDER BY n DESC, keyword LIMIT 30",
    "word_counts": "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{M}\\p{N}_]{3,}')) AS word FROM news_articles) GROUP BY 1 ORDER BY n DESC, word LIMIT 100",
    "hashtag_counts": "SELECT tag, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(content, '#([\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+)', 1))) AS tag FROM posts_stream_v1) GROUP BY 1 ORDER BY n DESC, tag LIMIT 15",
    "garbage_keywords": f"SELECT count(*) AS n, CAST(count_if(length(k) <= 2 OR regexp_matches(k, '^\\d+$') OR regexp_matches(k, '^[a-z]{{1,3}}$')) AS BIGINT) AS n_garbage FROM (SELECT lower(unnest({_KEYS})) AS k FROM detected_trends)",
    "english_texts": "SELECT article_id, CASE WHEN length(regexp_replace(title, '\\P{L}', '', 'g')) > 0 THEN length(regexp_replace(title, '[^A-Za-z]', '', 'g')) / length(regexp_replace(title, '\\P{L}', '', 'g')) > 0.5 END AS english FROM news_articles",
    "long_posts": "SELECT id, substr(content, 1, 256) AS head FROM processed_posts WHERE length(content) > 500",
    "text_lengths": "SELECT id, CAST(length(content) AS INT) AS n FROM processed_posts WHERE length(content) BETWEEN 20 AND 799",
    "title_or_content": "SELECT article_id, CASE WHEN length(title) >= 5 THEN title ELSE substr(content, 1, 100) END AS headline FROM news_articles",
    "dated_titles": "SELECT article_id, regexp_matches(concat_ws(' ', title, short_description), '\\d{1,2}[/-]\\d{1,2}([/-]\\d{2,4})?') AS dated FROM news_articles",
    "trend_status": "SELECT id, coalesce(length(summary) > 20, false) AS analysed, coalesce(trend_score < 30, true) AS is_noise FROM detected_trends",
    "smart_queries": f"SELECT id, array_to_string(list_reduce(list_prepend([lower(trend_name)], list_transform({_KEYS}, lambda k: [lower(k)])), lambda acc, k: CASE WHEN len(acc) <= 5 AND len(list_filter(acc, lambda s: contains(k[1], s) OR contains(s, k[1]))) = 0 THEN list_concat(acc, k) ELSE acc END), ' ') AS query FROM detected_trends WHERE trend_name IS NOT NULL AND keywords IS NOT NULL",
    "work_queue": "SELECT id, post_count FROM detected_trends WHERE (summary IS NULL OR trim(summary) = '') AND post_count >= 3 ORDER BY post_count DESC, id LIMIT 15",
}
