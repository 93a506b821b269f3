import json
import math

import pytest
from pyspark.sql import functions as F

from trendloom.functions import salvage, vectors
from trendloom.functions import text as t
from trendloom.operators import agreement, graph, matching, scoring
from trendloom.operators.state import StateTable, empty_state, merge_batch, merge_names
from trendloom.session import bounded_broadcast, own_folder
from trendloom.sources import readers, writers


def one(spark, f, *values):
    schema = ", ".join(f"c{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in enumerate(values))
    return spark.createDataFrame([values], schema).select(f(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(("x", "want"), [("50 N+", 50000), ("200+", 200), ("2 Tr+", 2000000), ("1.000+", 1000), ("", 0), (None, 0), ("5M", 5000000)])
def test_volume(spark, x, want):
    assert one(spark, t.volume, x) == want


def test_text(spark):
    assert one(spark, t.fold, "Bão số 3  đổ bộ") == "bao so 3 đo bo"
    assert one(spark, lambda c: t.fold(c, True), "Đà Nẵng") == "da nang"
    assert one(spark, t.plain_url, "http://a/b/?x=1#y") == "http://a/b"
    assert one(spark, t.hashtags, "a #Một b #hai_2") == ["một", "hai_2"]
    assert [one(spark, t.bad_versus, x) for x in ("mu vs", "a vs chelsea", "viet nam vs lao")] == [True, True, False]
    assert one(spark, t.topic_of, "New: Bão") == "bão" and one(spark, t.topic_of, "N/A") is None
    assert one(spark, t.sentiment, "vui nhưng buồn") == "Neutral"
    assert one(spark, t.keyword_list, '["a", " b "]') == ["a", "b"] and one(spark, t.keyword_list, "a, b,, c") == ["a", "b", "c"]
    assert one(spark, lambda n, k: t.smart_query(n, t.keyword_list(k)), "bão", "bão lớn, cứu hộ, hộ") == "bão cứu hộ"


def test_scores(spark):
    s = lambda *v: one(spark, lambda g, f, n: scoring.unified(g, f, n), *map(float, v))
    assert s(0, 0, 0) == 0.0 and s(1e9, 1e9, 1e9) == 100.0
    g, n = 100 * math.log10(1001) / 6.0000004342942646, 100 * math.log10(6) / math.log10(11)
    assert abs(s(1000, 0, 5) - (0.4 * g + 0.25 * n) * 1.1) < 1e-6
    assert abs(one(spark, scoring.decay, 2.0) - 0.64) < 1e-12


def test_agreement_of_equals(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (2, 6), (3, 7)], "t int, p int")
    r = agreement.agreement(df, "t", "p").first().asDict()
    assert all(abs(r[k] - 1) < 1e-9 for k in r if k != "entropy") and abs(r["entropy"]) < 1e-9


def test_match_and_components(spark):
    posts = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, None)], "id int, v array<double>")
    trends = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0])], "t int, w array<double>")
    got = {r["id"]: r["t"] for r in matching.top_matches(posts, trends, "id", "v", "t", "w", floor=0.65).collect()}
    assert got == {1: 10, 2: 11}
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    c = {r["node"]: r["component"] for r in graph.components(edges, "a", "b").collect()}
    assert c == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100}
    assert one(spark, lambda a, b: vectors.cosine(F.array(a, b), F.array(a, b)), 3.0, 4.0) == pytest.approx(1.0)


def test_keyword_matches_are_those_of_a_nested_loop(spark):
    posts = [(1, "Bão lớn ở miền Trung"), (2, "bão"), (3, None), (4, "lớn bão"), (5, "x" * 50000 + " bão lớn")]
    terms = [(1, "bão lớn"), (2, "Bão"), (3, " "), (4, "trung")]
    got = {tuple(r) for r in matching.keyword_matches(spark.createDataFrame(posts, "id int, x string"), spark.createDataFrame(terms, "k int, w string"), "id", "x", "k", "w").collect()}
    assert got == {(p, k) for p, x in posts for k, w in terms if x and w.strip() and w.strip().lower() in x.lower()}


def test_state_is_idempotent(spark):
    table = StateTable(spark, own_folder(spark, "state"))
    b = spark.createDataFrame([(1, "a", 100, n, f"p{n}", "s", "t", 0.9) for n in range(3)], "trend_id long, name string, google_vol long, arrival long, content string, source string, time string, similarity double")
    assert table.apply(0, lambda s: merge_batch(s, b)) and not table.apply(0, lambda s: merge_batch(s, b))
    assert table.apply(1, lambda s: merge_batch(s, b.withColumn("arrival", F.col("arrival") + 10)))
    r = table.current().first()
    assert (r["post_count"], r["interactions"], len(r["posts"]), r["posts"][0]["content"]) == (6, 60, 6, "p2")
    assert empty_state(spark).count() == 0
    m = merge_names(table.current().unionByName(table.current().withColumn("trend_id", F.lit(7).cast("long"))), spark.createDataFrame([(7, "a")], "trend_id long, canonical string"))
    assert [(x["trend_id"], x["post_count"]) for x in m.collect()] == [(1, 12)]


def test_readers(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"content": "một bài viết đủ dài để giữ lại", "page_name": "P", "stats": {"likes": "1.2K", "comments": 3}}, {"text": "ngắn"}]), "utf-8")
    r = readers.social_posts(spark, str(tmp_path / "s.json")).collect()
    assert [(x["source"], x["stats"]["likes"], x["stats"]["comments"]) for x in r] == [("Face: P", 1200, 3)]
    d = tmp_path / "paper"
    d.mkdir()
    (d / "n.csv").write_text('article_id,url,title,short_description,author,category,published_at,content\n1,u,T,s,a,c,2025,"x\ny ""z"""\n')
    a = readers.news_articles(spark, str(d)).first()
    assert (a["source"], a["content"], a["text"]) == ("PAPER", 'x\ny "z"', 'T\nx\ny "z"')
    for stamp, vol in (("20250101-0000", "200+"), ("20250102-0000", "50 N+")):
        (tmp_path / f"trends_{stamp}.csv").write_text(f'Xu hướng,Lượng,Bắt đầu,Kết thúc,Từ\nbão,{vol},a,b,"bão, lũ"\n')
    x = readers.search_trends(spark, str(tmp_path / "trends_*.csv")).collect()
    assert [(y["trend"], y["volume"], y["keywords"]) for y in x] == [("bão", 50000, ["bão", "lũ"])]
    (tmp_path / "g.csv").write_text("﻿id ,grouth_truth\n1,5\n2,x\n")
    assert [tuple(y) for y in readers.labelled_rows(spark, str(tmp_path / "g.csv")).collect()] == [(1, 5)]
    (tmp_path / "o.json").write_text('{"posts": [{"a": 1}, {"a": 2}]}')
    assert readers.json_objects(spark, str(tmp_path / "o.json"), "a:int").count() == 2
    (tmp_path / "w.txt").write_text("mot 1 2.5\nhai 3 4\n")
    assert readers.word_vectors(spark, str(tmp_path / "w.txt")).first()["vector"] == [1.0, 2.5]
    page = "<html><head><title>A</title><meta name=author content=B></head><body><h1>C &amp; D</h1><script>no</script><p>x  y</p><p></p><p>z</p></body></html>"
    p = readers.article_pages(spark.createDataFrame([("u", page), ("v", None), ("w", "")], "url string, html string")).collect()
    assert (p[0]["title"], p[0]["author"], p[0]["content"]) == ("C & D", "B", "x y\nz") and p[1]["title"] is None
    m = writers.as_messages(spark.createDataFrame([(1, "ă")], "id int, x string"), "id").first()
    assert (m["key"], json.loads(m["value"])) == ("1", {"id": 1, "x": "ă"})
    t1 = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    assert [r["k"] for r in writers.new_rows(t1, spark.createDataFrame([(1,)], "k int"), "k").collect()] == [2]


@pytest.mark.parametrize(("x", "want"), [('```json\n[{"a": 1}]\n```', [{"a": 1}]), ('say: {"a": [1, 2,],}', {"a": [1, 2]}), ('[{"a": 1}, {"a": 2, "b": "cut', [{"a": 1}, {"a": 2}]), ("[1, 2, ...]", [1, 2]), ("nothing", None), (None, None), ("", None)])
def test_mended(x, want):
    got = salvage.mended(x)
    assert (json.loads(got) if got else None) == want


def test_bounded_broadcast(spark):
    df = spark.range(10)
    assert "broadcast" in str(bounded_broadcast(df, 10)._jdf.queryExecution().logical()).lower()
    assert "broadcast" not in str(bounded_broadcast(df, 9)._jdf.queryExecution().logical()).lower()


def test_density():
    import numpy as np

    from trendloom.operators import density

    r = np.random.default_rng(1)
    x = np.vstack([r.normal(0, 0.05, (30, 2)), r.normal(3, 0.05, (20, 2)), r.uniform(-9, 9, (5, 2))])
    label = density.density_labels(x, 3, 0.5, 5)
    assert len(set(label[:30])) == 1 and len(set(label[30:50])) == 1 and label[0] != label[30] and (label[50:] == -1).all()
    assert density.density_labels(x[:0], 3, 0.5, 5).size == 0
    two = np.vstack([r.normal(0, 0.05, (40, 2)), r.normal([0.6, 0], 0.05, (40, 2))])
    first = density.density_labels(two, 3, 0.6, 5)
    again = density.split_again(two, first, 3, 0.6, 5, most_size=50, least_cohesion=0.0)
    assert len(set(first)) == 1 and len(set(again[:40])) == 1 and again[0] != again[79]


def test_article_parts_and_latest_file(spark, tmp_path):
    import os

    x = one(spark, readers.article_parts, "Lan\n\n12/10/2025, 10:00\nMở đầu.\nMột.\nHai.")
    assert tuple(x) == ("Lan", "Mở đầu.", "Một.\nHai.")
    for k, name in enumerate(("b.csv", "a.csv")):
        (tmp_path / name).write_text(f"x\n{k}\n")
        os.utime(tmp_path / name, (1_000_000 + k, 1_000_000 + k))
    assert readers.latest_file(spark, str(tmp_path), header=True).first()["x"] == "1"
