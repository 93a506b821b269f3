"""Matching in blocks, exact pairs, phases, and places in an order, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.functions.salvage import mended
from trendloom.operators import agreement, graph, matching, pipeline
from trendloom.operators.state import StateTable, empty_state
from trendloom.plans import inventory_queries, match_queries
from trendloom.session import numbered, own_folder

from .compare import same as same_frames

rng = np.random.default_rng(12)


def unit(n, d=8):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def both(spark):
    p, t = unit(40), unit(25)
    posts = spark.createDataFrame([(n, list(map(float, v)), f"x{n % 7}y z") for n, v in enumerate(p)] + [(90, None, "x1"), (91, [1.0], "x1")], "id long, v array<double>, content string")
    trends = spark.createDataFrame([(f"t{n:02d}", list(map(float, v))) for n, v in enumerate(t)] + [("none", None)], "trend string, c array<double>")
    return p, t, posts, trends


@pytest.mark.parametrize("block", [3, 1000])
def test_top_matches_in_any_blocks(both, monkeypatch, block):
    monkeypatch.setattr(matching, "BLOCK_TRENDS", block)
    p, t, posts, trends = both
    got = {(r["id"], r["trend"], r["rank"]) for r in matching.top_matches(posts, trends, "id", "v", "trend", "c", k=3).collect()}
    want = {(n, f"t{k:02d}", r + 1) for n in range(40) for r, k in enumerate(np.argsort(-(p[n] @ t.T))[:3])}
    assert got == want
    assert matching.top_matches(posts, trends.limit(0), "id", "v", "trend", "c").count() == 0


@pytest.mark.parametrize("block", [4, 1000])
def test_hybrid_matches_are_those_of_full_ranks(spark, both, monkeypatch, block):
    monkeypatch.setattr(matching, "BLOCK_TRENDS", block)
    p, t, posts, trends = both
    pairs = {(n, k) for n in range(40) for k in range(25) if (n * k) % 6 == 1}
    hits = spark.createDataFrame([(n, f"t{k:02d}") for n, k in pairs], "id long, trend string")
    got = {r["id"]: (r["trend"], round(r["rrf"], 9)) for r in matching.hybrid_matches(posts, trends, hits, "id", "v", "trend", "c", floor=-1.0).collect()}
    for n in range(40):
        s = np.round(p[n] @ t.T, 9)
        hit = np.array([(n, k) in pairs for k in range(25)])
        rrf = 1 / (61 + np.array([(s > x).sum() for x in s])) + 1 / (61 + np.where(hit, 0, hit.sum()))
        best = max(range(25), key=lambda k: (round(rrf[k], 12), s[k], -k))
        assert got[n] == (f"t{best:02d}", round(rrf[best], 9))


@pytest.mark.parametrize("block", [2, 1000])
def test_terms_are_found_inside_words(spark, monkeypatch, block):
    monkeypatch.setattr(matching, "BLOCK_TERMS", block)
    posts = spark.createDataFrame([(1, "Bão lớn"), (2, "không có gì"), (3, None), (4, ""), (5, "siêubãolớn và bão")], "id long, text string")
    terms = spark.createDataFrame([("a", "bão"), ("b", " LỚN "), ("c", ""), ("d", None), ("e", "không có"), ("a", "gì")], "t string, term string")
    got = {tuple(r) for r in matching.keyword_matches(posts, terms, "id", "text", "t", "term").collect()}
    assert got == {(1, "a"), (1, "b"), (2, "e"), (2, "a"), (5, "a"), (5, "b")}
    assert matching.keyword_matches(posts, terms.limit(0), "id", "text", "t", "term").count() == 0


def shuffled_rows(spark, f):
    """Rows that the stages of ``f()`` hand to one another."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()

    def total():
        bus.waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    before = total()
    f()
    return sum(n for stage, n in total().items() if stage not in before)


@pytest.fixture(scope="module")
def shared_words(spark, tmp_path_factory):
    """A folder of 300 trends that share a keyword, which stands in 400 articles and posts; some of both are null or come again."""
    d = str(tmp_path_factory.mktemp("shared"))
    text = lambda n: None if n % 50 == 7 else f"Có bão lớn số {n}" if n % 4 else "trời yên"
    spark.createDataFrame([(n, f"bão, Số {n}" if n % 3 else f'[" BÃO ", "yên{n}"]', f"tên {n % 7}") for n in range(300)], "id long, keywords string, trend_name string").write.parquet(f"{d}/detected_trends.parquet")
    spark.createDataFrame([(None if n % 40 == 3 else f"u{n % 390}", "t", text(n)) for n in range(400)], "url string, title string, content string").write.parquet(f"{d}/news_articles.parquet")
    vectors = unit(7, 96)
    spark.createDataFrame([(n, text(n), f"tên {n % 7}", [float(x) for x in vectors[n % 7] + vectors[n % 5] / 2]) for n in range(400)], "id long, content string, final_topic string, embedding array<float>").write.parquet(f"{d}/processed_posts.parquet")
    return d


def sql_of(d, name):
    import duckdb

    import __spark_entry__

    c = duckdb.connect()
    for t in ("detected_trends", "news_articles", "processed_posts"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    return c.execute(__spark_entry__.oracle_sql()[name]).df()


@pytest.mark.parametrize("block", [50, 100_000])
def test_articles_of_a_shared_keyword_are_counted_without_pairs(spark, monkeypatch, shared_words, block):
    monkeypatch.setattr(matching, "BLOCK_TERMS", block)
    got = []
    assert shuffled_rows(spark, lambda: got.append(match_queries.keyword_hits(spark, shared_words).toPandas())) < 20_000  # of 90,000 pairs
    same_frames(got[0], sql_of(shared_words, "keyword_hits"))


def test_posts_of_a_shared_keyword_are_counted_without_pairs(spark, shared_words):
    got = []
    assert shuffled_rows(spark, lambda: got.append(inventory_queries.keyword_trends(spark, shared_words).toPandas())) < 20_000  # of 90,000 pairs
    same_frames(got[0], sql_of(shared_words, "keyword_trends"))


@pytest.mark.parametrize("block", [3, 1000])
def test_topics_of_a_shared_keyword_are_ranked_without_pairs(spark, monkeypatch, shared_words, block):
    monkeypatch.setattr(matching, "BLOCK_TRENDS", block)
    made, over = [], matching.keyword_matches
    monkeypatch.setattr(matching, "keyword_matches", lambda *a: made.append(over(*a)) or made[-1])
    same_frames(match_queries.rrf_match(spark, shared_words).toPandas(), sql_of(shared_words, "rrf_match"))
    assert made[0].count() < 800  # a post and a keyword; of a post and a topic 2,000


def test_similar_pairs_in_blocks(spark):
    x = unit(60, 4)
    df = spark.createDataFrame([(n, list(map(float, v))) for n, v in enumerate(x)] + [(99, None)], "id long, v array<double>")
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if x[a] @ x[b] >= 0.7}
    for block in (7, 1000):
        assert {tuple(r) for r in graph.similar_pairs(df, "id", "v", 0.7, block).collect()} == want


def test_silhouette_is_that_of_all_pairs(spark):
    x, label = unit(30), [n % 4 for n in range(29)] + [9]
    df = spark.createDataFrame([(n, label[n], list(map(float, x[n]))) for n in range(30)], "id long, label int, v array<double>")
    got = {r["id"]: r["silhouette"] for r in agreement.cosine_silhouette(df, "id", "label", "v", 8).collect()}
    for n in range(30):
        d = {k: np.mean([1 - x[n] @ x[m] for m in range(30) if label[m] == k and m != n] or [np.nan]) for k in set(label)}
        a, b = d.pop(label[n]), min(v for k, v in d.items() if k != label[n])
        assert got[n] == pytest.approx(0 if np.isnan(a) else (b - a) / max(a, b), abs=1e-6)


def test_phases(spark):
    c = unit(3, 16)
    near = lambda k, e=0.05: list(map(float, c[k] + e * rng.normal(size=16)))
    rows = [(1, "a", "known", near(0)), (2, "b", "fresh", None), (3, "c", None, near(0)), (4, "d", None, None), (5, "e", None, near(2))]
    rows += [(10 + k, f"a story that is told again and again {k}", None, near(1)) for k in range(4)]
    posts = spark.createDataFrame(rows, "id long, content string, topic string, v array<double>")
    trends = spark.createDataFrame([("known", list(map(float, c[0])))], "topic string, v array<double>")
    got = {r["id"]: (r["phase"], r["trend"]) for r in pipeline.assigned(posts, trends, 16).collect()}
    assert got[1] == ("named", "known") and got[2] == ("new name", "fresh") and got[3] == ("vector", "known") and not {4, 5} & set(got)
    assert {got[10 + k][0] for k in range(4)} == {"discovered"} and len({got[10 + k][1] for k in range(4)}) == 1
    assert pipeline.assigned(posts.limit(0), trends, 16).count() == 0


def test_places_in_an_order(spark):
    ids = rng.permutation(500).tolist()
    got = {r["id"]: r["n"] for r in numbered(spark.createDataFrame([(i,) for i in ids], "id long").repartition(7), "n", "id").collect()}
    assert got == {i: i + 1 for i in range(500)} and numbered(spark.range(0), "n", "id").count() == 0


def test_broken_json_of_any_length_is_mended():
    whole = "[" + ",".join(f'{{"a": {n}}}' for n in range(3000))
    assert mended(whole + ', {"a": "cut').count('"a"') == 3000
    assert mended('[{"a": 1}, {"b": oops, ' + ", ".join(str(n) for n in range(1000))) == '[{"a": 1}]'


def test_batches_are_applied_once_and_old_versions_go(spark):
    t = StateTable(spark, own_folder(spark, "state"))
    row = lambda n: lambda s: empty_state(spark).unionByName(spark.createDataFrame([(n, "x", 1, 1, 1, 1.0, [])], empty_state(spark).schema))
    assert [t.apply(b, row(b)) for b in (0, 1, 1, 2, 0, 3)] == [True, True, False, True, False, True]
    assert t.current().first()["trend_id"] == 3 and len(t._ledger()) == 2
    fs, p = t._fs(t.path)
    assert sorted(f.getPath().getName() for f in fs.listStatus(p)) == ["ledger", "v3", "v4"]
    assert t.current().select(F.count("*")).first()[0] == 1
