from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trendloom.operators.state import StateTable
from trendloom.session import own_folder
from trendloom.streaming import jobs

START = datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    rows = [(k, START + timedelta(minutes=7 * k), k % 3, float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id int, value double")
    for part in range(3):  # three files, three batches
        df.where(f"event_id % 3 = {part}").coalesce(1).write.mode("append").parquet(folder)
    return folder, df


def test_windows_are_those_of_the_batch(spark, events):
    folder, df = events
    s = jobs.file_messages(spark, folder, df.schema, 1).groupBy(F.window("ts", "1 hour"), "user_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "user_id", "n")
    got = {tuple(r) for r in jobs.last_of_complete(s).collect()}
    want = {tuple(r) for r in df.groupBy(F.date_trunc("hour", "ts").alias("start"), "user_id").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_watermarked_forms_run(spark, events):
    folder, df = events
    stream = lambda: jobs.file_messages(spark, folder, df.schema)
    assert jobs.run_to_end(jobs.tumbling_counts(stream(), "ts", "user_id")).agg(F.sum("n")).first()[0] <= 60
    assert jobs.run_to_end(jobs.session_counts(stream(), "ts", "user_id", gap="10 minutes")).count() >= 1
    assert jobs.run_to_end(jobs.once_each(stream(), "ts", ["user_id"], "30 days")).count() == 3


def test_average_is_that_of_a_loop(spark, events):
    folder, df = events
    base = own_folder(spark, "ema")
    s = jobs.moving_average(jobs.file_messages(spark, folder, df.schema), "user_id", "value")
    jobs.run_to_end(s, "update", lambda b, n: b.write.mode("append").parquet(base))
    for r in spark.read.schema(s.schema).parquet(base).collect():
        ema, n = 0.0, 0
        for k in range(r["user_id"], 60, 3):
            ema, n = (float(k) if not n else 0.7 * ema + 0.3 * k), n + 1
        assert (r["n"], pytest.approx(r["ema"])) == (n, ema)


def test_messages_in_any_split_give_one_state(spark, tmp_path):
    rows = [(k, f"text {k}", "Bão" if k % 2 else "New: Lũ") for k in range(40)]
    df = spark.createDataFrame(rows, "msg_id long, content string, final_topic string").withColumns({"source": F.lit("s"), "time": F.lit("t")})
    trends = spark.createDataFrame([(1, "bão", 10), (2, "lũ", 20), (3, "bão", 5), (4, None, 1)], "id long, trend_name string, google_vol long")
    states = []
    for parts in (1, 5):
        folder = str(tmp_path / f"m{parts}")
        for k in range(parts):
            df.where(f"msg_id % {parts} = {k}").coalesce(1).write.mode("append").parquet(folder)
        table = StateTable(spark, own_folder(spark, "state"))
        jobs.update_trends(jobs.file_messages(spark, folder, df.schema, 1), table, trends)
        states.append({(r["trend_id"], r["post_count"], r["interactions"], round(r["score"], 9), len(r["posts"])) for r in table.current().collect()})
    assert states[0] == states[1] and {x[:3] for x in states[0]} == {(1, 20, 200), (2, 20, 200)}


def test_messages_are_parsed(spark):
    raw = spark.createDataFrame([('{"content": "a", "interaction": 3}',), ('{"source": "x"}',), ("no json",), (None,)], "value string")
    assert [(r["content"], r["interaction"]) for r in jobs.parsed(raw).collect()] == [("a", 3)]
