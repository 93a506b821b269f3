"""Streaming forms of the operators: each wraps a batch operator or a built-in stateful one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trendloom.functions.text import topic_of
from trendloom.operators.state import StateTable, merge_batch
from trendloom.session import own_folder

#: Messages as the topic carries them.
MESSAGE = "content string, source string, time string, created_time string, summary string, url string, interaction bigint, final_topic string, category string"


def kafka_messages(spark: SparkSession, servers: str, topic: str, most: int | None = None, schema: str = MESSAGE) -> DataFrame:
    """The stream of a topic's JSON messages from its beginning; needs the Kafka source on the class path."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("failOnDataLoss", "false")
    raw = (r.option("maxOffsetsPerTrigger", most) if most else r).load()
    return parsed(raw.selectExpr("CAST(value AS STRING) AS value"), schema)


def parsed(raw: DataFrame, schema: str = MESSAGE) -> DataFrame:
    """The fields of JSON messages in ``value``; messages without content, or that are no JSON, are left out."""
    return raw.select(F.from_json("value", schema).alias("data")).select("data.*").where("content IS NOT NULL")


def file_messages(spark: SparkSession, path: str, schema, most_files: int | None = None, kind: str = "parquet") -> DataFrame:
    """A stream of files: what stands in for a topic where there is none."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", most_files) if most_files else r).format(kind).load(path)


def run_to_end(stream: DataFrame, mode: str = "append", each=None) -> DataFrame | None:
    """Runs a stream over what there is. Without ``each`` the rows are written to the shared folder and read back."""
    spark = stream.sparkSession
    base = own_folder(spark, "stream")
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if each is not None:
        w.foreachBatch(each).start().awaitTermination()
        return None
    w.format("parquet").option("path", f"{base}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def last_of_complete(stream: DataFrame) -> DataFrame:
    """The final table of an aggregating stream in complete mode."""
    base = own_folder(stream.sparkSession, "stream")
    run_to_end(stream, "complete", lambda b, n: b.write.mode("overwrite").parquet(f"{base}/last"))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/last")


def tumbling_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by key and window; a window is given out once the watermark has passed it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: events with gaps shorter than ``gap``."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), key, "n")


def once_each(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The stream without rows of equal keys within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def moving_average(events: DataFrame, key: str, value: str, order: Sequence[str] = ("ts", "event_id"), weight: float = 0.3) -> DataFrame:
    """``key, n, ema`` after each batch: an exponential moving average kept as state; a batch's values in the order of ``order``.

    A batch's rows of a key are sorted and summed with their powers of the weight in one vector expression.
    """

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, 0.0)
        v = pd.concat(list(frames)).sort_values(list(order))[value].to_numpy(float)
        powers = (1 - weight) ** np.arange(len(v) - 1, -1, -1.0)
        weights = weight * powers
        if not n and len(v):
            weights[0] = powers[0]  # the first value ever is the average
        ema = float(ema * (1 - weight) ** len(v) + weights @ v)
        n += len(v)
        state.update((n, ema))
        yield pd.DataFrame({key: [k[0]], "n": [n], "ema": [ema]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)


def update_trends(messages: DataFrame, table: StateTable, trends: DataFrame) -> None:
    """Runs the messages into the trend table: each batch is matched by topic name and merged exactly once."""
    known = trends.select(F.col("id").alias("trend_id"), F.col("trend_name").alias("name"), "google_vol", topic_of(F.col("trend_name")).alias("topic")).where("topic IS NOT NULL")
    known = known.groupBy("topic").agg(F.min(F.struct("trend_id", "name", "google_vol")).alias("t")).select("topic", "t.*")

    def each(batch: DataFrame, batch_id: int) -> None:
        m = batch.withColumn("topic", topic_of(F.col("final_topic"))).join(known, "topic").withColumns({"arrival": F.col("msg_id"), "similarity": F.lit(1.0)})
        table.apply(batch_id, lambda state: merge_batch(state, m))

    run_to_end(messages, "append", each)
