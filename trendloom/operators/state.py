"""The trend table as versions of a parquet table: batches are merged set-wise and exactly once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.operators import scoring
from trendloom.session import shared_dir

#: Representative posts that a trend keeps, newest first; points of engagement that a post adds.
KEPT_POSTS, POINTS = 1000, 10
REPRESENTATIVE = "array<struct<content:string,source:string,time:string,similarity:double>>"
SCHEMA = f"trend_id bigint, name string, post_count bigint, interactions bigint, google_vol bigint, score double, posts {REPRESENTATIVE}"


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def merge_batch(state: DataFrame, matched: DataFrame) -> DataFrame:
    """The state after a batch of ``trend_id, name, google_vol, arrival, content, source, time, similarity``.

    Counts and interactions grow by the batch, the batch's newest posts are put before the kept ones, and the score is
    taken anew; a trend that the state lacks is added. Only the newest ``KEPT_POSTS`` of a trend's batch reach its row, by a
    rank that is cut before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("trend_id").orderBy(F.desc("arrival")))
    few = matched.withColumn("__r", rank).where(F.col("__r") <= KEPT_POSTS)
    post = F.struct("content", "source", "time", F.col("similarity").cast("double").alias("similarity"))
    posts = few.groupBy("trend_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", post.alias("p")))), lambda x: x["p"]).alias("new_posts"))
    new = matched.groupBy("trend_id").agg(F.count("*").alias("n"), F.min("name").alias("new_name"), F.max("google_vol").alias("new_vol")).join(posts, "trend_id")
    both = state.join(new, "trend_id", "full")
    count = F.coalesce("post_count", F.lit(0)) + F.coalesce("n", F.lit(0))
    points = F.coalesce("interactions", F.lit(0)) + POINTS * F.coalesce("n", F.lit(0))
    vol = F.greatest(F.coalesce("google_vol", F.lit(0)), F.coalesce("new_vol", F.lit(0)))
    kept = F.slice(F.concat(F.coalesce("new_posts", F.array().cast(REPRESENTATIVE)), F.coalesce("posts", F.array().cast(REPRESENTATIVE))), 1, KEPT_POSTS)
    out = both.select("trend_id", F.coalesce("name", "new_name").alias("name"), count.alias("post_count"), points.alias("interactions"), vol.alias("google_vol"), kept.alias("posts"))
    return out.select("trend_id", "name", "post_count", "interactions", "google_vol", scoring.unified(F.col("google_vol"), F.col("interactions"), F.col("post_count"), ceilings=scoring.STREAM).alias("score"), "posts")


def merge_names(state: DataFrame, names: DataFrame) -> DataFrame:
    """The state with trends renamed by ``trend_id, canonical`` and those of one name merged into the smallest id."""
    x = state.join(names, "trend_id", "left").withColumn("name", F.coalesce("canonical", "name")).drop("canonical")
    g = x.groupBy("name").agg(
        F.min("trend_id").alias("trend_id"), F.sum("post_count").alias("post_count"), F.sum("interactions").alias("interactions"), F.max("google_vol").alias("google_vol"),
        F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("trend_id", "posts"))), lambda p: p["posts"])), 1, KEPT_POSTS).alias("posts"),
    )
    return g.select("trend_id", "name", "post_count", "interactions", "google_vol", scoring.unified(F.col("google_vol"), F.col("interactions"), F.col("post_count"), ceilings=scoring.STREAM).alias("score"), "posts")


class StateTable:
    """Versions of the state in a folder, the newest two of which are kept, with the batch that went into each.

    A version is written whole and then named by one small file, so a batch that is delivered again, or whose write broke
    off, changes nothing. Batches come in the order of their numbers.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/trend-state"

    def _ledger(self) -> list[dict]:
        """The newest versions in order, a few at most."""
        fs, p = self._fs(f"{self.path}/ledger")
        if not fs.exists(p):
            return []
        names = sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(p) if "=" in f.getPath().getName())
        done = []
        for n in names[-2:]:
            done += [json.loads(r[0]) for r in self.spark.read.text(f"{self.path}/ledger/version={n}").select("value").collect()]
        return done

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def current(self) -> DataFrame:
        done = self._ledger()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{done[-1]['version']}") if done else empty_state(self.spark)

    def apply(self, batch_id: int, change) -> bool:
        """Writes ``change(current)`` as the next version unless the batch is in the ledger; whether it did."""
        done = self._ledger()
        if done and batch_id <= done[-1]["batch"]:
            return False
        version = (done[-1]["version"] if done else 0) + 1
        change(self.current()).write.mode("overwrite").parquet(f"{self.path}/v{version}")
        self.spark.createDataFrame([(json.dumps({"version": version, "batch": batch_id}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/ledger/version={version}")
        for old in (f"{self.path}/ledger/version={version - 2}", f"{self.path}/v{version - 2}"):
            fs, p = self._fs(old)
            if fs.exists(p):
                fs.delete(p, True)
        return True
