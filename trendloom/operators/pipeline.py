"""Posts assigned to trends in phases: by name, by vector, and the rest as trends of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.functions import vectors
from trendloom.functions.text import short_name
from trendloom.operators import graph, matching
from trendloom.session import materialise

#: Cosine from which a post is of a trend; posts of a discovered trend; mean cosine of its members with their centroid.
MATCHED, LEAST_MEMBERS, COHESIVE = 0.65, 3, 0.75


def assigned(posts: DataFrame, trends: DataFrame, size: int) -> DataFrame:
    """``id, phase, trend, sim`` of each post that finds a trend.

    ``posts`` has ``id, content, topic, v`` (topic null: none), ``trends`` ``topic, v``. A post with a topic is of that trend
    (``named``), which is new if no trend has the name (``new name``). Of those without a topic the ones with a usable vector are of
    the nearest trend from ``MATCHED`` on (``vector``); what is left is tied by that cosine, and components keep the members that are
    near their centroid, if enough are left and near enough on average (``discovered``), named by the member nearest the centroid.
    Posts with neither topic nor usable vector, and lone ones, have no row.
    """
    known = trends.select("topic").distinct().withColumn("__known", F.lit(True))
    named = posts.where("topic IS NOT NULL").join(known, "topic", "left")
    named = named.select("id", F.when(F.col("__known"), "named").otherwise("new name").alias("phase"), F.col("topic").alias("trend"), F.when(F.col("__known"), 0.95).otherwise(1.0).alias("sim"))
    free = materialise(posts.where(F.col("topic").isNull() & matching.usable(F.col("v"), size)).select("id", "content", "v"))
    near = materialise(matching.top_matches(free, trends, "id", "v", "topic", "v", floor=MATCHED))
    rest = free.join(near.select("id"), "id", "left_anti")
    found = graph.components(graph.similar_pairs(rest, "id", "v", MATCHED), "a", "b").withColumnRenamed("node", "id")
    own = graph.pruned_members(rest.join(found, "id"), "component", "v", size, MATCHED, LEAST_MEMBERS)
    stories = graph.representatives(own, "component", "id", "sim").where(F.col("mean_sim") >= COHESIVE)
    names = stories.join(rest.select(F.col("id").alias("representative"), "content"), "representative").select("component", short_name(F.col("content"), 30).alias("trend"))
    discovered = own.join(names, "component").select("id", F.lit("discovered").alias("phase"), "trend", "sim")
    return named.unionByName(near.select("id", F.lit("vector").alias("phase"), F.col("topic").alias("trend"), "sim")).unionByName(discovered)


def trend_vectors(posts: DataFrame, size: int) -> DataFrame:
    """``topic, v``: the mean of the usable vectors of each topic's posts."""
    return posts.where(F.col("topic").isNotNull() & matching.usable(F.col("v"), size)).groupBy("topic").agg(vectors.mean_vector(F.col("v"), size).alias("v"))
