"""Connected components of a similarity graph, and the gates that make clusters of them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.functions import vectors
from trendloom.session import materialise


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 40) -> DataFrame:
    """``node, component``: the smallest node reachable from each node that has an edge.

    Smallest labels spread along the edges and jump along themselves, so the rounds grow with the logarithm of the longest
    path; every round is written to the shared folder, which cuts the plan and survives lost executors.
    """
    one = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = materialise(one.unionByName(one.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    label = materialise(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")))
    for _ in range(most_rounds):
        near = both.join(label.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = label.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        far = label.select(F.col("node").alias("next"), F.col("component").alias("far"))
        new = materialise(step.join(far, "next", "left").select("node", F.col("component").alias("old"), F.least("next", F.coalesce("far", "next")).alias("component")))
        if new.where("component <> old").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")
    raise RuntimeError(f"no fixed point within {most_rounds} rounds")


def similar_pairs(df: DataFrame, row_id: str, vector: str, least: float, block: int = 5_000) -> DataFrame:
    """``a, b`` with ``a < b``: all rows whose vectors have a cosine of at least ``least``, exactly.

    Rows are divided into blocks by a hash of the id and two blocks meet in a task, so that no task holds more than about
    ``2 * block`` of them; the work grows with the square of the rows. Rows without a vector have no pair.
    """
    x = df.where(F.col(vector).isNotNull()).select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = max(1, math.ceil(x.count() / block))
    x = x.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n)))
    x = x.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    x = x.select("id", "v", "part", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"))
    kind = df.schema[row_id].dataType.simpleString()

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        left, right = b[b["part"] == b["low"]], b[b["part"] == b["high"]]
        u, w = (np.stack(s["v"].to_numpy()) if len(s) else np.empty((0, 1)) for s in (left, right))
        u, w = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8) for m in (u, w))
        i, j = left["id"].to_numpy(), right["id"].to_numpy()
        found = []
        for at in range(0, len(u) if len(w) else 0, 1024):
            r, c = np.nonzero(np.round(u[at : at + 1024] @ w.T, 9) >= least)
            found.append((i[r + at], j[c]))
        one, two = (np.concatenate([f[k] for f in found]) if found else i[:0] for k in (0, 1))
        keep = one < two if len(b) and b["low"].iloc[0] == b["high"].iloc[0] else one != two
        return pd.DataFrame({"a": np.minimum(one, two)[keep], "b": np.maximum(one, two)[keep]})

    return x.groupBy("low", "high").applyInPandas(meet, f"a {kind}, b {kind}")


def pruned_members(df: DataFrame, cluster: str, vector: str, size: int, least_similar: float, least_members: int) -> DataFrame:
    """``df`` with ``sim`` to its cluster's centroid, without members below a similarity and clusters left with too few."""
    centre = df.groupBy(cluster).agg(vectors.mean_vector(F.col(vector), size).alias("__c"))
    near = df.join(centre, cluster).withColumn("sim", vectors.cosine(F.col(vector), F.col("__c"))).drop("__c").where(F.col("sim") >= least_similar)
    enough = near.groupBy(cluster).agg(F.count("*").alias("__n")).where(F.col("__n") >= least_members).select(cluster)
    return near.join(enough, cluster, "left_semi")


def representatives(df: DataFrame, cluster: str, row_id: str, sim: str) -> DataFrame:
    """``cluster, representative, n, mean_sim``: the member nearest the centroid; of equals the smaller id."""
    return df.groupBy(cluster).agg(F.max_by(row_id, F.struct(F.round(sim, 9), -F.col(row_id))).alias("representative"), F.count("*").alias("n"), F.avg(sim).alias("mean_sim"))
