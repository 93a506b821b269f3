"""Agreement of two groupings, and shape of one, from aggregates: no pair of rows is ever formed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from trendloom.functions import vectors
from trendloom.operators.matching import over_blocks


def _pairs(n):
    return n * (n - 1) / 2.0


def agreement(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row of pairwise and BCubed precision, recall and F1, purity, weighted entropy (bits), Rand index adjusted for chance, and normalised mutual information.

    Everything comes from the contingency table, whose size is that of the labels that meet.
    """
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").cast("double").alias("n"))
    a = cells.groupBy("t").agg(F.sum("n").alias("nt"))
    b = cells.groupBy("p").agg(F.sum("n").alias("np"), F.max("n").alias("top"))
    c = cells.join(a, "t").join(b, "p")
    part = c.agg(
        F.sum("n").alias("N"), F.sum(_pairs(F.col("n"))).alias("both"), F.sum(F.col("n") * F.col("n") / F.col("np")).alias("bp"), F.sum(F.col("n") * F.col("n") / F.col("nt")).alias("br"),
        F.sum(-F.col("n") * F.log2(F.col("n") / F.col("np"))).alias("h"), F.sum(F.col("n") * F.log(F.col("n") / (F.col("nt") * F.col("np")))).alias("mi"),
    )
    ta = a.agg(F.sum(_pairs(F.col("nt"))).alias("pt"), F.sum(-F.col("nt") * F.log("nt")).alias("ht"))
    pb = b.agg(F.sum(_pairs(F.col("np"))).alias("pp"), F.sum(-F.col("np") * F.log("np")).alias("hp"), F.sum("top").alias("top"))
    one = part.crossJoin(ta).crossJoin(pb)  # three single rows
    n = F.col("N")
    f1 = lambda p, r: F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    pp, pr = F.when(F.col("pp") > 0, F.col("both") / F.col("pp")).otherwise(0.0), F.when(F.col("pt") > 0, F.col("both") / F.col("pt")).otherwise(0.0)
    expected = F.col("pp") * F.col("pt") / _pairs(n)
    ht, hp, mi = F.log(n) + F.col("ht") / n, F.log(n) + F.col("hp") / n, F.log(n) + F.col("mi") / n
    return one.select(
        pp.alias("pair_precision"), pr.alias("pair_recall"), f1(pp, pr).alias("pair_f1"), (F.col("bp") / n).alias("b3_precision"), (F.col("br") / n).alias("b3_recall"), f1(F.col("bp") / n, F.col("br") / n).alias("b3_f1"),
        (F.col("top") / n).alias("purity"), (F.col("h") / n).alias("entropy"), ((F.col("both") - expected) / F.nullif((F.col("pp") + F.col("pt")) / 2 - expected, F.lit(0.0))).alias("ari"), (mi / F.nullif((ht + hp) / 2, F.lit(0.0))).alias("nmi"),
    )


def cohesion(df: DataFrame, group: str, vector: str, size: int) -> DataFrame:
    """``group, n, cohesion, avg_pairwise``: mean cosine of the members to their centroid, and over all pairs in closed form."""
    u = df.select(group, vectors.unit(F.col(vector)).alias("u"))
    mean = u.groupBy(group).agg(vectors.mean_vector(F.col("u"), size).alias("m"), F.count("*").alias("n"))
    near = u.join(mean, group).groupBy(group, "n").agg(F.avg(vectors.cosine(F.col("u"), F.col("m"))).alias("cohesion"), F.first(vectors.dot(F.col("m"), F.col("m"))).alias("q"))
    n = F.col("n").cast("double")
    return near.select(group, "n", F.when(n > 1, F.col("cohesion")).otherwise(1.0).alias("cohesion"), F.when(n > 1, (n * n * F.col("q") - n) / (n * (n - 1))).otherwise(1.0).alias("avg_pairwise"))


def noise_quality(df: DataFrame, truth: str, said: str) -> DataFrame:
    """``noise_precision, noise_recall, n_noise`` of two columns that say whether a row is noise; null where there is none."""
    n = df.agg(F.count_if(F.col(truth) & F.col(said)).alias("tp"), F.count_if(F.col(said)).alias("s"), F.count_if(F.col(truth)).alias("n_noise"))
    share = lambda c: F.round(F.col("tp") / F.nullif(F.col(c), F.lit(0)), 6)
    return n.select(share("s").alias("noise_precision"), share("n_noise").alias("noise_recall"), "n_noise")


def cosine_silhouette(df: DataFrame, id_col: str, label: str, vector: str, size: int) -> DataFrame:
    """``id, label, silhouette`` by cosine distance, exact: the mean distance of a vector to a group is one minus its product with the
    group's mean unit vector, so that no pair is formed. A group of one has 0. Groups are compared in blocks of ``BLOCK_TRENDS``."""
    u = df.select(id_col, label, vectors.unit(F.col(vector)).alias("__u")).where(F.col(label).isNotNull())
    g = u.groupBy(label).agg(vectors.mean_vector(F.col("__u"), size).alias("__m"), F.count("*").alias("__n"))
    schema = StructType([StructField(id_col, u.schema[id_col].dataType), StructField("__near", DoubleType())])

    def nearest(part: pd.DataFrame, s: np.ndarray, known: list) -> pd.DataFrame:
        own = {k: n for n, k in enumerate(known)}
        for n, k in enumerate(part[label]):
            if k in own:
                s[n, own[k]] = -np.inf
        return pd.DataFrame({id_col: part[id_col].to_numpy(), "__near": s.max(axis=1)})

    other = over_blocks(u, g, "__u", label, "__m", nearest, schema, products=True)[0].groupBy(id_col).agg(F.max("__near").alias("__near"))
    x = u.join(g, label).join(other, id_col)
    a = 1 - (F.col("__n") * vectors.dot(F.col("__u"), F.col("__m")) - 1) / (F.col("__n") - 1)
    b = 1 - F.col("__near")
    return x.withColumns({"__a": F.when(F.col("__n") > 1, a), "__b": b}).select(id_col, label, F.when(F.col("__a").isNull(), 0.0).otherwise((F.col("__b") - F.col("__a")) / F.greatest("__a", "__b")).alias("silhouette"))
