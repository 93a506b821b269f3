"""Density clusters of groups of vectors, where no aggregate expresses them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import vectors
from trendloom.operators import graph
from trendloom.session import materialise

#: Vectors that one task clusters or compares at once; larger groups are compared in blocks.
MOST_ROWS = 20_000
#: Factor of the radius at each split of a cluster, and the radius below which none is split.
SHRINK, FLOOR = 0.7, 0.01


def _near(x: np.ndarray, y: np.ndarray, radius: float):
    """For blocks of ``x``: where the block begins, and which of ``y`` lie within ``radius`` of its rows."""
    a, b = (x * x).sum(axis=1), (y * y).sum(axis=1)
    for at in range(0, len(x), 512):
        yield at, a[at : at + 512, None] + b[None, :] - 2 * x[at : at + 512] @ y.T <= radius * radius + 1e-9


def _joined(x: np.ndarray, radius: float, cross: int = 0) -> np.ndarray:
    """The first row that each row is connected with; with ``cross``, rows before it are compared with those from it on only."""
    parent = np.arange(len(x))

    def roots(k: np.ndarray) -> np.ndarray:
        while (parent[k] != k).any():
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for at, near in _near(x[:cross] if cross else x, x[cross:], radius):
        for n, row in enumerate(near, at):
            r = roots(np.append(np.flatnonzero(row) + cross, n))
            parent[r] = r.min()
    return roots(np.arange(len(x)))


def density_labels(x: np.ndarray, least_samples: int, radius: float, least_size: int) -> np.ndarray:
    """Labels 0, 1, ... of density clusters, -1 for noise.

    A point is dense if ``least_samples`` points (itself among them) lie within ``radius``; dense points within it of one
    another are one cluster, the others are noise, and so are clusters of fewer than ``least_size``.
    """
    label = np.full(len(x), -1)
    dense = np.flatnonzero(np.concatenate([near.sum(axis=1) for _, near in _near(x, x, radius)]) >= least_samples) if len(x) else np.arange(0)
    if len(dense):
        _, own, n = np.unique(_joined(x[dense], radius), return_inverse=True, return_counts=True)
        names = np.where(n >= least_size, np.cumsum(n >= least_size) - 1, -1)
        label[dense] = names[own]
    return label


def _split(x: np.ndarray, label: np.ndarray, least_samples: int, radius: float, least_size: int, most_size: int, least_cohesion: float, shrink: float = SHRINK, floor: float = FLOOR) -> np.ndarray:
    """Labels as of ``split_again``, but new ones follow the old in the order of the splits, with gaps."""
    label = label.copy()
    todo = [(k, radius) for k in sorted(set(label.tolist()) - {-1})]
    new = max([k for k, _ in todo], default=-1) + 1
    while todo:
        k, r = todo.pop()
        own = np.flatnonzero(label == k)
        m = x[own].mean(axis=0)
        cohesion = float((x[own] @ m / (np.linalg.norm(x[own], axis=1) * np.linalg.norm(m) + 1e-12)).mean())
        if r * shrink < floor or not (len(own) > most_size or (len(own) >= 2 * least_size and cohesion < least_cohesion)):
            continue
        parts = density_labels(x[own], least_samples, r * shrink, least_size)
        if parts.max() < 0:
            continue
        label[own] = np.where(parts < 0, -1, parts + new)
        todo += [(new + p, r * shrink) for p in range(parts.max() + 1)]
        new += parts.max() + 1
    return label


def split_again(x: np.ndarray, label: np.ndarray, least_samples: int, radius: float, least_size: int, most_size: int, least_cohesion: float, shrink: float = SHRINK, floor: float = FLOOR) -> np.ndarray:
    """Labels after clusters that are too large or not cohesive were clustered again with smaller and smaller radii."""
    label = _split(x, label, least_samples, radius, least_size, most_size, least_cohesion, shrink, floor)
    names = {k: n for n, k in enumerate(sorted(set(label.tolist()) - {-1}))}
    return np.array([names.get(k, -1) for k in label.tolist()])


def _paired(rows: DataFrame, run, schema: str, most_rows: int) -> DataFrame:
    """``run(block, other)`` for each two blocks of a part of ``rows`` (``part, row, v``), and once for each block with None."""
    n = rows.groupBy("part").agg(F.ceil(F.count("*") / (most_rows / 2)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    each = rows.join(n, "part").select("*", block.alias("block")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    each = each.select("part", "row", "v", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))

    def pair(b: pd.DataFrame) -> pd.DataFrame:
        first = b["block"].to_numpy() == b["i"].iloc[0]
        b = pd.concat([b[first], b[~first]])
        cross = int(first.sum()) if b["i"].iloc[0] != b["j"].iloc[0] else 0
        if b["i"].iloc[0] != b["j"].iloc[0] and cross in (0, len(b)):  # one of the blocks is empty
            return pd.DataFrame({"row": [], "x": []}).astype("int64")
        return run(b["row"].to_numpy(), np.stack(b["v"].to_numpy()).astype(float), cross)

    return each.groupBy("part", "i", "j").applyInPandas(pair, schema)


def _dense_parts(rows: DataFrame, least_samples: int, radius: float, least_size: int, most_rows: int) -> DataFrame:
    """``row, child``: the smallest row of the density cluster that each dense row of a part is in, all pairs of rows compared."""

    def count(row: np.ndarray, x: np.ndarray, cross: int) -> pd.DataFrame:
        n = np.zeros(len(x), np.int64)
        for at, near in _near(x[:cross] if cross else x, x[cross:], radius):
            n[at : at + len(near)] += near.sum(axis=1)
            if cross:
                n[cross:] += near.sum(axis=0)
        return pd.DataFrame({"row": row, "x": n})

    def link(row: np.ndarray, x: np.ndarray, cross: int) -> pd.DataFrame:
        root = _joined(x, radius, cross)
        own = np.flatnonzero(root != np.arange(len(x)))
        return pd.DataFrame({"row": row[own], "x": row[root[own]]})

    n = _paired(rows, count, "row long, x long", most_rows).groupBy("row").agg(F.sum("x").alias("n")).where(F.col("n") >= least_samples)
    dense = materialise(rows.join(n.select("row"), "row", "left_semi"))
    parts = graph.components(_paired(dense, link, "row long, x long", most_rows), "row", "x")
    child = dense.select("row").join(parts.withColumnRenamed("node", "row"), "row", "left").select("row", F.coalesce("component", "row").alias("child"))
    return child.withColumn("n", F.count("*").over(Window.partitionBy("child"))).where(F.col("n") >= least_size).select("row", "child")


def _of_large_groups(src: DataFrame, least_samples: int, radius: float, least_size: int, most_size: int, least_cohesion: float, most_rows: int) -> DataFrame:
    """``id, g, cluster`` of groups (``id, g, v``) of any size, as one task would name them.

    Rows are numbered in the order of group and id. A cluster's path holds the smallest rows of the clusters that it was
    split from; the clusters of a group are named in the order in which ``split_again`` would take them: ``at`` is the
    path of the cluster that was split, negative as later parts are split first, ``nth`` tells its parts apart.
    """
    rows = materialise(src.orderBy("g", "id").withColumn("row", F.monotonically_increasing_id()))
    first = rows.groupBy(F.col("g").alias("g2")).agg(F.min("row").alias("part"))
    size = rows.select(F.size("v")).first()[0]
    active = materialise(rows.join(first, F.col("g").eqNullSafe(F.col("g2"))).select(F.array("part").alias("path"), "part", "row", "v"))
    whole_name = [F.transform(F.slice("path", 1, F.size("path") - 1), lambda p: -p).alias("at"), F.element_at("path", -1).alias("nth")]
    done: list[DataFrame] = []
    r, whole = radius, True

    def finish(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("row")
        x = np.stack(b["v"].to_numpy()).astype(float)
        label = _split(x, np.zeros(len(x), int), least_samples, r, least_size, most_size, least_cohesion)
        path = [-int(p) for p in b["path"].iloc[0]]
        at, nth = (path[:-1], np.full(len(b), -path[-1])) if not label.any() else (path, label)  # not split, split
        return pd.DataFrame({"row": b["row"].to_numpy(), "at": [at] * len(b), "nth": nth})[label >= 0]

    while True:
        child = materialise(_dense_parts(active.select("part", "row", "v"), least_samples, r, least_size, most_rows))
        split = active.join(child, "row")
        if not whole:  # what falls apart into noise only stays as it is
            kept = active.join(split.select("part").distinct(), "part", "left_anti")
            done.append(kept.select("row", *whole_name))
        split = materialise(split.select(F.concat("path", F.array("child")).alias("path"), F.col("child").alias("part"), "row", "v"))
        n = split.groupBy("part").agg(F.count("*").alias("n"), vectors.mean_vector(F.col("v"), size).alias("m"))
        large = n.where(F.col("n") > most_rows)
        small = split.join(large.select("part"), "part", "left_anti")
        done.append(materialise(small.groupBy("part").applyInPandas(finish, "row long, at array<long>, nth long")))
        cosine = vectors.dot(F.col("v"), F.col("m")) / (vectors.norm(F.col("v")) * vectors.norm(F.col("m")) + 1e-12)
        loose = (F.col("n") > most_size) | (F.col("n") >= 2 * least_size) & (F.col("cohesion") < least_cohesion)
        again = split.join(large, "part").groupBy("part", "n").agg(F.avg(cosine).alias("cohesion")).where(loose & F.lit(r * SHRINK >= FLOOR))
        again = materialise(again.select("part"))
        kept = split.join(large.select("part"), "part", "left_semi").join(again, "part", "left_anti")
        done.append(kept.select("row", *whole_name))
        if again.isEmpty():
            break
        active, r, whole = split.join(again, "part", "left_semi"), r * SHRINK, False
    named = done[0]
    for x in done[1:]:
        named = named.unionByName(x)
    named = materialise(rows.select("row", "id", "g").join(named, "row", "left"))
    names = named.where("at IS NOT NULL").select(F.col("g").alias("g2"), "at", "nth").distinct()
    names = names.withColumn("cluster", F.dense_rank().over(Window.partitionBy("g2").orderBy("at", "nth")) - 1)
    one = names.select(F.struct("at", "nth").alias("name"), "cluster")
    return named.withColumn("name", F.struct("at", "nth")).join(one, "name", "left").select("id", "g", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def density_clusters(df: DataFrame, row_id: str, vector: str, group: str, least_samples: int = 3, radius: float = 0.5, least_size: int = 3, most_size: int = 100, least_cohesion: float = 0.5) -> DataFrame:
    """``row_id, group, cluster``: density clusters within each value of ``group``, large and loose ones split again.

    Groups of up to ``MOST_ROWS`` take one task each; in larger ones all pairs of blocks are compared, with the same result.
    """

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id")
        x = np.stack(b["v"].to_numpy()).astype(float)
        label = split_again(x, density_labels(x, least_samples, radius, least_size), least_samples, radius, least_size, most_size, least_cohesion)
        return pd.DataFrame({row_id: b["id"].to_numpy(), group: b["g"].to_numpy(), "cluster": label})

    src = materialise(df.select(F.col(row_id).alias("id"), F.col(group).alias("g"), F.col(vector).alias("v")))
    kind = {c: df.schema[c].dataType.simpleString() for c in (row_id, group)}
    schema = f"{row_id} {kind[row_id]}, {group} {kind[group]}, cluster int"
    large = src.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > MOST_ROWS)
    large = materialise(large.select(F.col("g").alias("g2")))
    if large.isEmpty():
        return src.groupBy("g").applyInPandas(run, schema)
    same = F.col("g").eqNullSafe(F.col("g2"))
    big = _of_large_groups(src.join(large, same, "left_semi"), least_samples, radius, least_size, most_size, least_cohesion, MOST_ROWS)
    return src.join(large, same, "left_anti").groupBy("g").applyInPandas(run, schema).unionByName(big.select(F.col("id").alias(row_id), F.col("g").alias(group), "cluster"))
