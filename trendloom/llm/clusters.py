"""Grouping records into clusters of mutually similar ones, at any number of records.

Records become unit vectors: the embedding and, as hashed features of a small weight, their labels. Distributed k-means
with parallel oversampled seeding (k-means||) cuts the space into cells whose number grows with the square root of the
records; each record lies in its ``SPREAD`` nearest cells, so that close records share one. Within a cell, groups form
around leaders; groups of different cells that share a record are one cluster. Clusters are named by their smallest id,
with their size and the members nearest the centroid.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from trendloom.functions.text import NO_TOPIC
from trendloom.session import materialise, spread
from trendloom.session import parts as parts_of

#: Cosine from which two records belong together; cells that a record lies in; k-means rounds; seeding rounds.
SIMILAR, SPREAD, ROUNDS, SEEDING = 0.68, 4, 3, 4
#: Centroids are held by the driver and sent to the workers: at most so many (65,536 of 112 numbers are 29 MB), so that cells grow
#: with the square root of the records up to four billion of them.
MOST_CELLS = 65_536
#: Rows of a cell that one task groups.
CELL_ROWS = 20_000
#: Numbers of the hashed label features, and their weight beside an embedding of length 1.
HASHED, LABEL_WEIGHT = 16, 0.2


def usable(vector: str = "embedding", size: int | None = None):
    """Whether a vector is not null, has no NaN, infinite or null number, isn't all zero, and is of ``size`` if given."""
    v = F.col(vector)
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(good & (F.size(v) == size if size else F.lit(True)), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def vectorise(df: DataFrame, id_col: str, vector: str, labels: Sequence[str] = (), weight: float = LABEL_WEIGHT) -> DataFrame:
    """``id, v``: unit float vectors of the embedding and of hashed labels; every row of ``df`` must have a usable vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = unit(np.stack(b["v"].to_numpy()))
            if labels and weight:
                h = np.zeros((len(b), HASHED), np.float32)
                for name in labels:
                    for n, label in enumerate(b[name]):
                        y = label.strip().lower().removeprefix("new:").strip() if isinstance(label, str) else ""
                        if y not in NO_TOPIC:
                            code = zlib.crc32(f"{name}={y}".encode())
                            h[n, code % HASHED] += weight * (1 if code >> 16 & 1 else -1)
                x = unit(np.hstack([x, h]))
            yield pd.DataFrame({"id": b["id"].to_numpy(), "v": list(x)})

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), *[F.col(c).cast("string").alias(c) for c in labels if weight])
    return spread(src).mapInPandas(run, StructType([StructField("id", LongType()), StructField("v", ArrayType(FloatType()))]))


def _to_driver(df: DataFrame) -> np.ndarray:
    rows = df.collect()
    return np.array([r[0] for r in rows], np.float32) if rows else np.empty((0, 0), np.float32)


def _nearest_costs(vectors: DataFrame, centres: np.ndarray, want: float, seed: int) -> DataFrame:
    """Vectors drawn with a chance in proportion to their distance from the nearest centre, about ``want`` in all."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def cost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["v"].to_numpy()) if len(b) else np.empty((0, centres.shape[1]), np.float32)
            d = np.concatenate([1 - (x[k : k + 4096] @ shared.value.T).max(axis=1) for k in range(0, len(x), 4096)]) if len(x) else np.empty(0)
            yield pd.DataFrame({"id": b["id"], "v": b["v"], "cost": np.maximum(d, 0).astype(float)})

    schema = StructType([StructField("id", LongType()), StructField("v", ArrayType(FloatType())), StructField("cost", DoubleType())])
    costs = vectors.mapInPandas(cost, schema)
    total = costs.agg(F.sum("cost")).first()[0] or 0.0
    if total <= 0:
        return costs.limit(0).select("v")
    # a draw that depends on the id alone: the same whenever a lost part is computed again
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return costs.where(draw < F.col("cost") * (want / total)).select("v")


def k_means(vectors: DataFrame, k: int, rounds: int = ROUNDS, seeding: int = SEEDING, seed: int = 1) -> np.ndarray:
    """Spherical k-means of ``id, v``: at most ``k`` centres, seeded by k-means|| and refined by ``rounds`` passes.

    A pass sums each partition's members per centre in the workers, so the shuffle carries at most one row for each
    centre and partition, whatever the skew.
    """
    spark = vectors.sparkSession
    centres = _to_driver(vectors.orderBy(F.xxhash64("id", F.lit(seed))).limit(1).select("v"))
    if not len(centres):
        return centres
    for n in range(seeding):
        more = _to_driver(_nearest_costs(vectors, centres, 2.0 * k / seeding, seed + n + 1))
        if len(more):
            centres = np.vstack([centres, more])
    for n in range(rounds + 1):
        shared = spark.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = shared.value
            total, count = np.zeros(c.shape, np.float64), np.zeros(len(c), np.int64)
            for b in batches:
                for at in range(0, len(b), 4096):
                    x = np.stack(b["v"].to_numpy()[at : at + 4096])
                    best = (x @ c.T).argmax(axis=1)
                    order = np.argsort(best, kind="stable")
                    first = np.flatnonzero(np.r_[True, np.diff(best[order]) > 0])
                    total[best[order][first]] += np.add.reduceat(x[order], first, axis=0)
                    count += np.bincount(best, minlength=len(c))
            own = np.flatnonzero(count)
            yield pd.DataFrame({"c": own.astype(np.int32), "n": count[own], "s": list(total[own])})

        schema = StructType([StructField("c", IntegerType()), StructField("n", LongType()), StructField("s", ArrayType(DoubleType()))])
        size = centres.shape[1]
        parts = vectors.mapInPandas(sums, schema).groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(size)]).alias("s"))
        rows = parts.orderBy("c").collect()
        weight, mean = np.array([r["n"] for r in rows], float), np.array([r["s"] for r in rows], float)
        mean /= np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
        if n == 0 and len(mean) > k:  # the oversampled seeds, weighted by what they attract, are themselves clustered to k
            mean = _weighted(mean, weight, k, seed)
        centres = mean.astype(np.float32)
    return centres


def _weighted(points: np.ndarray, weight: np.ndarray, k: int, seed: int, block: int = 1024) -> np.ndarray:
    """k centres of weighted points on the driver: a k-means++ choice, a few at a time, then two passes.

    Products are taken in blocks of ``block`` rows: beside the points (2k of them) at most ``block * k`` numbers are in memory.
    """
    rng = np.random.default_rng(seed)
    points = points.astype(np.float32)
    chosen = np.array([int(weight.argmax())])
    near = np.maximum(1 - points @ points[chosen[0]], 0).astype(float)
    while len(chosen) < k:
        p = near * weight
        some = np.count_nonzero(p)
        if not some:
            break
        more = rng.choice(len(points), min(max(1, k // 64), k - len(chosen), some), replace=False, p=p / p.sum())
        chosen = np.r_[chosen, more]
        for at in range(0, len(points), block):
            near[at : at + block] = np.minimum(near[at : at + block], np.maximum(1 - (points[at : at + block] @ points[more].T).max(axis=1), 0))
        near[more] = 0
    c = points[chosen]
    for _ in range(2):
        best = np.concatenate([(points[at : at + block] @ c.T).argmax(axis=1) for at in range(0, len(points), block)])
        s = np.zeros(c.shape)
        np.add.at(s, best, points * weight[:, None])
        norm = np.linalg.norm(s, axis=1)
        c = np.where(norm[:, None] > 0, s / np.maximum(norm, 1e-12)[:, None], c).astype(np.float32)
    return c


def leader_groups(ids: np.ndarray, x: np.ndarray, similar: float, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id of each vector's group, and which vectors are leaders; groups are the connected leaders' surroundings.

    A leader takes every vector within ``similar``, so a cell that is one hot group needs one pass; leaders that share
    a follower are one group.
    """
    order = np.argsort(ids, kind="stable")
    leaders = np.empty((0, x.shape[1]), np.float32)
    parent: list[int] = []

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    of, leads = np.empty(len(ids), np.int64), np.zeros(len(ids), bool)
    for at in range(0, len(order), block):
        part = order[at : at + block]
        y = x[part]
        close = y @ leaders.T >= similar if len(leaders) else np.zeros((len(part), 0), bool)
        free = np.flatnonzero(~close.any(axis=1))
        if len(free):
            within = y[free] @ y[free].T >= similar
            taken = np.zeros(len(free), bool)
            new = []
            for n in range(len(free)):
                if not taken[n]:
                    taken |= within[n]
                    new.append(n)
            parent += range(len(parent), len(parent) + len(new))
            leaders = np.vstack([leaders, y[free[new]]])
            leads[part[free[new]]] = True
            close = np.hstack([close, y @ y[free[new]].T >= similar])
            for n, k in enumerate(new):
                close[free[k], close.shape[1] - len(new) + n] = True  # itself, whatever the rounding
        first = close.argmax(axis=1)
        for n in np.flatnonzero(close.sum(axis=1) > 1):
            for k in np.flatnonzero(close[n])[1:]:
                a, b = root(int(first[n])), root(int(k))
                parent[max(a, b)] = min(a, b)
        of[part] = first
    roots = np.array([root(a) for a in range(len(parent))], np.int64)
    of = roots[of]
    least = np.full(len(parent), np.iinfo(np.int64).max)
    np.minimum.at(least, of, ids)
    return least[of], leads


def connected(links: DataFrame, most_rounds: int = 30) -> DataFrame:
    """``id, root``: the smallest id connected with each, over rows ``id, other``; both ends of a link get a row.

    Rounds of neighbours' smallest labels with pointer jumping, written to the shared folder each; the number of rounds
    grows with the logarithm of the longest chain.
    """
    both = materialise(links.where("id <> other").select("id", "other").unionByName(links.where("id <> other").select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct())
    label = materialise(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("root")))
    for _ in range(most_rounds):
        seen = both.join(label.select(F.col("id").alias("other"), "root"), "other").groupBy("id").agg(F.min("root").alias("near"))
        step = label.join(seen, "id").select("id", F.least("root", "near").alias("next"), "root")
        jump = label.select(F.col("id").alias("next"), F.col("root").alias("far"))
        new = materialise(step.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("root"), F.col("root").alias("old")))
        if not new.where("root <> old").limit(1).count():
            return new.select("id", "root")
        label = new.select("id", "root")
    raise RuntimeError(f"links were not connected in {most_rounds} rounds")


def cluster(df: DataFrame, id_col: str = "id", vector: str = "embedding", labels: Sequence[str] = (), similar: float = SIMILAR, seed: int = 1) -> DataFrame:
    """``id, cluster_id`` for every row of ``df`` with a usable vector; ``cluster_id`` is the smallest id of its cluster.

    Vectors of another length than the most frequent one aren't usable. Defined cases: null and unusable vectors have
    no row; equal vectors are one record in the work and all get its cluster; repeated ids give repeated rows; an empty
    table gives none; other columns are not looked at.
    """
    spark = df.sparkSession
    good = df.where(usable(vector))
    length = good.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    out = StructType([StructField("id", LongType()), StructField("cluster_id", LongType())])
    if not length:
        return spark.createDataFrame([], out)
    all_rows = materialise(vectorise(good.where(F.size(vector) == length[0]["n"]), id_col, vector, labels))
    keyed = all_rows.select("id", "v", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))
    same = keyed.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.min_by("v", "id").alias("v"))
    points = materialise(same.select(F.col("least").alias("id"), "v", "h1", "h2").repartition(parts_of(spark), "id"))
    n = points.count()
    k = min(MOST_CELLS, max(1, round(1.0 * math.sqrt(n))))
    centres = k_means(points.select("id", "v"), k, seed=seed)
    shared = spark.sparkContext.broadcast(centres)
    spread_over = min(SPREAD, len(centres))

    def nearest(x: np.ndarray) -> np.ndarray:
        return np.argpartition(-(x @ shared.value.T), spread_over - 1, axis=1)[:, :spread_over]

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros(len(shared.value), np.int64)
        for b in batches:
            for at in range(0, len(b), 4096):
                count += np.bincount(nearest(np.stack(b["v"].to_numpy()[at : at + 4096])).ravel(), minlength=len(count))
        yield pd.DataFrame({"cell": np.arange(len(count)), "n": count})

    # a hot cell is cut at random into parts of a bounded size; what leads the parts' groups then meets in the cell
    counted = points.select("v").mapInPandas(sizes, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    parts = np.ones(len(centres), np.int64)
    for r in counted:
        parts[r["cell"]] = math.ceil(max(1, r["n"]) / CELL_ROWS)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 4096):
                part = b.iloc[at : at + 4096]
                near = nearest(np.stack(part["v"].to_numpy())).ravel()
                ids = np.repeat(part["id"].to_numpy(), spread_over)
                salt = (ids * np.int64(0x9E3779B97F4A7C1) >> np.int64(20)) % parts[near]
                yield pd.DataFrame({"id": ids, "v": np.repeat(part["v"].to_numpy(), spread_over), "cell": near, "salt": salt})

    def groups(b: pd.DataFrame) -> pd.DataFrame:
        ids = b["id"].to_numpy()
        other, leads = leader_groups(ids, np.stack(b["v"].to_numpy()), similar)
        return pd.DataFrame({"cell": b["cell"].to_numpy(), "salt": b["salt"].to_numpy(), "id": ids, "other": other, "leads": leads})

    def across(b: pd.DataFrame) -> pd.DataFrame:
        left, right = b[b["salt"] == b["low"]], b[b["salt"] == b["high"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64")})
        x, y = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        found = []
        for at in range(0, len(x), 1024):
            r, c = np.nonzero(x[at : at + 1024] @ y.T >= similar)
            found.append(np.unique(np.c_[left["other"].to_numpy()[r + at], right["other"].to_numpy()[c]], axis=0))
        both = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"id": both[:, 0], "other": both[:, 1]})

    schema = StructType([StructField("id", LongType()), StructField("v", ArrayType(FloatType())), StructField("cell", LongType()), StructField("salt", LongType())])
    links = points.select("id", "v").mapInPandas(cells, schema).groupBy("cell", "salt").applyInPandas(groups, "cell long, salt long, id long, other long, leads boolean")
    hot = np.flatnonzero(parts > 1).tolist()
    if hot:  # the leaders of a hot cell's parts meet, two parts in a task
        links = materialise(links)
        n_parts = F.create_map(*[F.lit(int(x)) for c in hot for x in (c, parts[c])])[F.col("cell")]
        led = links.where(F.col("leads") & F.col("cell").isin(hot)).join(points.select("id", "v"), "id")
        led = led.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), n_parts.cast("long") - 1))).where("with <> salt")
        led = led.select("cell", "salt", "other", "v", F.least("salt", "with").alias("low"), F.greatest("salt", "with").alias("high"))
        links = links.select("id", "other").unionByName(led.groupBy("cell", "low", "high").applyInPandas(across, "id long, other long"))
    roots = connected(links.select("id", "other"))
    named = points.select("id", "h1", "h2").join(roots, "id", "left").select("h1", "h2", F.coalesce("root", "id").alias("cluster_id"))
    return keyed.select("id", "h1", "h2").join(named, ["h1", "h2"]).select("id", "cluster_id")


def describe(df: DataFrame, members: DataFrame, id_col: str = "id", vector: str = "embedding", typical: int = 5, least: int = 3) -> DataFrame:
    """``cluster_id, n_members, typical_ids``: each cluster of ``least`` members with those nearest its centroid.

    Sums and ranks are taken per cluster by aggregates; of each cluster only ``typical`` ids are kept while merging.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).join(members.select("id").distinct(), "id", "left_semi")
    x = members.join(vectorise(own, "id", "v"), "id")
    first = own.select(F.size("v").alias("n")).first()
    size = first["n"] if first else 0
    centre = x.groupBy("cluster_id").agg(F.count("*").alias("n_members"), F.array(*[F.avg(F.col("v")[i].cast("double")) for i in range(size)]).alias("c")).where(F.col("n_members") >= least)
    dot = F.aggregate(F.zip_with("v", "c", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    near = x.join(centre, "cluster_id").select("cluster_id", "n_members", "id", dot.alias("s"))
    # ranks limited to the first few, which are cut before the shuffle
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("s"), "id"))
    few = near.withColumn("rank", rank).where(F.col("rank") <= typical)
    return few.groupBy("cluster_id", "n_members").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("typical_ids"))
