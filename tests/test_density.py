"""Density clusters of groups that are too large for one task."""

import numpy as np

from trendloom.operators import density


def test_large_groups_are_clustered_as_in_one_task(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = np.vstack([r.normal(0, 0.02, (60, 4)), r.normal([0.45, 0, 0, 0], 0.02, (70, 4)), r.normal([5, 0, 0, 0], 0.03, (45, 4)), r.uniform(-9, 9, (20, 4)) + 20])
    order = r.permutation(len(x))
    rows = [(n, "large", x[k].tolist()) for n, k in enumerate(order)] + [(1000 + n, None, x[k].tolist()) for n, k in enumerate(order[:140])] + [(2000 + n, "small", x[k].tolist()) for n, k in enumerate(order[:90])]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>")
    args = {"least_samples": 3, "radius": 0.5, "least_size": 5, "most_size": 75, "least_cohesion": 0.0}
    want = sorted(map(str, density.density_clusters(df, "id", "v", "g", **args).collect()))
    monkeypatch.setattr(density, "MOST_ROWS", 110)
    got = sorted(map(str, density.density_clusters(df, "id", "v", "g", **args).collect()))
    assert got == want and len({y.split("g=")[1] for y in want}) >= 9
