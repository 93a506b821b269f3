"""Scores of trends from search volume, engagement and coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ceilings:
    """Values that score 100, by component: search volume, engagement, news posts."""

    g: float
    f: float
    n: float


BATCH, STREAM, SEED = Ceilings(1e6, 2e4, 10), Ceilings(5.01e6, 2e4, 10), Ceilings(2e7, 1e5, 10)
#: Weights of the components.
WEIGHTS = (0.40, 0.35, 0.25)


def log_score(v: Column, ceiling: float) -> Column:
    """0 to 100 on a logarithmic scale that ends at ``ceiling``."""
    v = v.cast("double")
    return F.when(v > 0, F.least(F.lit(100.0), 100.0 * F.log10(v + 1) / F.log10(F.lit(ceiling + 1)))).otherwise(0.0)


def synergy(g: Column, f: Column, n: Column, floor: float = 10.0) -> Column:
    """1.2 if all components are above the floor, 1.1 if two are."""
    k = sum(((x > floor).cast("int") for x in (g, f, n)), F.lit(0))
    return F.when(k == 3, 1.2).when(k == 2, 1.1).otherwise(1.0)


def decay(days: Column, rate: float = 0.8) -> Column:
    """How much a score counts after so many days between trend and posts; 1 without a time."""
    return F.when(days.isNull(), 1.0).otherwise(F.pow(F.lit(rate), F.abs(days)))


def interactions(likes: Column, comments: Column, shares: Column) -> Column:
    return likes + 2 * comments + 3 * shares


def unified(g_vol: Column, engaged: Column, posts: Column, days: Column | None = None, ceilings: Ceilings = BATCH) -> Column:
    """The score of all components with synergy and decay, at most 100."""
    g, f, n = log_score(g_vol, ceilings.g), log_score(engaged, ceilings.f), log_score(posts, ceilings.n)
    base = WEIGHTS[0] * g + WEIGHTS[1] * f + WEIGHTS[2] * n
    score = base * synergy(g, f, n)
    return F.least(F.lit(100.0), score * decay(days) if days is not None else score)


def two_classes(g: Column, f: Column, n: Column) -> Column:
    return F.when((f > 40) | (n > 40) | ((g > 40) & ((f > 15) | (n > 15))), "Trending").otherwise("Emerging / Noise")


def linear_score(v: Column, ceiling: float = 50.0) -> Column:
    return F.least(F.lit(100.0), 100.0 * v / ceiling)


def seven_classes(g: Column, f: Column, n: Column, floor: float = 40.0) -> Column:
    """By which sources drive a trend."""
    a, b, c = g > floor, f > floor, n > floor
    return (
        F.when(a & b & c, "Strong Multi-source").when(a & b, "Search & Social").when(b & c, "Social & News")
        .when(b, "Social-Driven").when(c, "News-Driven").when(a, "Search-Driven").otherwise("Emerging")
    )
