"""Scores and labels, as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def risk(direct, indirect, areas_calling, total_areas, test_ratio) -> Column:
    weighted = col(direct) + 0.4 * col(indirect)
    spread = col(areas_calling) / F.greatest(col(total_areas), F.lit(1))
    return weighted * spread / F.greatest(col(test_ratio), F.lit(0.05))


def bucket(score, *cuts: tuple[float, str], otherwise: str = "LOW") -> Column:
    out = F
    for least, label in cuts:
        out = out.when(col(score) >= least, label)
    return out.otherwise(otherwise)


def risk_label(score) -> Column:
    return bucket(score, (10.0, "HIGH"), (3.0, "MEDIUM"))


def silo_label(score) -> Column:
    return bucket(score, (20.0, "CRITICAL"), (8.0, "HIGH"), (3.0, "MEDIUM"))


def gap_label(score) -> Column:
    return bucket(score, (100.0, "CRITICAL"), (25.0, "HIGH"), (5.0, "MEDIUM"))


def complexity(spread, callers) -> Column:
    s, c = col(spread), col(callers)
    return F.when((s >= 3) | (c >= 10), "HIGH").when((s >= 2) | (c >= 4), "MEDIUM").otherwise("LOW")


def relevance(similarity, is_seed) -> Column:
    return 0.6 * col(similarity) + 0.4 * F.when(col(is_seed), 1.0).otherwise(0.5)


def similarity(distance, metric: str = "l2") -> Column:
    """1 - d as the search returns it, or the cosine of unit vectors."""
    d = col(distance)
    return F.greatest(F.lit(0.0), 1 - d if metric == "l2" else 1 - d * d / 2)


def decay(age_days, changed, half_life: float = 70.0, penalty: float = 0.3) -> Column:
    days = F.greatest(col(age_days).cast("double"), F.lit(0.0))
    score = F.exp(-days * (math.log(2) / half_life)) * F.when(col(changed), penalty).otherwise(1.0)
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def decay_status(score, stale: float = 0.1, possibly: float = 0.3) -> Column:
    return F.when(col(score) < stale, "stale").when(col(score) < possibly, "possibly_stale").otherwise("active")


def trend(delta) -> Column:
    return F.when(col(delta) > 0.001, "up").when(col(delta) < -0.001, "down").otherwise("stable")
