"""Operators that score: confusion matrices, token F1, parameter sweeps, candidate signals and gates."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import words


def _clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def confusion(rows: DataFrame, actual: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 (4 digits) of two conditions; nulls count as false; zero where undefined."""
    a, p = F.coalesce(actual, F.lit(False)), F.coalesce(predicted, F.lit(False))
    out = rows.groupBy(*(by or [])).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    out = out.withColumns({"precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))})
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9))
    return out.withColumn("f1", f1).withColumns({c: F.round(c, 4) for c in ("precision", "recall")}).withColumn("f1", F.round("f1", 4))


def token_f1(rows: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """(key, f1): F1 of two texts as bags of lower-cased words; 0 if either has none."""
    x, y = words(F.coalesce(F.col(a), F.lit(""))), words(F.coalesce(F.col(b), F.lit("")))
    rows = rows.select(*key, x.alias("x"), y.alias("y"))
    count = lambda arr, w: F.size(F.filter(arr, lambda v: v == w))
    same = F.aggregate(F.array_distinct("x"), F.lit(0), lambda s, w: s + F.least(count(F.col("x"), w), count(F.col("y"), w)))
    rows = rows.withColumn("same", same)
    return rows.select(*key, F.when(F.size("x") + F.size("y") > 0, 2 * F.col("same") / (F.size("x") + F.size("y"))).otherwise(0.0).alias("f1"))


def sweep(rows: DataFrame, actual: Column, score: Column, grid: dict[str, list], predicted) -> DataFrame:
    """Confusion figures for every point of a parameter grid in one pass: each row meets the few grid points inside its
    own task, and counts are combined before the shuffle. ``predicted``: (score, parameter struct) -> condition."""
    points = [F.struct(*[F.lit(v).alias(k) for k, v in zip(grid, p, strict=True)]) for p in product(*grid.values())]
    flat = rows.select(actual.alias("__a"), score.alias("__s"), F.explode(F.array(*points)).alias("p"))
    flat = flat.select("__a", "__s", *[F.col(f"p.{k}").alias(k) for k in grid])
    return confusion(flat, F.col("__a"), predicted(F.col("__s"), F.col), list(grid))


# Weights of the six signals of a candidate, and the gates of automatic promotion.
SIGNAL_WEIGHTS = {"rank": 0.30, "size": 0.15, "sessions": 0.20, "weeks": 0.15, "specificity": 0.10, "density": 0.10}
GATE_SCORE, GATE_SESSIONS, GATE_WEEKS = 0.65, 2, 2


def candidate_score(rank: Column, size: Column, sessions: Column, weeks: Column, specificity: float = 0.5, density: float = 0.5) -> Column:
    """Weighted sum of six clamped signals; missing values count as 0."""
    z = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    parts = {"rank": z(rank) / 10, "size": z(size) / 20, "sessions": (z(sessions) - 1) / 4, "weeks": (z(weeks) - 1) / 7, "specificity": F.lit(specificity), "density": F.lit(density)}
    total = F.lit(0.0)
    for k, w in SIGNAL_WEIGHTS.items():
        total = total + F.lit(w) * _clamp(parts[k])
    return _clamp(total)


def gate(score: Column, sessions: Column, weeks: Column) -> Column:
    """Whether a candidate is promoted without review; all limits are inclusive."""
    return (score >= GATE_SCORE) & (sessions >= GATE_SESSIONS) & (weeks >= GATE_WEEKS)


def best_point(figures: DataFrame, grid: list[str], by: str = "f1") -> DataFrame:
    """The point of a sweep with the highest figure; of equal ones the first in the order of the grid."""
    return figures.orderBy(F.desc(by), *grid).limit(1)
