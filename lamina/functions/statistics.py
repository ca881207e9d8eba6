"""Rates, intervals, drift and quantiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Two-sided 95 % points of Student's t by degrees of freedom.
T_95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228}
Z_95 = 1.96


def wilson(hits: Column, n: Column, z: float = Z_95) -> Column:
    """Low and high end of the score interval of a rate; null without trials."""
    p = hits / n
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.struct(((middle - spread) / (1 + z * z / n)).alias("low"), ((middle + spread) / (1 + z * z / n)).alias("high")))


def t_interval(n: Column, deviation: Column) -> Column:
    """Half width of the 95 % interval of a mean; the normal point beyond the table."""
    point = F.coalesce(*[F.when(n - 1 == d, F.lit(t)) for d, t in T_95.items()], F.lit(Z_95))
    return F.when(n > 1, point * deviation / F.sqrt(n))


def drift_ratio(recent: Column, baseline: Column) -> Column:
    return F.abs(1 - F.try_divide(recent, baseline))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def bucket_quantile(q: float, buckets: Column) -> Column:
    """Quantile from cumulative buckets, array<struct<le, n>> with le null for the open one, linear inside a bucket.

    In the open bucket it is the last bound; null without observations.
    """
    closed = F.array_sort(F.filter(buckets, lambda b: b.le.isNotNull()))
    total = F.array_max(F.transform(buckets, lambda b: b.n))
    rank = q * total
    hit = F.array_min(F.filter(F.transform(closed, lambda b, i: F.struct(i.alias("i"), b.alias("b"))), lambda e: e.b.n >= rank))
    before = F.get(closed, hit.i - 1)
    low, done = F.when(hit.i > 0, before.le).otherwise(F.lit(0.0)), F.when(hit.i > 0, before.n).otherwise(F.lit(0))
    inside = low + (hit.b.le - low) * F.try_divide(rank - done, (hit.b.n - done).cast("double"))
    return F.when(total > 0, F.coalesce(inside, F.array_max(F.transform(closed, lambda b: b.le))))
