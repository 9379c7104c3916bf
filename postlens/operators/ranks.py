"""Exact running totals, percentiles and rank cuts without one-task groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import broadcast_if_small, materialize

_BUCKETS = 256


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: Sequence[str],
    *,
    descending: bool = False,
    buckets: int = _BUCKETS,
) -> DataFrame:
    """Running sums of ``measures`` over the distinct values of ``value`` per key.

    One row per (keys, value): the measures, ``cum_<m>`` up to and including
    the value, and ``total_<m>`` of the key.  A plain window over the keys would
    sort a whole key in one task.  Here the input is first summed per distinct
    value (map-side), the distinct values are cut into buckets of about equal
    size, sums run within a bucket, and the bucket's offset is added.
    """
    keys = list(keys)
    hist = df.groupBy(*keys, value).agg(*[F.sum(m).alias(m) for m in measures])
    hist = materialize(hist, "hist")
    cuts = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    bounds = hist.groupBy(*keys).agg(F.percentile_approx(value, cuts, F.lit(10 * buckets)).alias("_bounds"))
    # A value's bucket is the number of bounds below it, counted in two steps:
    # among every ``step``-th bound, then among the few that follow.
    step = math.isqrt(buckets - 1) + 1
    every = F.sequence(F.lit(step), F.lit(buckets - 1), F.lit(step)) if step < buckets else F.array().cast("array<int>")
    bounds = bounds.withColumn("_coarse", F.transform(every, lambda i: F.element_at("_bounds", i)))

    def below(limits):
        return F.size(F.filter(limits, lambda b: b < F.col(value)))

    parts = hist.join(broadcast_if_small(bounds), keys).withColumn("_skip", below("_coarse") * step)
    fine = F.slice("_bounds", F.col("_skip") + 1, F.lit(step - 1))
    parts = parts.withColumn("_bucket", F.col("_skip") + below(fine)).drop("_bounds", "_coarse", "_skip")

    def order(c):
        return F.col(c).desc() if descending else F.col(c)

    sums = parts.groupBy(*keys, "_bucket").agg(*[F.sum(m).alias(m) for m in measures])
    earlier = Window.partitionBy(*keys).orderBy(order("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = sums.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_before_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"total_{m}") for m in measures],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    )
    run = parts.withColumns({f"_in_{m}": F.sum(m).over(inside) for m in measures})
    return run.join(offsets, [*keys, "_bucket"]).select(
        *keys,
        value,
        *measures,
        *[(F.col(f"_before_{m}") + F.col(f"_in_{m}")).alias(f"cum_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
    )


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], *, buckets: int = _BUCKETS
) -> DataFrame:
    """Linearly interpolated percentiles per key, one column per entry of ``shares``."""
    counted = df.where(F.col(value).isNotNull()).withColumn("n", F.lit(1))
    totals = running_totals(counted, keys, value, ["n"], buckets=buckets)

    def at(index):
        # The value that covers the zero-based position ``index``.
        return F.max(F.when((F.col("cum_n") - F.col("n") <= index) & (index < F.col("cum_n")), F.col(value)))

    found = []
    for name, share in shares.items():
        position = (F.col("total_n") - 1) * F.lit(share)
        found.append(at(F.floor(position)).alias(f"_lo_{name}"))
        found.append(at(F.ceil(position)).alias(f"_hi_{name}"))
    per_key = totals.groupBy(*keys).agg(F.max("total_n").alias("_n"), *found)

    def interpolate(name, share):
        position = (F.col("_n") - 1) * F.lit(share)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (low + (high - low) * (position - F.floor(position))).alias(name)

    return per_key.select(*keys, *[interpolate(n, s) for n, s in shares.items()])
