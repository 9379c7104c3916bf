"""Percentiles from quantile sketches that merge: per task and window, upwards, and on a stream.

A KLL sketch is a column like any other.  It is built next to the exact counts
in one aggregation, stored, and merged later into those of longer windows, other
keys or later loads, without a look at the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import broadcast_if_small

#: Size of the sketches: rank errors of about 0.4 % at 99 % confidence, some 6 KB a sketch.
K = 800
SHARES = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}


def latency_sketches(
    df: DataFrame,
    keys: Sequence[str] = ("task_type",),
    *,
    window: str | None = "1 hour",
    latency_col: str = "latency_ms",
    ts_col: str = "ts",
    delay: str | None = None,
    k: int = K,
) -> DataFrame:
    """keys, window_start, n, total_ms and sketch per key and window; null latencies play no part.

    With ``delay`` the rows are a stream, whose windows come out as the
    watermark passes them.  Without ``window`` there is one sketch per key.
    """
    value = F.col(latency_col).cast("double")
    rows = df.withWatermark(ts_col, delay) if delay else df
    parts = list(keys) if window is None else [*keys, F.window(ts_col, window).alias("_w")]
    made = rows.where(value.isNotNull()).groupBy(*parts).agg(
        F.count("*").alias("n"), F.sum(value).alias("total_ms"), F.kll_sketch_agg_double(value, k).alias("sketch")
    )
    start = [] if window is None else [F.col("_w.start").alias("window_start")]
    return made.select(*keys, *start, "n", "total_ms", "sketch")


def merge_sketches(sketches: DataFrame, keys: Sequence[str] = (), k: int = K) -> DataFrame:
    """One row per key from the rows of :func:`latency_sketches`, of any windows and loads.

    To merge into longer windows, add the longer window's start as a key.
    """
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("total_ms").alias("total_ms"), F.kll_merge_agg_double("sketch", k).alias("sketch")
    )


def sketch_percentiles(sketches: DataFrame, keys: Sequence[str], shares: dict[str, float] | None = None) -> DataFrame:
    """keys, n, mean_ms and a column per share: a value whose rank is about that share of the rows."""
    found = [
        F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(s))).alias(c) for c, s in (shares or SHARES).items()
    ]
    return sketches.select(*keys, "n", F.try_divide("total_ms", "n").alias("mean_ms"), *found)


def rank_errors(
    df: DataFrame, found: DataFrame, keys: Sequence[str], *, latency_col: str = "latency_ms", shares: dict[str, float] | None = None
) -> DataFrame:
    """How far each percentile's true rank among the rows of ``df`` is from its share, as a share of the rows.

    A value that stands for several equal rows has all of their ranks; the
    nearest counts.  ``found`` has a row per key.
    """
    shares = shares or SHARES
    value = F.col(latency_col).cast("double")
    rows = df.where(value.isNotNull()).select(*keys, value.alias("_v")).join(broadcast_if_small(found.select(*keys, *shares)), list(keys))
    counts: list[Column] = []
    for c in shares:
        counts += [F.count_if(F.col("_v") < F.col(c)).alias(f"_lt_{c}"), F.count_if(F.col("_v") <= F.col(c)).alias(f"_le_{c}")]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *counts)
    far = [
        F.greatest(F.lit(0.0), F.col(f"_lt_{c}") / F.col("n") - F.lit(s), F.lit(s) - F.col(f"_le_{c}") / F.col("n")).alias(c)
        for c, s in shares.items()
    ]
    return sums.select(*keys, "n", *far)
