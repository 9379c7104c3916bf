"""Fixed windows that re-anchor: a window starts at the first request a full length or more after the last start.

Where a window starts depends on where the one before started, which is a chain.
It is not walked: every request time gets a pointer to the first time a length
later, and pointers are doubled (one step, two, four, ...) while the set of
starts doubles its reach, so a chain of n windows takes about log2(n) joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import broadcast_if_small, materialize

#: Widths in microseconds of the buckets in which the next time is looked up: a second, then a day.
_WIDTHS = (1_000_000, 86_400_000_000)


def next_times(times: DataFrame, asked: DataFrame, widths: Sequence[int] = _WIDTHS) -> DataFrame:
    """x and next, the smallest ``t`` of ``times`` at or after each different ``x``; none for x beyond the last.

    Both are sorted within small buckets of time.  What finds nothing in its own
    bucket looks at the buckets' first times in the next wider ones, and at last
    at the days.  A bucket of the first width holds no more different
    microseconds than it is wide, however many requests there are.
    """
    bucket = F.floor(F.col("x") / widths[0]) if widths else F.lit(0)
    none = F.lit(None).cast("long")
    both = times.select(F.col("t").alias("x"), "t").unionByName(asked.select("x", none.alias("t")).distinct())
    # from the latest down, a time before what asks for just that time
    down = Window.partitionBy("b").orderBy(F.col("x").desc(), F.col("t").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    looked = both.withColumn("b", bucket).withColumn("next", F.last("t", ignorenulls=True).over(down)).where("t IS NULL")
    if not widths:
        return looked.where("next IS NOT NULL").select("x", "next")
    looked = materialize(looked.select("x", "b", "next"), "next-in-bucket")
    beyond = (F.col("b") + 1) * widths[0]
    open_ = looked.where("next IS NULL").select("x", beyond.alias("from"))
    firsts = times.groupBy(F.floor(F.col("t") / widths[0]).alias("b")).agg(F.min("t").alias("t")).select("t")
    later = next_times(firsts, open_.select(F.col("from").alias("x")), widths[1:]).withColumnRenamed("x", "from")
    return looked.where("next IS NOT NULL").select("x", "next").unionByName(open_.join(later, "from").select("x", "next"))


def window_starts(df: DataFrame, ts_col: str, window_seconds: int, start: Column | None = None) -> DataFrame:
    """a: the starts, in microseconds, of the re-anchoring windows over the request times of ``df``.

    The first is ``start``, a literal time such as that of the server's start,
    or the first request.  Requests without a time, or before ``start``, play no
    part.
    """
    length = window_seconds * 1_000_000
    times = df.select(F.unix_micros(F.col(ts_col)).alias("t")).where("t IS NOT NULL").distinct()
    if start is not None:
        first = F.unix_micros(start)
        times = times.where(F.col("t") >= first).unionByName(df.sparkSession.range(1).select(first.alias("t"))).distinct()
    times = materialize(times, "request-times")
    found = next_times(times, times.select((F.col("t") + length).alias("x")))
    jump = materialize(found.select((F.col("x") - length).alias("t"), F.col("next").alias("to")), "jumps-0")
    reached = materialize(times.agg(F.min("t").alias("a")).where("a IS NOT NULL"), "starts-0")
    count, step = reached.count(), 0
    while True:
        step += 1
        ahead = reached.join(jump, F.col("a") == F.col("t")).select(F.col("to").alias("a"))
        reached = materialize(reached.unionByName(ahead).distinct(), f"starts-{step}")
        before, count = count, reached.count()
        if count == before:
            return reached
        twice = jump.alias("one").join(jump.alias("two"), F.col("one.to") == F.col("two.t"))
        jump = materialize(twice.select("one.t", "two.to"), f"jumps-{step}")


def with_window_start(
    df: DataFrame, ts_col: str, window_seconds: int, name: str, start: Column | None = None
) -> DataFrame:
    """Add ``name``: the start, in microseconds, of the request's window; null without a time or before ``start``.

    Starts are a length or more apart, so a calendar window holds one at most,
    and a request's start lies in its own calendar window or the one before.
    """
    length = window_seconds * 1_000_000
    starts = window_starts(df, ts_col, window_seconds, start)
    cell = F.floor(F.col("a") / length)
    places = starts.select(
        "a", F.explode(F.array(F.struct(cell.alias("c"), F.lit(True).alias("own")), F.struct((cell + 1).alias("c"), F.lit(False).alias("own")))).alias("p")
    )
    cells = places.groupBy(F.col("p.c").alias("_cell")).agg(
        F.max(F.when(F.col("p.own"), F.col("a"))).alias("_own"), F.max(F.when(~F.col("p.own"), F.col("a"))).alias("_before")
    )
    at = F.unix_micros(F.col(ts_col))
    placed = df.withColumn("_cell", F.floor(at / length)).join(broadcast_if_small(cells), "_cell", "left")
    value = F.when(at >= F.col("_own"), F.col("_own")).otherwise(F.col("_before"))
    return placed.select(*df.columns, value.alias(name))
