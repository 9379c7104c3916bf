"""Daily volumes per tenant: trends by label, and days that stand out.

Logs are reduced to sums per tenant and day before anything is ordered, so what
windows see is days, not rows; a tenant with most of the traffic has no more
days than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Moments of a value on a day: rows, sum and sum of squares.
MOMENTS = ("n", "s", "q")


def day_of(ts: Column) -> Column:
    """The UTC calendar day of a time, whatever the session's zone is."""
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))


def daily_moments(df: DataFrame, value: Column | None = None, *, tenant_col: str = "tenant_id", ts_col: str = "ts") -> DataFrame:
    """tenant, day, n, s, q: rows of a day, and sum and sum of squares of ``value`` in whole units.

    Sums are exact decimals, so moments of parts merge to those of the whole in
    any order.  Rows without a time are left out, null values count as rows only.
    """
    whole = (F.lit(0) if value is None else F.floor(value)).cast("decimal(18,0)")
    return (
        df.where(F.col(ts_col).isNotNull())
        .select(F.col(tenant_col).alias("tenant_id"), day_of(F.col(ts_col)).alias("day"), whole.alias("v"))
        .groupBy("tenant_id", "day")
        .agg(F.count("*").alias("n"), *_sums(F.col("v"), F.col("v") * F.col("v")))
    )


def _sums(s: Column, q: Column) -> list[Column]:
    zero = F.lit(0).cast("decimal(38,0)")
    return [F.coalesce(F.sum(c.cast("decimal(38,0)")), zero).cast("decimal(38,0)").alias(n) for n, c in (("s", s), ("q", q))]


def merge_moments(parts: DataFrame) -> DataFrame:
    """Moments of loads that were reduced one by one, merged per tenant and day."""
    return parts.groupBy("tenant_id", "day").agg(F.sum("n").alias("n"), *_sums(F.col("s"), F.col("q")))


def fill_days(days: DataFrame, last_day: Column | None = None) -> DataFrame:
    """The rows of ``days`` and one with zeros for each missing day of a tenant.

    A tenant's days run from its first to ``last_day``, by default the last day
    of all tenants: one that falls silent has empty days.
    """
    ends = days.agg(F.max("day").alias("_end")) if last_day is None else days.sparkSession.range(1).select(last_day.alias("_end"))
    end = ends.first()["_end"]
    spans = days.groupBy("tenant_id").agg(F.min("day").alias("_first")).where(F.col("_first") <= F.lit(end))
    grid = spans.select("tenant_id", F.explode(F.sequence("_first", F.lit(end).cast("date"), F.expr("INTERVAL 1 DAY"))).alias("day"))
    zero = {c: F.coalesce(c, F.lit(0)).cast(days.schema[c].dataType).alias(c) for c in MOMENTS}
    same = F.col("d.tenant_id").eqNullSafe(F.col("g.tenant_id")) & (F.col("d.day") == F.col("g.day"))
    return grid.alias("g").join(days.alias("d"), same, "left").select("g.tenant_id", "g.day", *zero.values())


def volume_anomalies(days: DataFrame, *, trailing_days: int = 7, threshold: float = 3.0, min_days: int = 3) -> DataFrame:
    """Per tenant and day of filled ``days``: volume, mean and deviation of the days before, z and whether it stands out.

    The frame is the ``trailing_days`` calendar days before the day.  z is the
    distance from their mean in (population) standard deviations, null where
    these are 0.  A day stands out if at least ``min_days`` came before and the
    distance is ``threshold`` deviations or more; behind equal days any other
    volume does.  The test is on whole numbers, without a rounded deviation.
    """
    order = F.unix_date("day")
    before = Window.partitionBy("tenant_id").orderBy(order).rangeBetween(-trailing_days, -1)
    x = F.col("n").cast("decimal(38,0)")
    framed = days.select(
        "tenant_id",
        "day",
        F.col("n").alias("volume"),
        F.count("*").over(before).alias("_k"),
        F.coalesce(F.sum(x).over(before), F.lit(0)).cast("decimal(38,0)").alias("_s"),
        F.coalesce(F.sum((x * x).cast("decimal(38,0)")).over(before), F.lit(0)).cast("decimal(38,0)").alias("_q"),
    )
    # k times the distance, and k squared times the variance
    gap = (F.col("_k") * F.col("volume")).cast("double") - F.col("_s").cast("double")
    spread = (F.col("_k") * F.col("_q") - F.col("_s") * F.col("_s")).cast("double")
    stands_out = (F.col("_k") >= min_days) & (gap != 0) & (gap * gap >= F.lit(float(threshold) ** 2) * spread)
    return framed.select(
        "tenant_id",
        "day",
        "volume",
        F.col("_k").alias("days_before"),
        F.try_divide(F.col("_s").cast("double"), F.col("_k")).alias("mean"),
        F.try_divide(F.sqrt(spread), F.col("_k")).alias("deviation"),
        F.when(spread > 0, gap / F.sqrt(spread)).alias("z"),
        stands_out.alias("anomalous"),
    )


def value_anomalies(days: DataFrame, *, trailing_days: int = 7, threshold: float = 3.0, min_rows: int = 30) -> DataFrame:
    """The same for a day's mean value against all rows of the trailing days, from their merged moments.

    z is the distance of the day's mean from the trailing rows' mean in standard
    errors of a mean over the day's rows; null without rows or without spread.
    """
    before = Window.partitionBy("tenant_id").orderBy(F.unix_date("day")).rangeBetween(-trailing_days, -1)
    merged = days.select("tenant_id", "day", *MOMENTS, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in MOMENTS])
    mean = F.try_divide(F.col("s").cast("double"), F.col("n"))
    usual = F.try_divide(F.col("_s").cast("double"), F.col("_n"))
    # n squared times the variance, in whole numbers until here
    spread = (F.col("_n").cast("decimal(18,0)") * F.col("_q") - F.col("_s") * F.col("_s")).cast("double")
    error = F.sqrt(spread) / F.col("_n") / F.sqrt(F.col("n").cast("double"))
    z = F.when((spread > 0) & (F.col("n") > 0) & (F.col("_n") > 0), (mean - usual) / error)
    return merged.select("tenant_id", "day", F.col("n").alias("volume"), mean.alias("mean"), usual.alias("usual"), z.alias("z")).withColumn(
        "anomalous", F.coalesce((F.abs("z") >= threshold), F.lit(False)) & (F.col("volume") >= min_rows)
    )


def tenant_trends(df: DataFrame, *, tenant_col: str = "tenant_id", label_col: str = "label", ts_col: str = "ts") -> DataFrame:
    """Messages per tenant, label and day with totals over each of them, shares and change to the day before.

    One aggregation gives all levels: ``level`` says which of tenant and label a
    row is about ("tenant label", "tenant", "label" or "all"), the others are
    null there.  ``share`` is the part of the day's messages of the row's tenant
    (of all, where it has none).  ``change`` compares with the calendar day
    before, which counts as 0 where it has no messages; it is null on the first
    day of the log.
    """
    counted = (
        df.where(F.col(ts_col).isNotNull())
        .select(
            F.coalesce(F.col(tenant_col).cast("string"), F.lit("")).alias("tenant_id"),
            F.coalesce(F.col(label_col).cast("string"), F.lit("")).alias("label"),
            day_of(F.col(ts_col)).alias("day"),
        )
        .groupBy("tenant_id", "label", "day")
        .agg(F.count("*").alias("n"))
    )
    sets = counted.groupingSets(
        [["tenant_id", "label", "day"], ["tenant_id", "day"], ["label", "day"], ["day"]], "tenant_id", "label", "day"
    ).agg(F.sum("n").alias("n"), F.grouping("tenant_id").alias("_t"), F.grouping("label").alias("_l"))
    level = F.concat_ws(" ", F.when(F.col("_t") == 0, "tenant"), F.when(F.col("_l") == 0, "label"))
    named = sets.withColumn("level", F.when(level == "", "all").otherwise(level))
    series = Window.partitionBy("level", "tenant_id", "label").orderBy("day")
    whole = Window.partitionBy("day", "tenant_id")
    first = F.min("day").over(Window.partitionBy("level"))
    before = F.when(F.lag("day").over(series) == F.date_sub("day", 1), F.lag("n").over(series)).otherwise(0)
    total = F.max(F.when(F.col("_l") == 1, F.col("n"))).over(whole)
    return named.select(
        "level", "tenant_id", "label", "day", "n",
        (F.col("n") / total).alias("share"),
        F.when(F.col("day") > first, F.col("n") - before).alias("change"),
    )
