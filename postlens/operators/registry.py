"""Model registry: an append-only table of training runs, and promotion without regression.

A run is promoted if it passes its task's gate and is not worse, on any key
metric, than the run of its task that was promoted last before it.  That run is
found by an as-of join.  A decision depends on those before it, so undecided runs
are decided in rounds, the earliest one of every task at a time; each round is
one join, whatever the number of tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..schemas import RUN
from ..session import materialize
from .metrics import promotion_gate

KEY_METRICS = ("precision", "recall", "f1")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str = "at", order: str = "run_id", name: str = "base") -> DataFrame:
    """``left`` with ``name``: the row of ``right`` (a struct, or null) with the latest (at, order) before its own.

    Both sides are ordered together once per key, with no pairs of rows.
    """
    mine, theirs = F.struct(*left.columns), F.struct(*right.columns)
    both = (
        left.select(*keys, at, order, F.lit(1).alias("_side"), mine.alias("_l"), F.lit(None).cast(right.select(theirs.alias("r")).schema["r"].dataType).alias("_r"))
        .unionAll(right.select(*keys, at, order, F.lit(0).alias("_side"), F.lit(None).cast(left.select(mine.alias("l")).schema["l"].dataType), theirs.alias("_r")))
    )
    before = Window.partitionBy(*keys).orderBy(at, order, F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn(name, F.last("_r", ignorenulls=True).over(before))
    return found.where("_side = 1").select("_l.*", name)


def refuse_regressions(gated: DataFrame, decided: DataFrame, metrics: Sequence[str] = KEY_METRICS, tolerance: float = 0.0) -> DataFrame:
    """``gated`` runs with ``promoted`` and ``failure_reason`` that also look at the last promoted run before each.

    A metric that is null where the other run has one counts as worse.
    """
    last = as_of(gated, decided.where("promoted"), ["task"])
    worse, told = F.lit(False), []
    for m in metrics:
        had = F.col(f"base.{m}")
        falls = F.coalesce(F.col(m) < had - F.lit(tolerance), had.isNotNull() & F.col(m).isNull())
        worse = worse | falls
        now = F.when(F.col(m).isNull(), "missing").otherwise(F.format_string("%.4f", F.col(m)))
        told.append(F.when(falls, F.concat(F.lit(f"{m}="), now, F.lit(" (was "), F.format_string("%.4f", had), F.lit(" in "), F.col("base.run_id"), F.lit(")"))))
    reason = F.concat_ws(", ", F.when(F.col("failure_reason") != "", F.col("failure_reason")), *told)
    return last.select(
        *[c for c in gated.columns if c not in ("promoted", "failure_reason")],
        (F.col("promoted") & ~worse).alias("promoted"),
        F.when(F.col("promoted") & ~worse, F.lit("")).otherwise(reason).alias("failure_reason"),
    )


def decide_runs(
    runs: DataFrame, gates: DataFrame, registry: DataFrame | None = None, *, tolerance: float = 0.0
) -> DataFrame:
    """The undecided ``runs`` (task, run_id, at and metrics) with their decisions, by time and then by id.

    ``registry`` holds earlier decisions.  Runs that it has already, by task and
    id, are left out, so a repeated load decides nothing twice; of a run that
    stands in ``runs`` several times one row is taken.
    """
    spark = runs.sparkSession
    columns = [f.name for f in RUN.fields[:-2]]
    registry = spark.createDataFrame([], RUN) if registry is None else registry.select(*RUN.names)
    new = runs.select(*columns).dropDuplicates(["task", "run_id"]).join(registry.select("task", "run_id"), ["task", "run_id"], "left_anti")
    turn = F.row_number().over(Window.partitionBy("task").orderBy("at", "run_id"))
    gated = materialize(promotion_gate(new, gates).withColumn("_turn", turn), "gated-runs")
    decided = spark.createDataFrame([], RUN)
    for i in range(1, (gated.agg(F.max("_turn").alias("n")).first()["n"] or 0) + 1):
        step = refuse_regressions(gated.where(F.col("_turn") == i).drop("_turn"), registry.unionByName(decided), tolerance=tolerance)
        decided = materialize(decided.unionByName(step.select(*RUN.names)), "decided-runs")
    return decided


def register_runs(runs: DataFrame, gates: DataFrame, path: str, *, tolerance: float = 0.0) -> DataFrame:
    """Decide ``runs`` against the registry at ``path`` and append the decisions to it; returns these."""
    decided = decide_runs(runs, gates, read_registry(runs.sparkSession, path), tolerance=tolerance)
    decided.write.mode("append").parquet(path)
    return decided


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """All decisions; an empty table where there is none yet."""
    try:
        return spark.read.schema(RUN).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUN)


def last_promoted(registry: DataFrame) -> DataFrame:
    """The run in use of each task."""
    latest = F.max_by(F.struct(*RUN.names[1:-2]), F.struct("at", "run_id"))
    return registry.where("promoted").groupBy("task").agg(latest.alias("_r")).select("task", "_r.*")
