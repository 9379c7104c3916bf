"""Evaluate predictions of several models and gate their promotion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..operators import metrics as m
from ..sources.files import write_report

KEYS = ("model", "task")


def evaluate(
    predictions: DataFrame,
    gates: DataFrame,
    *,
    latencies: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
    report_path: str | None = None,
) -> DataFrame:
    """One report row per model: quality, ranking and latency metrics and the gate."""
    quality = m.classification_metrics(predictions, keys)
    if "y_score" in predictions.columns:
        quality = quality.join(m.ranking_metrics(predictions, keys), list(keys), "left")
    if latencies is not None:
        quality = quality.join(m.latency_metrics(latencies, keys), list(keys), "left")
    report = m.promotion_gate(quality, gates)
    if report_path is not None:
        write_report(report, report_path)
    return report


def summarizer_report(rouge: DataFrame, model: str) -> DataFrame:
    """A summariser is always promoted; a low ROUGE-1 only leaves a remark."""
    low = F.col("rouge1") < fixed.MIN_ROUGE1
    return rouge.select(
        F.lit(model).alias("model"),
        F.lit(fixed.TASK_SUMMARY).alias("task"),
        "*",
        F.lit(True).alias("promoted"),
        F.when(low, "ROUGE-1 too low").otherwise("").alias("failure_reason"),
    )
