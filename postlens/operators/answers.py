"""What became of inferences: feedback within an interval, acceptance rate and cost.

One join serves a table and a stream.  On a stream both sides carry a watermark,
so the state of an inference is dropped once its interval has closed, and one
without feedback comes out then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

KEY = ("tenant_id", "message_id")


def link_feedback(
    inferences: DataFrame, feedback: DataFrame, *, within: str = "1 hour", delays: tuple[str, str] | None = None
) -> DataFrame:
    """Each inference with each feedback on its message from its time to ``within`` later; once without, if none came.

    Inferences have tenant_id, message_id, inference_id, ts, cost_usd; feedback
    has tenant_id, message_id, feedback_id, feedback, ts.  ``delays`` are the
    watermarks of the two streams.
    """
    left = inferences.select(*KEY, "inference_id", "ts", "cost_usd")
    right = feedback.select(
        *[F.col(k).alias(f"_{k}") for k in KEY], "feedback_id", "feedback", F.col("ts").alias("answered_at")
    )
    if delays is not None:
        left, right = left.withWatermark("ts", delays[0]), right.withWatermark("answered_at", delays[1])
    fits = (F.col("answered_at") >= F.col("ts")) & (F.col("answered_at") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    for k in KEY:
        fits = (F.col(k) == F.col(f"_{k}")) & fits
    return left.join(right, fits, "left_outer").drop(*[f"_{k}" for k in KEY])


def first_answers(linked: DataFrame) -> DataFrame:
    """One row per inference with its earliest feedback; of one time, that with the smallest id."""
    answer = F.min_by(F.struct("feedback_id", "feedback", "answered_at"), F.struct("answered_at", "feedback_id"))
    facts = F.any_value(F.struct("ts", "cost_usd"))
    merged = linked.groupBy(*KEY, "inference_id").agg(facts.alias("_f"), answer.alias("_a"))
    return merged.select(*KEY, "inference_id", "_f.*", "_a.*")


def acceptance(
    answers: DataFrame, keys: Sequence[str] = ("tenant_id",), *, accepted: Sequence[str] = ("accepted",)
) -> DataFrame:
    """Inferences, answered and accepted ones, rates, and cost per inference and per accepted one.

    The rate is over answered inferences and null without any; so is the cost
    per accepted inference.
    """
    told = F.col("feedback").isNotNull()
    yes = F.col("feedback").isin(*accepted)
    cost = F.coalesce(F.col("cost_usd"), F.lit(0.0))
    sums = answers.groupBy(*keys).agg(
        F.count("*").alias("inferences"), F.count_if(told).alias("answered"), F.count_if(yes).alias("accepted"),
        F.sum(cost.cast("decimal(38,9)")).cast("double").alias("cost_usd"),
    )
    return sums.select(
        *keys,
        "inferences",
        "answered",
        "accepted",
        F.try_divide("accepted", "answered").alias("acceptance_rate"),
        "cost_usd",
        (F.col("cost_usd") / F.col("inferences")).alias("cost_per_inference"),
        F.try_divide("cost_usd", "accepted").alias("cost_per_accepted"),
    )
