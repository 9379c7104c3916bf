"""Review queue: per tenant, the most confident spam verdicts that users have contradicted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Parts that a tenant's rows are dealt to before the last choice.
SALTS = 32


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """``df`` cut to the first ``k`` rows of each key, with ``rank`` from 1.

    A task keeps at most ``k`` rows of a key before the shuffle (a group limit),
    and so does each salted part of a key, so one key with most of the rows is
    no task of its own.  The result of parts, put together, may be cut again.
    """
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    for parts in ([*keys, "_salt"], list(keys)):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*parts).orderBy(*order))).where(F.col("rank") <= k)
    return salted.drop("_salt")


def false_positives(contradicted: DataFrame, *, said: str = "not spam", label: str = "spam") -> DataFrame:
    """Rows of joined feedback where the model said ``label`` and the user ``said``."""
    return contradicted.where((F.col("label") == label) & (F.trim(F.lower("feedback")) == said))


def review_queue(contradicted: DataFrame, k: int = 100, *, id_col: str = "message_id") -> DataFrame:
    """The ``k`` most confident false positives of each tenant, ranked; a null confidence comes last.

    ``contradicted`` is feedback joined to what was predicted: tenant_id, the id,
    label, feedback and confidence.  A message that several users contradict
    stands once, with ``reports``, their number, and its largest confidence;
    equal confidences go to more reports, then to the smaller id.
    """
    wrong = false_positives(contradicted).groupBy("tenant_id", id_col).agg(
        F.max("confidence").alias("confidence"), F.count("*").alias("reports")
    )
    order = [F.col("confidence").desc_nulls_last(), F.col("reports").desc(), F.col(id_col)]
    return top_per_key(wrong, ["tenant_id"], order, k)
