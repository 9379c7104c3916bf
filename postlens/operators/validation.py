"""Data-set validation: row verdicts, one-row reports, first issues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from .. import fixed
from ..functions.text import as_text, strip_space
from .corpus import digest

ERRORS = ("missing_text", "missing_label", "text_not_string", "unexpected_label", "missing_summary")
WARNINGS = ("too_short", "dialogue_too_short", "summary_too_short")
VALID = "valid"


def _first_of(rules: Sequence[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(cond, F.lit(name)) for cond, name in rules], F.lit(VALID))


def record_verdicts(
    df: DataFrame,
    *,
    text_col: str = "text",
    label_col: str = "label",
    expected_labels: Sequence[int] | None = None,
    min_chars: int = fixed.VALIDATE_MIN_CHARS,
) -> DataFrame:
    """Add ``verdict``: the first rule a record breaks, or ``valid``."""
    is_string = isinstance(df.schema[text_col].dataType, StringType)
    text, label = F.col(text_col), F.col(label_col)
    rules = [(text.isNull(), "missing_text"), (label.isNull(), "missing_label")]
    if is_string:
        rules.append((F.length(strip_space(text)) < min_chars, "too_short"))
    else:
        rules.append((F.lit(True), "text_not_string"))
    if expected_labels is not None:
        rules.append((~label.isin(*expected_labels), "unexpected_label"))
    return df.withColumn("verdict", _first_of(rules))


def pair_verdicts(
    df: DataFrame,
    *,
    text_col: str = "text",
    summary_col: str = "summary",
    min_text_chars: int = fixed.MIN_DIALOGUE_CHARS,
    min_summary_chars: int = fixed.MIN_SUMMARY_CHARS,
) -> DataFrame:
    text, summary = F.col(text_col), F.col(summary_col)
    rules = [
        (text.isNull(), "missing_text"),
        (summary.isNull(), "missing_summary"),
        (F.length(strip_space(as_text(text))) < min_text_chars, "dialogue_too_short"),
        (F.length(strip_space(as_text(summary))) < min_summary_chars, "summary_too_short"),
    ]
    return df.withColumn("verdict", _first_of(rules))


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def validation_report(
    verdicts: DataFrame,
    *,
    text_col: str = "text",
    label_col: str = "label",
    max_imbalance: float = fixed.MAX_IMBALANCE_RATIO,
    max_duplicate_rate: float = fixed.MAX_DUPLICATE_RATE,
) -> DataFrame:
    """The report row of :func:`record_verdicts` output.

    Records are first counted per (verdict, label, text digest), which combines
    copies before the shuffle.  A text counts once across labels: its rows
    beyond the first are duplicates.
    """
    valid = F.col("verdict") == VALID
    copies = (
        verdicts.select("verdict", F.when(valid, F.col(label_col)).alias("label"), F.when(valid, digest(F.col(text_col))).alias("_digest"))
        .groupBy("_digest", "verdict", "label")
        .agg(F.count("*").alias("n"))
    )
    by_label = copies.groupBy("verdict", "label").agg(F.sum("n").alias("n"))
    label_side = by_label.select(
        "verdict", "label", "n", F.lit(None).cast("bigint").alias("distinct_texts")
    )
    text_side = copies.where(valid).agg(F.count_distinct("_digest").alias("distinct_texts")).select(
        F.lit(None).cast("string").alias("verdict"),
        F.lit(None).cast(copies.schema["label"].dataType).alias("label"),
        F.lit(None).cast("bigint").alias("n"),
        "distinct_texts",
    )
    facts = label_side.unionByName(text_side)

    of_label = F.when(valid, F.col("n"))
    row = facts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        _count(valid).alias("valid"),
        _count(F.col("verdict").isin(*ERRORS)).alias("row_errors"),
        _count(F.col("verdict").isin(*WARNINGS)).alias("row_warnings"),
        F.count(of_label).alias("n_labels"),
        F.max(of_label).alias("_most"),
        F.min(of_label).alias("_least"),
        F.coalesce(F.max("distinct_texts"), F.lit(0)).alias("_texts"),
    )
    total = F.col("total")
    rate = F.when(total > 0, (F.col("valid") - F.col("_texts")) / total).otherwise(0.0)
    ratio = F.when(F.col("n_labels") >= 2, F.col("_most") / F.greatest(F.col("_least"), F.lit(1)))
    row = row.withColumns({"duplicate_rate": rate, "imbalance_ratio": ratio})
    imbalanced = F.coalesce(F.col("imbalance_ratio") > max_imbalance, F.lit(False))
    copied = F.col("duplicate_rate") > max_duplicate_rate
    return row.select(
        "total",
        "valid",
        (F.col("row_errors") + (total == 0).cast("bigint")).alias("n_errors"),
        (F.col("row_warnings") + imbalanced.cast("bigint") + copied.cast("bigint")).alias("n_warnings"),
        "n_labels",
        "duplicate_rate",
        "imbalance_ratio",
        imbalanced.alias("imbalance_warning"),
        copied.alias("duplicate_warning"),
        ((F.col("row_errors") == 0) & (total > 0)).alias("is_ok"),
    )


def pair_report(verdicts: DataFrame) -> DataFrame:
    counts = verdicts.groupBy("verdict").agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    errors = _count(F.col("verdict").isin(*ERRORS))
    return counts.agg(
        total.alias("total"),
        _count(F.col("verdict") == VALID).alias("valid"),
        (errors + (total == 0).cast("bigint")).alias("n_errors"),
        _count(F.col("verdict").isin(*WARNINGS)).alias("n_warnings"),
        ((errors == 0) & (total > 0)).alias("is_ok"),
    )


def label_distribution(verdicts: DataFrame, label_col: str = "label") -> DataFrame:
    return (
        verdicts.where(F.col("verdict") == VALID).groupBy(label_col).agg(F.count("*").alias("n"))
    )


def first_issues(verdicts: DataFrame, *, id_col: str = "msg_id", limit: int = 5) -> DataFrame:
    """The first ``limit`` errors and the first ``limit`` warnings, by id."""

    def first(kind, names):
        hits = verdicts.where(F.col("verdict").isin(*names)).select(
            F.lit(kind).alias("kind"), F.col(id_col).alias("record_id"), "verdict"
        )
        return hits.orderBy("record_id").limit(limit)

    return first("error", ERRORS).unionByName(first("warning", WARNINGS))
