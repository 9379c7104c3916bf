"""Adapters from source-specific columns to the common record shapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..functions.labels import guess_column
from ..functions.text import as_text, strip_space
from .files import labelled


def adapt_text_label(
    df: DataFrame, source: str, *, text_col: str = "sms", label_col: str = "label", keep: Sequence[str] = ()
) -> DataFrame:
    return df.select(
        *keep, F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), F.lit(source).alias("source")
    )


def adapt_subject_message(
    df: DataFrame,
    name: str,
    split: str,
    *,
    subject_col: str = "subject",
    message_col: str = "message",
    label_col: str = "label",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Subject, blank line, message; trimmed."""
    text = strip_space(F.concat(as_text(F.col(subject_col)), F.lit("\n\n"), as_text(F.col(message_col))))
    return df.select(
        *keep, text.alias("text"), F.col(label_col).cast("int").alias("label"), F.lit(f"{name}/{split}").alias("source")
    )


def adapt_phishing(df: DataFrame, source: str, *, keep: Sequence[str] = ()) -> DataFrame:
    """``text_combined`` and ``label``, else the first and the last column."""
    columns = [c for c in df.columns if c not in keep]
    text_col = "text_combined" if "text_combined" in columns else columns[0]
    label_col = "label" if "label" in columns else columns[-1]
    return df.select(
        *keep,
        F.col(text_col).cast("string").alias("text"),
        F.col(label_col).cast("int").alias("label"),
        F.lit(source).alias("source"),
    )


def adapt_dialogue(df: DataFrame, name: str, split: str, *, keep: Sequence[str] = ()) -> DataFrame:
    topic = as_text(F.col("topic")) if "topic" in df.columns else F.lit("")
    return df.select(
        *keep, F.col("dialogue").alias("text"), "summary", topic.alias("topic"), F.lit(f"{name}/{split}").alias("source")
    )


def ingest_extra(df: DataFrame, name: str, *, keep: Sequence[str] = ()) -> DataFrame | None:
    """A further source with guessed columns; None if they cannot be guessed."""
    columns = [c for c in df.columns if c not in keep]
    text_col = guess_column(columns, fixed.TEXT_COLUMN_CANDIDATES)
    label_col = guess_column(columns, fixed.LABEL_COLUMN_CANDIDATES)
    if text_col is None or label_col is None:
        return None
    return labelled(df, text_col, label_col, f"hf-extra/{name}", keep)


def union_corpora(sources: Sequence[DataFrame | None]) -> DataFrame:
    """All sources one after the other; ``source_rank`` keeps their order."""
    ranked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources) if s is not None]
    out = ranked[0]
    for part in ranked[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def assemble(corpora: Mapping[str, Sequence[DataFrame | None]]) -> dict[str, DataFrame]:
    """Named corpora (spam, phishing, summarization) from their sources."""
    return {name: union_corpora(parts) for name, parts in corpora.items()}
