"""Prepare a training corpus: clean, filter, dedup, validate, split, write."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import corpus, validation
from ..session import materialize
from ..sources import files


@dataclass
class Prepared:
    records: DataFrame
    splits: DataFrame
    report: DataFrame


def prepare_classification(
    raw: DataFrame,
    *,
    expected_labels: Sequence[int] = (0, 1),
    order_by: Sequence[str] = ("msg_id",),
    id_col: str = "msg_id",
    out_dir: str | None = None,
    prefix: str = "",
    **clean_options,
) -> Prepared:
    """Clean and split a labelled corpus.

    The cleaned table is written once; the split reads its narrow columns from
    there and the texts move only in the dedup.
    """
    records = materialize(corpus.preprocess_records(raw, order_by=order_by, **clean_options), "records")
    verdicts = validation.record_verdicts(records, expected_labels=expected_labels)
    splits = corpus.stratified_split(records, id_col=id_col)
    if out_dir is not None:
        files.save_splits(splits, out_dir, prefix)
    return Prepared(records, splits, validation.validation_report(verdicts))


def prepare_pairs(
    raw: DataFrame, *, id_col: str = "pair_id", out_dir: str | None = None, prefix: str = ""
) -> Prepared:
    """Clean and split summary pairs (all in one stratum)."""
    records = materialize(corpus.preprocess_pairs(raw, order_by=(id_col,)), "pairs")
    splits = corpus.stratified_split(records, id_col=id_col, label_col=None)
    if out_dir is not None:
        files.save_splits(splits, out_dir, prefix)
    return Prepared(records, splits, validation.pair_report(validation.pair_verdicts(records)))
