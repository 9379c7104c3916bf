"""Corpus preparation: cleaning, length filters, exact dedup, reports, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed
from ..functions.text import clean_text, truncate_chars
from ..session import broadcast_if_small, with_computed


def digest(c: Column) -> Column:
    """A 32-byte key that stands for a text in shuffles."""
    return F.unhex(F.sha2(c, 256))


def truncate_fields(
    df: DataFrame, fields: Sequence[str] = fixed.REQUEST_FIELDS, max_chars: int = fixed.REQUEST_MAX_CHARS
) -> DataFrame:
    return df.withColumns({f: truncate_chars(F.col(f), max_chars) for f in fields if f in df.columns})


def clean_records(
    df: DataFrame, text_col: str = "text", min_chars: int = fixed.MIN_RECORD_CHARS, **clean_options
) -> DataFrame:
    """Clean ``text_col`` and keep records that are long enough."""
    cleaned = with_computed(df, text_col, clean_text(F.col(text_col), **clean_options))
    return cleaned.where(F.length(text_col) >= min_chars)


def dedup_exact(df: DataFrame, on: str, order_by: Sequence[str]) -> DataFrame:
    """Keep the first record (by ``order_by``) of each distinct ``on`` value.

    An aggregate, not a window: copies of one text are combined before the
    shuffle, so a text that fills a third of the input is one row per task.
    """
    winner = F.min_by(F.struct("*"), F.struct(*order_by)).alias("_first")
    return df.groupBy(digest(F.col(on)).alias("_digest")).agg(winner).select("_first.*")


def preprocess_records(
    df: DataFrame,
    *,
    order_by: Sequence[str] = ("msg_id",),
    text_col: str = "text",
    min_chars: int = fixed.MIN_RECORD_CHARS,
    deduplicate: bool = True,
    **clean_options,
) -> DataFrame:
    kept = clean_records(df, text_col, min_chars, **clean_options)
    return dedup_exact(kept, text_col, order_by) if deduplicate else kept


def preprocess_report(
    df: DataFrame, *, text_col: str = "text", min_chars: int = fixed.MIN_RECORD_CHARS, **clean_options
) -> DataFrame:
    """One row: records in, kept, dropped as short, dropped as duplicates."""
    cleaned = clean_text(F.col(text_col), **clean_options)
    keyed = df.select(cleaned.alias("_clean")).select(
        F.when(F.length("_clean") >= min_chars, digest(F.col("_clean"))).alias("_digest")
    )
    groups = keyed.groupBy("_digest").agg(F.count("*").alias("n"))
    short = F.coalesce(F.sum(F.when(F.col("_digest").isNull(), F.col("n"))), F.lit(0))
    kept = F.count("_digest")
    total = F.coalesce(F.sum("n"), F.lit(0))
    return groups.agg(
        total.alias("total"),
        kept.alias("kept"),
        short.alias("dropped_short"),
        (total - short - kept).alias("dropped_dup"),
    )


def preprocess_pairs(
    df: DataFrame,
    *,
    order_by: Sequence[str] = ("pair_id",),
    min_dialogue_chars: int = fixed.MIN_DIALOGUE_CHARS,
    min_summary_chars: int = fixed.MIN_SUMMARY_CHARS,
    max_dialogue_chars: int = fixed.MAX_DIALOGUE_CHARS,
    max_summary_chars: int = fixed.MAX_SUMMARY_CHARS,
    deduplicate: bool = True,
) -> DataFrame:
    """Clean (text, summary) pairs; the dialogue alone decides what is a copy."""
    cleaned = with_computed(
        df, "text", clean_text(F.col("text"), lowercase=False, max_chars=max_dialogue_chars)
    )
    cleaned = with_computed(
        cleaned, "summary", clean_text(F.col("summary"), lowercase=False, max_chars=max_summary_chars)
    )
    kept = cleaned.where(
        (F.length("text") >= min_dialogue_chars) & (F.length("summary") >= min_summary_chars)
    )
    return dedup_exact(kept, "text", order_by) if deduplicate else kept


# ---- splits ------------------------------------------------------------------------


def stratified_split(
    df: DataFrame,
    *,
    id_col: str = "msg_id",
    label_col: str | None = "label",
    ratios: Sequence[float] = fixed.SPLIT_RATIOS,
    seed: int = fixed.SPLIT_SEED,
    prefix_digits: int = 3,
) -> DataFrame:
    """Add ``split``: exact train/val/test sizes within each label.

    Records are ordered by ``md5(seed|id)`` within their label and cut at
    ``int(n*train)`` and ``int(n*val)`` further.  No label is ever sorted as a
    whole: digests are counted by their leading hex digits, only the one
    bucket that holds a cut is ranked to find the digest at the cut, and every
    record then compares its digest with its label's two cut points.  The
    records themselves are not shuffled.  Reads ``df`` three times; pass a table.
    """
    train, val, test = ratios
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError("ratios must sum to 1.0")

    label = F.coalesce(F.col(label_col), F.lit(0)) if label_col else F.lit(0)
    position = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    keyed = df.withColumns({"_label": label, "_pos": position})
    narrow = keyed.select("_label", "_pos", F.col(id_col).alias("_id")).withColumn(
        "_bucket", F.substring("_pos", 1, prefix_digits)
    )

    counts = narrow.groupBy("_label", "_bucket").agg(F.count("*").alias("n"))
    running = Window.partitionBy("_label").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = counts.withColumns(
        {"_upto": F.sum("n").over(running), "_all": F.sum("n").over(Window.partitionBy("_label"))}
    )
    n_train = F.floor(F.col("_all") * F.lit(train))
    n_val = F.floor(F.col("_all") * F.lit(val))
    cuts = cumulated.select(
        "_label",
        "_bucket",
        (F.col("_upto") - F.col("n")).alias("_before"),
        "_upto",
        F.explode(
            F.array(
                F.struct(F.lit("train").alias("cut"), n_train.alias("at")),
                F.struct(F.lit("val").alias("cut"), (n_train + n_val).alias("at")),
            )
        ).alias("_c"),
    ).where((F.col("_before") < F.col("_c.at")) & (F.col("_c.at") <= F.col("_upto")))
    rank = F.col("_c.at") - F.col("_before")
    wanted = cuts.groupBy("_label", "_bucket").agg(
        F.max(F.when(F.col("_c.cut") == "train", rank)).alias("_train_rank"),
        F.max(F.when(F.col("_c.cut") == "val", rank)).alias("_val_rank"),
    )
    in_bucket = Window.partitionBy("_label", "_bucket").orderBy("_pos", "_id")
    ranked = narrow.join(broadcast_if_small(wanted), ["_label", "_bucket"]).withColumn(
        "_rank", F.row_number().over(in_bucket)
    )
    key = F.struct("_pos", "_id")
    points = ranked.groupBy("_label").agg(
        F.max(F.when(F.col("_rank") == F.col("_train_rank"), key)).alias("_train_end"),
        F.max(F.when(F.col("_rank") == F.col("_val_rank"), key)).alias("_val_end"),
    )
    key = F.struct(F.col("_pos"), F.col(id_col).alias("_id"))
    if label_col:
        placed = keyed.join(broadcast_if_small(points), "_label", "left")
    else:  # one label has two cut points at most, which need no join
        ends = {c: points.schema[c].dataType for c in ("_train_end", "_val_end")}
        found = points.first() or dict.fromkeys(ends)
        literal = lambda end, kind: F.struct(*[F.lit(end[f.name]).cast(f.dataType).alias(f.name) for f in kind]) if end else F.lit(None).cast(kind)
        placed = keyed.withColumns({c: literal(found[c], kind) for c, kind in ends.items()})
    split = (
        F.when(key <= F.col("_train_end"), "train")
        .when(key <= F.col("_val_end"), "val")
        .otherwise("test")
    )
    return placed.withColumn("split", split).select(*df.columns, "split")


def split_sizes(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.groupBy(label_col, "split").agg(F.count("*").alias("n"))


def positional_split(df: DataFrame, *, id_col: str = "msg_id", train: float = 0.9, seed: int = fixed.SPLIT_SEED):
    """(train, val) by position in digest order, without strata."""
    cut = stratified_split(df, id_col=id_col, label_col=None, ratios=(train, 1.0 - train, 0.0), seed=seed)
    # Flooring may leave a last record; it belongs to the validation part.
    return cut.where(F.col("split") == "train").drop("split"), cut.where(F.col("split") != "train").drop("split")
