"""Model-quality and latency metrics, and the promotion gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..session import broadcast_if_small
from .ranks import exact_percentiles, running_totals


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return _ratio(F.lit(2.0) * p * r, p + r)


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Counts of both classes and the weight of the positive one."""
    pos = F.coalesce(F.sum((F.col(label_col) == 1).cast("bigint")), F.lit(0))
    neg = F.count(label_col) - pos
    return df.agg(
        pos.alias("n_pos"), neg.alias("n_neg"), (neg / F.greatest(pos, F.lit(1))).alias("pos_weight")
    )


def classification_metrics(
    df: DataFrame,
    keys: Sequence[str] = ("model", "task"),
    *,
    y_true: str = "y_true",
    y_pred: str = "y_pred",
    pos_label: int = 1,
) -> DataFrame:
    """Confusion counts, precision, recall, F1, FPR and FNR per key, in one aggregate."""
    truth, guess = F.col(y_true) == pos_label, F.col(y_pred) == pos_label

    def n(condition):
        return F.sum(condition.cast("bigint"))

    counts = df.groupBy(*keys).agg(
        n(truth & guess).alias("tp"),
        n(~truth & guess).alias("fp"),
        n(truth & ~guess).alias("fn"),
        n(~truth & ~guess).alias("tn"),
        F.count("*").alias("support"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rates = counts.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "false_positive_rate": fp / F.greatest(fp + tn, F.lit(1)),
            "false_negative_rate": fn / F.greatest(fn + tp, F.lit(1)),
        }
    )
    return rates.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def ranking_metrics(
    df: DataFrame,
    keys: Sequence[str] = ("model", "task"),
    *,
    y_true: str = "y_true",
    y_score: str = "y_score",
    pos_label: int = 1,
) -> DataFrame:
    """ROC-AUC (average ranks for ties) and average precision per key.

    Both are 0 where a key has only one class.
    """
    hit = (F.col(y_true) == pos_label).cast("bigint")
    marked = df.where(F.col(y_score).isNotNull()).select(
        *keys, y_score, hit.alias("pos"), (F.lit(1) - hit).alias("neg")
    )
    run = running_totals(marked, keys, y_score, ["pos", "neg"], descending=True)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    above = F.col("cum_pos") - F.col("pos")
    area = F.sum(neg * (above + pos / 2))
    precision_steps = F.sum(pos * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    n_pos, n_neg = F.max("total_pos"), F.max("total_neg")
    both = (n_pos > 0) & (n_neg > 0)
    return run.groupBy(*keys).agg(
        F.when(both, area / (n_pos.cast("double") * n_neg)).otherwise(0.0).alias("roc_auc"),
        F.when(both, precision_steps / n_pos).otherwise(0.0).alias("average_precision"),
    )


def per_class_report(
    df: DataFrame, keys: Sequence[str] = ("model", "task"), *, y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    """Rows per class, then ``accuracy``, ``macro avg`` and ``weighted avg``."""
    pairs = df.groupBy(*keys, y_true, y_pred).agg(F.count("*").alias("n"))
    same = F.when(F.col(y_true) == F.col(y_pred), F.col("n")).otherwise(F.lit(0).cast("bigint"))
    none = F.lit(0).cast("bigint")
    sides = pairs.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col(y_true).alias("c"), F.col("n").alias("real"), none.alias("said"), same.alias("hit")),
                F.struct(F.col(y_pred).alias("c"), none.alias("real"), F.col("n").alias("said"), none.alias("hit")),
            )
        ).alias("s"),
    )
    classes = sides.groupBy(*keys, F.col("s.c").alias("class")).agg(
        F.sum("s.real").alias("support"), F.sum("s.said").alias("said"), F.sum("s.hit").alias("hit")
    )
    classes = classes.withColumns(
        {"precision": _ratio(F.col("hit"), F.col("said")), "recall": _ratio(F.col("hit"), F.col("support"))}
    ).withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    scores = ("precision", "recall", "f1")

    def weighted(c):
        return F.sum(F.col(c) * F.col("support")) / F.sum("support")

    whole = classes.groupBy(*keys).agg(
        F.sum("support").alias("support"),
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(f"m_{c}") for c in scores],
        *[weighted(c).alias(f"w_{c}") for c in scores],
    )
    no = F.lit(None).cast("double")

    def line(name, p, r, f):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"))

    lines = F.array(
        line("accuracy", no, no, F.col("accuracy")),
        line("macro avg", *[F.col(f"m_{c}") for c in scores]),
        line("weighted avg", *[F.col(f"w_{c}") for c in scores]),
    )
    summary = whole.select(*keys, F.explode(lines).alias("l"), "support").select(*keys, "l.*", "support")
    per_class = classes.select(*keys, F.col("class").cast("string").alias("class"), *scores, "support")
    return per_class.unionByName(summary)


def latency_metrics(
    df: DataFrame,
    keys: Sequence[str] = (),
    *,
    latency_col: str = "latency_ms",
    approximate: bool = False,
    accuracy: int = 10_000,
) -> DataFrame:
    """Mean, p50/p95/p99 and requests per second; all zero for no rows.

    Percentiles are exact and interpolated (a scan, a histogram of distinct
    values and running counts); ``approximate`` trades that for one aggregate.
    """
    shares = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}
    one_row = not keys
    if one_row:
        df, keys = df.withColumn("_all", F.lit(1)), ["_all"]
    keys = list(keys)
    value = F.col(latency_col)
    sketch = (
        [F.percentile_approx(value, s, accuracy).cast("double").alias(n) for n, s in shares.items()]
        if approximate
        else []
    )
    base = df.groupBy(*keys).agg(F.avg(value).alias("mean_ms"), F.sum(value).alias("_sum"), F.count(value).alias("n"), *sketch)
    if not approximate:
        base = base.join(broadcast_if_small(exact_percentiles(df, keys, latency_col, shares)), keys, "left")
    if one_row:
        base = base.groupBy().agg(*[F.max(c).alias(c) for c in base.columns if c != "_all"])
    rate = F.when(F.col("n") > 0, F.col("n") / F.greatest(F.col("_sum") / 1000, F.lit(1e-9))).otherwise(0.0)
    values = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("mean_ms", *shares)]
    out_keys = [] if one_row else keys
    return base.select(*out_keys, *values, F.coalesce(rate, F.lit(0.0)).alias("throughput_rps"))


# ---- promotion gate ------------------------------------------------------------------


def gate_table(spark, gates: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    rows = [(task, *g) for task, g in (gates or fixed.GATES).items()]
    return spark.createDataFrame(rows, "task string, min_precision double, min_recall double, min_f1 double")


def promotion_gate(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """Add ``promoted`` and ``failure_reason`` by the gate of the row's task.

    A task without a gate passes.
    """
    joined = metrics.join(broadcast_if_small(gates), "task", "left")
    checks = [("precision", "min_precision"), ("recall", "min_recall"), ("f1", "min_f1")]
    passed = F.lit(True)
    for have, want in checks:
        passed = passed & F.coalesce(F.col(have) >= F.col(want), F.col(want).isNull())
    told = [
        F.concat(F.lit(f"{have}="), F.format_string("%.4f", F.col(have)), F.lit(" (min "), F.col(want).cast("string"), F.lit(")"))
        for have, want in checks
    ]
    reason = F.when(passed, F.lit("")).otherwise(F.concat_ws(", ", *told))
    return joined.withColumns({"promoted": passed, "failure_reason": reason}).drop(*[w for _, w in checks])


def all_promoted(gated: DataFrame) -> DataFrame:
    """One row: number of models and whether all passed (true for none)."""
    return gated.agg(
        F.count("*").alias("n_models"), F.coalesce(F.bool_and("promoted"), F.lit(True)).alias("all_promoted")
    )
