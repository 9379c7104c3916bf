"""Train and gate models on tables with Spark ML."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.storagelevel import StorageLevel

from .. import fixed
from ..functions import scoring
from ..operators import corpus, metrics as m
from ..session import materialize


def priority_training_rows(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the six features and the heuristic class ``priority``."""
    feats = df.withColumns(scoring.priority_features(F.col(text_col)))
    signals = [F.col(n) for n in scoring.FEATURES[:5]]
    return feats.withColumn("priority", scoring.priority_class(*signals))


def train_priority_model(
    df: DataFrame,
    *,
    id_col: str = "msg_id",
    text_col: str = "text",
    c: float = 1.0,
    max_iter: int = 1000,
    seed: int = fixed.SPLIT_SEED,
) -> tuple[PipelineModel, DataFrame]:
    """A scaled multinomial logistic regression on the priority features.

    The features take few distinct values, so the training part is counted per
    (features, class) in one aggregate and the optimizer iterates over those
    weighted rows; the optimum is that of the single records.  Classes weigh
    n / (classes * class size), features are scaled by their population mean
    and deviation.  Returns the model and its predictions on the last tenth.
    """
    rows = priority_training_rows(df, text_col).select(id_col, *scoring.FEATURES, "priority")
    train, val = corpus.positional_split(rows, id_col=id_col, seed=seed)
    # At most a few hundred combinations exist, so one partition holds them.
    counted = materialize(
        train.groupBy(*scoring.FEATURES, "priority").agg(F.count("*").cast("double").alias("n")).coalesce(1),
        "features",
    )
    moments = [
        x
        for f in scoring.FEATURES
        for x in (F.sum(F.col(f) * F.col("n")).alias(f), F.sum(F.col(f) * F.col(f) * F.col("n")).alias(f"{f}_sq"))
    ]
    facts = counted.agg(F.sum("n").alias("n"), F.count_distinct("priority").alias("k"), *moments).first()
    total = facts["n"]

    scaled = []
    for f in scoring.FEATURES:
        mean = facts[f] / total
        spread = math.sqrt(max(facts[f"{f}_sq"] / total - mean * mean, 0.0)) or 1.0
        scaled.append(f"({f} - {mean!r}D) / {spread!r}D AS z_{f}")
    size = F.sum("n").over(Window.partitionBy("priority"))
    weighted = counted.withColumn("weight", F.col("n") * F.lit(total) / (F.lit(float(facts["k"])) * size))
    stages = [
        SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__"),
        VectorAssembler(inputCols=[f"z_{f}" for f in scoring.FEATURES], outputCol="features"),
        LogisticRegression(
            labelCol="priority",
            weightCol="weight",
            family="multinomial",
            maxIter=max_iter,
            # The class weights sum to the number of records.
            regParam=1.0 / (c * total),
            standardization=False,
        ),
    ]
    model = Pipeline(stages=stages).fit(weighted)
    guesses = model.transform(val).select(
        id_col, F.col("priority").alias("y_true"), F.col("prediction").cast("int").alias("y_pred")
    )
    return model, guesses


@dataclass(frozen=True)
class TextModelConfig:
    task: str = fixed.TASK_SPAM
    features: int = 1 << 16
    max_iter: int = 50
    reg: float = 0.01
    seed: int = fixed.SPLIT_SEED


SPAM_CONFIG = TextModelConfig()
PHISHING_CONFIG = TextModelConfig(task=fixed.TASK_PHISHING)


class GateNotPassed(ValueError):
    """The trained model is below its promotion gate and was not saved."""


def train_text_model(
    df: DataFrame,
    cfg: TextModelConfig = SPAM_CONFIG,
    *,
    id_col: str = "msg_id",
    text_col: str = "text",
    label_col: str = "label",
) -> tuple[PipelineModel, DataFrame]:
    """TF-IDF and a weighted logistic regression; returns test predictions.

    The positive class weighs n_neg / n_pos.
    """
    split = corpus.stratified_split(df.select(id_col, text_col, label_col), id_col=id_col, label_col=label_col, seed=cfg.seed)
    train = split.where(F.col("split") == "train").persist(StorageLevel.MEMORY_AND_DISK)
    pos_weight = m.class_weights(train, label_col).first()["pos_weight"]
    weighted = train.withColumn("weight", F.when(F.col(label_col) == 1, F.lit(pos_weight)).otherwise(1.0))
    stages = [
        RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"(?U)\W+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=cfg.features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(
            featuresCol="_features",
            labelCol=label_col,
            weightCol="weight",
            maxIter=cfg.max_iter,
            regParam=cfg.reg,
            probabilityCol="_probability",
        ),
    ]
    model = Pipeline(stages=stages).fit(weighted)
    train.unpersist()
    probs = vector_to_array("_probability")
    scored = model.transform(split.where(F.col("split") == "test")).select(
        id_col, F.col(label_col).alias("y_true"), probs.alias("_p")
    )
    parts = scoring.predict_from_probabilities(F.col("_p"))
    guesses = scored.select(
        id_col,
        "y_true",
        parts["label"].alias("y_pred"),
        parts["score"].alias("y_score"),
        F.lit("text-lr").alias("model"),
        F.lit(cfg.task).alias("task"),
    )
    return model, guesses


def promote_text_model(model: PipelineModel, predictions: DataFrame, gates: DataFrame, path: str) -> DataFrame:
    """Save the model only if its test metrics pass the gate of its task."""
    report = m.promotion_gate(m.classification_metrics(predictions), gates)
    row = report.first()
    if row is None or not row["promoted"]:
        raise GateNotPassed(row["failure_reason"] if row else "no test predictions")
    model.write().overwrite().save(path)
    return report
