"""Score requests: sanitise, route, decide, override, answer.

``score_messages`` is one narrow stage plus a size-checked policy lookup; the
same function serves batch frames and streams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions import scoring
from ..functions.safety import analyze_and_sanitize, override_action
from ..functions.text import as_text, is_blank, request_text
from ..operators.scorers import CLASSIFIERS, DEFAULT_SCORERS, Scorer, route


def sanitize_requests(df: DataFrame, fields: Sequence[str] = ("subject", "body")) -> DataFrame:
    """Sanitised fields, their flags and the request text made from them."""
    clean = analyze_and_sanitize(df, fields)
    return clean.withColumn("request_text", request_text(F.col("subject"), F.col("body")))


def classify(
    df: DataFrame,
    task: str = fixed.TASK_SPAM,
    *,
    overrides: DataFrame | None = None,
    scorers: Sequence[Scorer] = DEFAULT_SCORERS,
    fields: Sequence[str] = ("subject", "body"),
) -> DataFrame:
    """Flags, score, label and (possibly overridden) action of each message."""
    return _classify_clean(sanitize_requests(df, fields), task, overrides, scorers)


def _classify_clean(clean: DataFrame, task: str, overrides: DataFrame | None, scorers: Sequence[Scorer]) -> DataFrame:
    return override_action(route(clean, task, overrides=overrides, scorers=scorers))


def prepare_requests(df: DataFrame) -> DataFrame:
    """Requests with what all tasks share: sanitised fields, their flags, the request text and the usage.

    To be written once where several tasks score the same requests.
    """
    fields = [f for f in fixed.REQUEST_FIELDS if f in df.columns]
    for needed in ("subject", "body"):
        if needed not in fields:
            df = df.withColumn(needed, F.lit(None).cast("string"))
    clean = sanitize_requests(df, fields or ("subject", "body"))
    return clean.withColumn("usage", scoring.usage({f: F.col(f) for f in fields}))


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _answer(df: DataFrame, task: str) -> Column:
    """The ``result`` struct of the tasks that are not classifications."""
    get = {name: _field(df, name) for name in fixed.REQUEST_FIELDS}
    text = F.col("request_text")
    answers = {
        fixed.TASK_DRAFT: lambda: {"draft": scoring.draft_reply(get["instruction"])},
        fixed.TASK_REWRITE: lambda: {"rewrite": scoring.rewrite_reply(get["text"], get["tone"])},
        fixed.TASK_SUMMARY: lambda: {
            "summary": scoring.summarize(F.when(is_blank(as_text(get["thread"])), text).otherwise(as_text(get["thread"])))
        },
        fixed.TASK_SEARCH: lambda: {
            "query": as_text(get["query"]),
            "matches": F.expr("cast(array() as array<string>)"),
        },
        fixed.TASK_PRIORITY: lambda: {"priority_score": scoring.priority_heuristic(text)},
        fixed.TASK_ANOMALY: lambda: {
            "insights": F.expr("cast(array() as array<string>)"),
            "anomaly_score": F.lit(fixed.ANOMALY_SCORE),
        },
        fixed.TASK_FEEDBACK: lambda: {"status": F.lit(fixed.FEEDBACK_STATUS)},
    }
    return F.struct(*[c.alias(name) for name, c in answers[task]().items()])


def score_messages(
    df: DataFrame,
    task: str = fixed.TASK_SPAM,
    *,
    overrides: DataFrame | None = None,
    scorers: Sequence[Scorer] = DEFAULT_SCORERS,
    latency_col: str | None = None,
    prepared: bool = False,
) -> DataFrame:
    """The full response envelope of each request.

    ``df`` has request_id, tenant_id and the request fields the task reads; with
    ``prepared`` it comes from :func:`prepare_requests`.
    """
    done = df if prepared else prepare_requests(df)
    if task in CLASSIFIERS:
        done = _classify_clean(done, task, overrides, scorers)
        score_name = "spam_score" if task == fixed.TASK_SPAM else "phishing_score"
        result = F.struct(F.col("score").alias(score_name), "label", "recommended_action")
        facts = {"result": result}
    else:
        facts = {
            "result": _answer(done, task),
            "confidence": F.lit(fixed.CONFIDENCE[task]),
            "model_name": F.lit(fixed.PRIMARY_MODEL),
            "explanations": F.array(*[F.lit(e) for e in fixed.EXPLANATIONS[task]]),
            "feature_contributions": F.lit(None).cast("map<string,double>"),
        }
    latency = F.greatest(F.col(latency_col).cast("bigint"), F.lit(0)) if latency_col else F.lit(0).cast("bigint")
    out = done.withColumns(facts)
    return out.select(
        "request_id",
        "tenant_id",
        "model_name",
        F.lit(fixed.MODEL_VERSION).alias("model_version"),
        F.lit(task).alias("task_type"),
        latency.alias("latency_ms"),
        "confidence",
        F.lit(fixed.CALIBRATION_TAG).alias("confidence_calibration"),
        "result",
        "explanations",
        "feature_contributions",
        "safety_flags",
        F.lit(False).alias("cache_hit"),
        F.current_timestamp().alias("timestamp"),
        "usage",
    )
