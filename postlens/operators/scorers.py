"""Pluggable scorers and routing with a confidence fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .. import fixed
from ..functions import scoring
from .policy import resolve_policy

CLASSIFIERS = (fixed.TASK_SPAM, fixed.TASK_PHISHING)
_DECISIONS = {
    # task: (threshold column, label and action above it, label and action below it)
    fixed.TASK_SPAM: ("spam_threshold", ("spam", "quarantine"), ("ham", "allow")),
    fixed.TASK_PHISHING: ("phishing_threshold", ("phishing", "block"), ("legitimate", "allow")),
}


@dataclass
class Score:
    """What a scorer says about a row, as columns."""

    score: Column
    confidence: Column
    explanations: Sequence[str]
    contributions: dict[str, Column] | Column | None = None


class Scorer(Protocol):
    id: str

    def supports(self, task: str) -> bool: ...

    def score(self, task: str, text: Column) -> Score: ...


class PrimaryScorer:
    """Term, link and length heuristics for both classification tasks."""

    id = fixed.PRIMARY_MODEL

    def supports(self, task: str) -> bool:
        return task in fixed.TASKS

    def score(self, task: str, text: Column) -> Score:
        if task == fixed.TASK_SPAM:
            value, parts = scoring.spam_score(text), scoring.spam_contributions(text)
        else:
            value, parts = scoring.phishing_score(text), scoring.phishing_contributions(text)
        return Score(value, scoring.calibrate(value), fixed.EXPLANATIONS[task], parts)


class FallbackScorer:
    """Short conservative term lists with a constant confidence."""

    id = fixed.FALLBACK_MODEL
    _terms = {
        fixed.TASK_SPAM: (fixed.FALLBACK_SPAM_TERMS, fixed.FALLBACK_SPAM_CONFIDENCE),
        fixed.TASK_PHISHING: (fixed.FALLBACK_PHISHING_TERMS, fixed.FALLBACK_PHISHING_CONFIDENCE),
    }

    def supports(self, task: str) -> bool:
        return task in self._terms

    def score(self, task: str, text: Column) -> Score:
        terms, confidence = self._terms[task]
        value = scoring.term_presence(text, terms)
        return Score(value, F.lit(confidence), fixed.FALLBACK_EXPLANATIONS[task])


@dataclass
class ColumnScorer:
    """Scores that are already columns, e.g. added by :func:`run_external_model`."""

    id: str
    tasks: Sequence[str]
    score_col: str
    confidence_col: str
    explanations: Sequence[str] = ()
    contributions_col: str | None = None

    def supports(self, task: str) -> bool:
        return task in self.tasks

    def score(self, task: str, text: Column) -> Score:
        parts = F.col(self.contributions_col) if self.contributions_col else None
        return Score(F.coalesce(F.col(self.score_col), F.lit(0.0)), F.col(self.confidence_col), self.explanations, parts)


DEFAULT_SCORERS: tuple[Scorer, ...] = (PrimaryScorer(), FallbackScorer())


def run_external_model(
    df: DataFrame,
    infer: Callable[[pd.DataFrame], pd.DataFrame],
    added: StructType,
    contributions_key: str = "feature_contributions",
    text_cols: Sequence[str] = ("text",),
    max_chars: int | None = fixed.CLEAN_MAX_CHARS,
) -> DataFrame:
    """Batch inference by a user function over Arrow batches.

    The model sees the first ``max_chars`` characters of ``text_cols``; the
    columns of ``df`` come back uncut.
    ``infer`` gets a batch and returns the columns of ``added``, row for row.
    If ``added`` has a ``result`` map that carries its contributions under
    ``contributions_key`` (a map of numbers as JSON), they are moved out into
    a column of that name.
    """

    cut = [c for c in text_cols if c in df.columns] if max_chars is not None else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shown = batch.assign(**{c: batch[c].map(lambda t: t[:max_chars], na_action="ignore") for c in cut})
            answer = infer(shown).set_axis(batch.index, axis=0)
            yield pd.concat([batch, answer[added.names]], axis=1)

    out = df.mapInPandas(run, StructType(df.schema.fields + added.fields))
    if "result" not in added.names:
        return out
    result = F.col("result")
    parts = F.from_json(F.try_element_at(result, F.lit(contributions_key)), "map<string,double>")
    return out.withColumns(
        {
            contributions_key: F.map_filter(parts, lambda _, v: v.isNotNull()),
            "result": F.map_filter(result, lambda k, _: k != contributions_key),
        }
    )


def _as_map(parts) -> Column:
    if parts is None:
        return F.lit(None).cast("map<string,double>")
    if isinstance(parts, Column):
        return parts.cast("map<string,double>")
    return F.create_map(*[x for name, c in parts.items() for x in (F.lit(name), c)])


def _by_model(scorers: Sequence[Scorer], pick: Callable[[Scorer], Column], model: str) -> Column:
    """``pick`` of the scorer whose id is in column ``model``; others are not evaluated."""
    first, *rest = scorers
    out = F.when(F.col(model) == first.id, pick(first))
    for s in rest:
        out = out.when(F.col(model) == s.id, pick(s))
    return out


def route(
    df: DataFrame,
    task: str,
    *,
    text_col: str = "request_text",
    overrides: DataFrame | None = None,
    scorers: Sequence[Scorer] = DEFAULT_SCORERS,
    fallback: Scorer | None = DEFAULT_SCORERS[1],
) -> DataFrame:
    """Score each row by its tenant's model, fall back on low confidence, decide.

    One narrow stage: the policy is a size-checked lookup and every scorer is a
    branch of a ``when``.  Adds score, confidence, model_name, explanations,
    feature_contributions, label and recommended_action.
    """
    able = [s for s in scorers if s.supports(task)]
    if not able:
        raise ValueError(f"no scorer supports task {task}")
    ids = [s.id for s in able]
    text = F.col(text_col)
    scored = {s.id: s.score(task, text) for s in able}

    df = resolve_policy(df, overrides)
    df = df.withColumn(
        "_model", F.when(F.col("preferred_model").isin(*ids), F.col("preferred_model")).otherwise(ids[0])
    )
    df = df.withColumn("_score", _by_model(able, lambda s: scored[s.id].score, "_model"))

    def confidence(s):
        # The primary's confidence follows from the score column already made.
        if isinstance(s, PrimaryScorer):
            return scoring.calibrate(F.col("_score"))
        return scored[s.id].confidence

    df = df.withColumn("_conf", _by_model(able, confidence, "_model"))
    use = F.lit(False)
    if fallback is not None and fallback.supports(task):
        other = fallback.score(task, text)
        use = (
            (F.col("_conf") < F.col("min_confidence"))
            & (F.col("_model") != fallback.id)
            & (other.confidence >= F.col("_conf"))
        )
    df = df.withColumn("_fell_back", use)
    fell = F.col("_fell_back")

    def words(values):
        return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")

    explain = _by_model(able, lambda s: words(scored[s.id].explanations), "_model")
    parts = _by_model(able, lambda s: _as_map(scored[s.id].contributions), "_model")
    score, conf, model = F.col("_score"), F.col("_conf"), F.col("_model")
    if fallback is not None and fallback.supports(task):
        score = F.when(fell, other.score).otherwise(score)
        conf = F.when(fell, other.confidence).otherwise(conf)
        model = F.when(fell, F.lit(fallback.id)).otherwise(model)
        explain = F.when(fell, words(other.explanations)).otherwise(explain)
        parts = F.when(~fell, parts)
    df = df.withColumns(
        {
            "score": score,
            "confidence": conf,
            "model_name": model,
            "explanations": explain,
            "feature_contributions": parts,
        }
    )
    return decide(df, task).drop("_model", "_score", "_conf", "_fell_back")


def decide(df: DataFrame, task: str, score_col: str = "score") -> DataFrame:
    """Label and recommended action from the score and the tenant's threshold."""
    threshold, above, below = _DECISIONS[task]
    score = scoring.to_number(F.col(score_col), df.schema[score_col].dataType)
    hit = score >= F.col(threshold)
    return df.withColumns(
        {
            "label": F.when(hit, F.lit(above[0])).otherwise(F.lit(below[0])),
            "recommended_action": F.when(hit, F.lit(above[1])).otherwise(F.lit(below[1])),
        }
    )
