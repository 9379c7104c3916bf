"""Heuristic scores, features and templates as column expressions.

Texts given to the scorers are already lower-cased request texts
(:func:`postlens.functions.text.request_text`).  Lengths are bytes where the
score is defined on bytes and characters where it is defined on characters.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, NumericType

from .. import fixed
from .text import as_text, bind, is_blank, request_text, trim_space, truncate_bytes


def term_presence(text: Column, terms: Sequence[str]) -> Column:
    """Share of ``terms`` that occur in ``text`` as substrings."""
    if not terms:
        return F.lit(0.0)
    hits = reduce(add, [F.contains(text, F.lit(t)).cast("int") for t in terms])
    share = F.least(F.lit(1.0), hits.cast("double") / F.lit(float(len(terms))))
    return F.when(is_blank(text), F.lit(0.0)).otherwise(share)


def _bonus(condition: Column, amount: float) -> Column:
    return F.when(condition, F.lit(amount)).otherwise(F.lit(0.0))


def length_factor(text: Column) -> Column:
    return F.least(F.lit(1.0), F.octet_length(text).cast("double") / F.lit(1000.0))


def spam_score(text: Column, terms: Sequence[str] = fixed.SPAM_TERMS) -> Column:
    link = F.contains(text, F.lit("http://")) | F.contains(text, F.lit("https://"))
    score = term_presence(text, terms) + _bonus(link, 0.1) + F.lit(0.1) * length_factor(text)
    return F.least(F.lit(1.0), score)


def phishing_score(text: Column, terms: Sequence[str] = fixed.PHISHING_TERMS) -> Column:
    score = (
        term_presence(text, terms)
        + _bonus(F.contains(text, F.lit("http://")), 0.2)
        + _bonus(F.contains(text, F.lit("bit.ly")), 0.2)
    )
    return F.least(F.lit(1.0), score)


def calibrate(score: Column) -> Column:
    high = F.least(F.lit(0.99), F.lit(0.85) + score * F.lit(0.15))
    return F.when(score < 0.5, F.lit(0.8) + score * F.lit(0.3)).otherwise(high)


def spam_contributions(text: Column) -> dict[str, Column]:
    return {
        "promotional_terms": term_presence(text, fixed.PROMOTIONAL_TERMS),
        "urgency_language": term_presence(text, fixed.URGENCY_TERMS),
    }


def phishing_contributions(text: Column) -> dict[str, Column]:
    return {
        "credential_request": term_presence(text, fixed.CREDENTIAL_TERMS),
        "impersonation_risk": term_presence(text, fixed.IMPERSONATION_TERMS),
    }


def priority_heuristic(text: Column, terms: Sequence[str] = fixed.PRIORITY_TERMS) -> Column:
    return F.least(F.lit(1.0), F.lit(0.35) + term_presence(text, terms) * F.lit(0.5))


# ---- priority features -----------------------------------------------------------

FEATURES = ("urgency", "meeting", "question", "action", "attachment", "length_bucket")


def priority_features(text: Column) -> dict[str, Column]:
    """Six features; word sets match whitespace tokens, phrases match anywhere.

    A term with a space in it can never be a token.  Tokens are not split off:
    a word counts if it stands between whitespace or the ends of the text, and
    that is only looked at in texts that contain the word at all.
    """
    lower = F.lower(text)
    gap = r"[^\s\x1c-\x1f]"

    def has_any(terms):
        return reduce(or_, [F.contains(lower, F.lit(t)) for t in terms])

    def has_word(vocabulary):
        words = [w for w in vocabulary if " " not in w]
        return (has_any(words) & lower.rlike(f"(?U)(?<!{gap})(?:{'|'.join(words)})(?!{gap})")).cast("double")

    has_phrase = has_any(fixed.ACTION_PHRASES)
    bucket = F.when(F.length(text) < 100, 0.0).when(F.length(text) < 500, 1.0).otherwise(2.0)
    return {
        "urgency": has_word(fixed.URGENCY_WORDS),
        "meeting": has_word(fixed.MEETING_WORDS),
        "question": F.contains(text, F.lit("?")).cast("double"),
        "action": has_phrase.cast("double"),
        "attachment": has_word(fixed.ATTACHMENT_WORDS),
        "length_bucket": bucket,
    }


def priority_class(urgency: Column, meeting: Column, question: Column, action: Column, attachment: Column) -> Column:
    """0 low, 1 medium, 2 high from the signal features."""
    weight = urgency * F.lit(2.0) + meeting + question + action * F.lit(0.5) + attachment * F.lit(0.5)
    return F.when(weight >= 2.0, 2).when(weight >= 0.5, 1).otherwise(0)


def _pick(cls: Column, values: Sequence) -> Column:
    index = F.least(cls, F.lit(len(values) - 1)) + F.lit(1)
    return F.element_at(F.array(*[F.lit(v) for v in values]), index)


def priority_label(cls: Column) -> Column:
    return _pick(cls, fixed.PRIORITY_LABELS)


def priority_value(cls: Column) -> Column:
    return _pick(cls, fixed.PRIORITY_SCORES)


# ---- generated texts ---------------------------------------------------------------


def summarize(thread: Column) -> Column:
    """One line: kept whole up to 180 bytes, else its first 177 bytes and dots."""

    def shorten(line):
        cut = F.concat(truncate_bytes(line, fixed.SUMMARY_CUT_BYTES), F.lit(fixed.SUMMARY_TAIL))
        return F.when(F.octet_length(line) <= fixed.SUMMARY_MAX_BYTES, line).otherwise(cut)

    return bind(trim_space(F.replace(thread, F.lit("\n"), F.lit(" "))), shorten)


def thread_or_message(thread: Column, subject: Column, body: Column) -> Column:
    return F.when(is_blank(as_text(thread)), request_text(subject, body)).otherwise(as_text(thread))


def draft_reply(instruction: Column) -> Column:
    intent = trim_space(as_text(instruction))
    intent = F.when(intent == "", F.lit(fixed.DRAFT_DEFAULT_INTENT)).otherwise(intent)
    return F.format_string(fixed.DRAFT_TEMPLATE, intent)


def rewrite_reply(text: Column, tone: Column) -> Column:
    name = F.lower(as_text(tone))
    kept = F.when(is_blank(as_text(text)), F.lit(fixed.REWRITE_DEFAULT)).otherwise(as_text(text))
    return (
        F.when(name == "friendly", F.lit(fixed.REWRITE_FRIENDLY))
        .when(name == "formal", F.lit(fixed.REWRITE_FORMAL))
        .otherwise(kept)
    )


# ---- usage ---------------------------------------------------------------------------


def json_bytes(fields: dict[str, Column]) -> Column:
    """Bytes of the fields as a JSON object with sorted keys and HTML-safe escapes.

    A null field counts as absent.  ``<``, ``>`` and ``&`` take six bytes each there, U+2028 and U+2029 too;
    ``to_json`` leaves them as they are, so the difference is added.
    """
    doc = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "true"})

    def size(d):
        plain, joined = d, d
        for c in "<>&":
            plain = F.replace(plain, F.lit(c), F.lit(""))
        for c in "\u2028\u2029":
            joined = F.replace(joined, F.lit(c), F.lit(""))
        whole = F.octet_length(d)
        # One byte becomes six, three bytes become six.
        return whole + (whole - F.octet_length(plain)) * 5 + (whole - F.octet_length(joined))

    return bind(doc, size)


def input_tokens(fields: dict[str, Column]) -> Column:
    if not fields:
        return F.lit(0)
    return F.floor(json_bytes(fields) / F.lit(fixed.BYTES_PER_TOKEN)).cast("int")


def usage(fields: dict[str, Column]) -> Column:
    return F.struct(
        input_tokens(fields).alias("estimated_input_tokens"),
        F.lit(fixed.OUTPUT_TOKENS).alias("estimated_output_tokens"),
        F.lit(fixed.COST_USD).alias("estimated_cost_usd"),
    )


# ---- outputs of trained models -----------------------------------------------------------


def predict_from_probabilities(probs: Column) -> dict[str, Column]:
    """Label = first arg-max, confidence = maximum, score = probability of class 1."""
    top = F.array_max(probs)
    return {
        "label": (F.array_position(probs, top) - F.lit(1)).cast("int"),
        "confidence": top,
        "score": F.element_at(probs, 2),
    }


def to_number(value: Column, dtype: DataType) -> Column:
    """A numeric column as double, null as 0; a column of any other type is 0."""
    if isinstance(dtype, NumericType):
        return F.coalesce(value.cast("double"), F.lit(0.0))
    return F.lit(0.0)
