"""Tenant policies: overrides over defaults, as a size-checked lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed, schemas
from ..session import broadcast_if_small

DEFAULTS = {
    "spam_threshold": fixed.DEFAULT_SPAM_THRESHOLD,
    "phishing_threshold": fixed.DEFAULT_PHISHING_THRESHOLD,
    "min_confidence": fixed.DEFAULT_MIN_CONFIDENCE,
    "preferred_model": fixed.PRIMARY_MODEL,
}


def policy_table(spark, overrides: list[tuple]) -> DataFrame:
    """Policy overrides from (tenant, spam, phishing, confidence, model) tuples.

    The last one given for a tenant counts.
    """
    return spark.createDataFrame(list({row[0]: row for row in overrides}.values()), schemas.POLICY)


def resolve_policy(df: DataFrame, overrides: DataFrame | None, defaults: dict | None = None) -> DataFrame:
    """Add the effective policy of ``tenant_id`` to every row.

    ``overrides`` has one row per tenant; a field of it counts only if it is
    positive or non-empty.
    """
    base = {**DEFAULTS, **(defaults or {})}
    if overrides is None:
        return df.withColumns({name: F.lit(v) for name, v in base.items()})
    side = overrides.select("tenant_id", *[F.col(name).alias(f"_o_{name}") for name in base])
    joined = df.join(broadcast_if_small(side), "tenant_id", "left")

    def effective(name, default):
        given = F.col(f"_o_{name}")
        used = given != "" if isinstance(default, str) else given > 0
        return F.when(used, given).otherwise(F.lit(default))

    resolved = joined.withColumns({name: effective(name, v) for name, v in base.items()})
    return resolved.drop(*[f"_o_{name}" for name in base])
