"""Request, job and feedback logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed
from ..functions.text import trim_space
from ..session import broadcast_if_small
from .anchors import with_window_start

_SALTS = 32


def window_index(ts: Column, seconds: int) -> Column:
    """Number of the calendar window of ``seconds`` that holds ``ts``."""
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000))


def rate_limit(
    df: DataFrame,
    *,
    tenant_col: str = "tenant_id",
    ts_col: str = "ts",
    id_col: str = "request_id",
    window_seconds: int = 60,
    max_requests: int = fixed.RATE_LIMIT_PER_MINUTE,
    anchored: bool = False,
    anchor: Column | None = None,
) -> DataFrame:
    """Add ``allowed``: is the request among its tenant's first in the window?

    Windows are calendar windows; with ``anchored`` they are those of all
    tenants together that start anew at the first request a full length or more
    after the last start (``anchor`` is the first start, else the first request
    is).  Requests before that start, or without a time, are allowed.  A tenant
    may send most of the traffic, so its requests are not ranked in one task:
    the first ``max_requests`` are found per salted part (a group limit before
    the shuffle), then among those, and every request compares itself with the
    last allowed one.
    """
    order = F.struct(F.col(ts_col).alias("t"), F.col(id_col).alias("i"))
    if anchored:
        placed = with_window_start(df, ts_col, window_seconds, "_start", anchor)
    else:
        placed = df.withColumn("_start", window_index(F.col(ts_col), window_seconds))
    marked = placed.withColumn("_order", order)
    narrow = marked.select(
        tenant_col, "_start", "_order", F.pmod(F.xxhash64(id_col), F.lit(_SALTS)).alias("_salt")
    )

    def first(frame, *parts):
        w = Window.partitionBy(*parts).orderBy("_order")
        return frame.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= max_requests)

    group = (tenant_col, "_start")
    allowed_rows = first(first(narrow.where(F.col("_start").isNotNull()), *group, "_salt"), *group)
    last = allowed_rows.where(F.col("_rank") == max_requests).select(*group, F.col("_order").alias("_last"))
    joined = marked.join(broadcast_if_small(last), list(group), "left")
    allowed = F.coalesce(F.col("_order") <= F.col("_last"), F.lit(True))
    return joined.withColumn("allowed", allowed).select(*df.columns, "allowed")


def admit_requests(
    df: DataFrame,
    *,
    header_col: str = "tenant_header",
    body_col: str = "body",
    allowed_col: str | None = None,
    max_bytes: int = fixed.MAX_REQUEST_BYTES,
) -> DataFrame:
    """Add the payload's tenant and ``reject_reason`` (null = admitted).

    Checks run in order: tenant header, quota (``allowed_col`` of
    :func:`rate_limit`), body size and JSON form, payload tenant, tenant match.
    A payload tenant that is neither a JSON string nor null is bad JSON.
    """
    header = trim_space(F.coalesce(F.col(header_col), F.lit("")))
    body = F.col(body_col)
    parsed = df.withColumn(
        "_doc", F.from_json(body, "tenant_id string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    )
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), "$.tenant_id", "variant"))
    broken = (
        ~F.coalesce(kind, F.lit("VOID")).isin("STRING", "VOID")
        | (F.octet_length(body) > max_bytes)
        | F.col("_doc").isNull()
        | F.col("_doc._bad").isNotNull()
        | (trim_space(body) == "")
    )
    tenant = F.coalesce(F.col("_doc.tenant_id"), F.lit(""))
    limited = ~F.col(allowed_col) if allowed_col else F.lit(False)
    reason = (
        F.when(header == "", fixed.REASON_MISSING_TENANT)
        .when(limited, fixed.REASON_RATE_LIMITED)
        .when(F.coalesce(broken, F.lit(True)), fixed.REASON_BAD_JSON)
        .when(trim_space(tenant) == "", fixed.REASON_MISSING_PAYLOAD_TENANT)
        .when(tenant != header, fixed.REASON_TENANT_MISMATCH)
    )
    return parsed.withColumns({"tenant_id": tenant, "reject_reason": reason}).drop("_doc")


def admit(
    df: DataFrame,
    *,
    header_col: str = "tenant_header",
    body_col: str = "body",
    ts_col: str = "ts",
    id_col: str = "request_id",
    window_seconds: int = 60,
    max_requests: int = fixed.RATE_LIMIT_PER_MINUTE,
    max_bytes: int = fixed.MAX_REQUEST_BYTES,
) -> DataFrame:
    """Quota and payload checks in one: the quota counts trimmed headers."""
    named = df.withColumn(header_col, trim_space(F.coalesce(F.col(header_col), F.lit(""))))
    counted = rate_limit(
        named, tenant_col=header_col, ts_col=ts_col, id_col=id_col, window_seconds=window_seconds, max_requests=max_requests
    )
    return admit_requests(counted, header_col=header_col, body_col=body_col, allowed_col="allowed", max_bytes=max_bytes)


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNotNull())


def request_counters(df: DataFrame, reason_col: str = "reject_reason") -> DataFrame:
    """Counters by name: all requests, and rejections by reason."""
    names = F.explode(F.array_compact(F.array(F.lit(fixed.COUNTER_TOTAL), F.col(reason_col))))
    return df.select(names.alias("counter")).groupBy("counter").agg(F.count("*").alias("n"))


def task_latency(df: DataFrame, *, task_col: str = "task_type", latency_col: str = "latency_ms") -> DataFrame:
    """Requests and whole-millisecond mean latency per task."""
    ms = F.greatest(F.col(latency_col).cast("bigint"), F.lit(0))
    sums = df.groupBy(task_col).agg(F.count("*").alias("n"), F.sum(ms).alias("_sum"))
    return sums.select(task_col, F.col("n").alias("task_count"), F.expr("_sum div n").alias("latency_avg_ms"))


def tenant_scope(df: DataFrame, tenant: str, *, tenant_col: str = "tenant_id") -> DataFrame:
    """Rows the tenant may see."""
    return df.where(F.col(tenant_col) == F.lit(tenant))


def job_by_id(df: DataFrame, job_id, tenant: str) -> DataFrame:
    return tenant_scope(df, tenant).where(F.col("job_id") == F.lit(job_id))


def job_state(
    df: DataFrame, *, job_col: str = "job_id", ts_col: str = "ts", seq_col: str = "seq", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Latest state of each job from its event log.

    ``carry`` names further columns taken from the latest event, such as an
    error text, an output path or a map of metrics.
    """
    ended = F.col("status").isin(fixed.JOB_COMPLETED, fixed.JOB_FAILED)
    latest = F.max_by(F.struct("status", *carry), F.struct(ts_col, seq_col))
    jobs = df.groupBy(job_col).agg(
        latest.alias("_last"),
        F.min(ts_col).alias("created_at"),
        F.max(ts_col).alias("updated_at"),
        F.max(F.when(F.col("status") == fixed.JOB_RUNNING, F.col(ts_col))).alias("started_at"),
        F.max(F.when(ended, F.col(ts_col))).alias("_ended"),
    )
    done = F.col("_last.status").isin(fixed.JOB_COMPLETED, fixed.JOB_FAILED)
    return jobs.select(
        job_col,
        "_last.*",
        "created_at",
        "started_at",
        "updated_at",
        F.when(done, F.col("_ended")).alias("completed_at"),
    )


def job_durations(states: DataFrame, keys: Sequence[str] = ("tenant_id", "status")) -> DataFrame:
    """Jobs per key, how many have ended, and the total and longest time from creation to end.

    ``states`` has created_at and completed_at in seconds.
    """
    took = F.col("completed_at") - F.col("created_at")
    return states.groupBy(*keys).agg(
        F.count("*").alias("jobs"), F.count(took).alias("ended"), F.sum(took).alias("total_seconds"), F.max(took).alias("longest_seconds")
    )


def feedback_labels(
    feedback: DataFrame,
    inference: DataFrame,
    corrections: dict[str, int] | None = None,
    *,
    order_col: str | None = None,
    task_col: str | None = None,
) -> DataFrame:
    """Feedback joined to what was predicted, as corrected labels.

    Both sides carry (tenant_id, message_id); the inference side a ``label``.
    With ``order_col`` only the latest inference of a message counts (of a
    message and task, with ``task_col``), so retries do not multiply feedback.
    """
    if order_col is not None:
        key = ["tenant_id", "message_id", *([task_col] if task_col else [])]
        rest = [c for c in inference.columns if c not in key]
        latest = inference.groupBy(*key).agg(F.max_by(F.struct(*rest), order_col).alias("_last"))
        inference = latest.select(*key, "_last.*")
    joined = feedback.join(inference, ["tenant_id", "message_id"])
    if corrections is None:
        return joined
    fixed_label = F.lit(None).cast("int")
    for text, label in corrections.items():
        fixed_label = F.when(F.col("feedback") == text, F.lit(label)).otherwise(fixed_label)
    return joined.withColumn("corrected_label", fixed_label)
