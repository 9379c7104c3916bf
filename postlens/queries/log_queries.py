"""Request, job and feedback log queries, batch and streaming."""

from pyspark.sql import functions as F

from .. import fixed
from ..operators import logs
from ..operators.policy import policy_table
from ..session import scratch_path
from ..sources import files
from ..streaming import jobs
from . import base as b
from .base import LOG, query, table
from .data_queries import LAB
from .text_queries import RESPONSE_SQL, flat_response

# ---- admission ---------------------------------------------------------------------------

RAW_REQ = """raw AS (
  SELECT event_id, ts, user_id, event_type, CASE event_id % 16 WHEN 0 THEN '  ' WHEN 5 THEN ' t' || (user_id % 7)::VARCHAR || ' ' ELSE 't' || (user_id % 7)::VARCHAR END AS header,
    CASE event_id % 16 WHEN 1 THEN '{"tenant_id": ' WHEN 2 THEN '{"tenant_id":" ","input":{}}'
      WHEN 3 THEN '{"tenant_id":"other","input":{}}' WHEN 4 THEN '{"tenant_id":"' || repeat('x', 300) || '"}'
      WHEN 6 THEN '{"tenant_id":' || (user_id % 7)::VARCHAR || '}' WHEN 7 THEN '{"tenant_id":{"a":1}}' WHEN 8 THEN '{"tenant_id":null}'
      ELSE '{"tenant_id":"t' || (user_id % 7)::VARCHAR || '","input":' || props || '}' END AS body FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY trim(header), date_trunc('hour', ts) ORDER BY ts, event_id) <= 2 AS allowed FROM raw),
adm AS (SELECT *, CASE WHEN trim(header) = '' THEN 'errors_missing_tenant' WHEN NOT allowed THEN 'rate_limited'
    WHEN strlen(body) > 256 OR NOT json_valid(body) OR json_type(body, '$.tenant_id') NOT IN ('VARCHAR', 'NULL') THEN 'errors_bad_json'
    WHEN trim(coalesce(json_extract_string(body, '$.tenant_id'), '')) = '' THEN 'errors_missing_payload_tenant'
    WHEN json_extract_string(body, '$.tenant_id') <> trim(header) THEN 'errors_tenant_mismatch' END AS reject_reason FROM ranked)"""


def _admitted(spark, sf):
    log = b.events_utc(spark, sf)
    kind = F.col("event_id") % 16
    whole = F.concat(F.lit('{"tenant_id":"'), "tenant_id", F.lit('","input":'), "props", F.lit("}"))
    body = (
        F.when(kind == 1, '{"tenant_id": ')
        .when(kind == 2, '{"tenant_id":" ","input":{}}')
        .when(kind == 3, '{"tenant_id":"other","input":{}}')
        .when(kind == 4, '{"tenant_id":"' + "x" * 300 + '"}')
        .when(kind == 6, F.concat(F.lit('{"tenant_id":'), F.substring("tenant_id", 2, 9), F.lit("}")))
        .when(kind == 7, '{"tenant_id":{"a":1}}')
        .when(kind == 8, '{"tenant_id":null}')
        .otherwise(whole)
    )
    raw = log.select(
        "event_id",
        "ts",
        F.when(kind == 0, "  ")
        .when(kind == 5, F.concat(F.lit(" "), "tenant_id", F.lit(" ")))
        .otherwise(F.col("tenant_id"))
        .alias("tenant_header"),
        body.alias("body"),
    )
    return logs.admit(raw, id_col="event_id", window_seconds=3600, max_requests=2, max_bytes=256)


@query("admit_requests", f"WITH {RAW_REQ} SELECT event_id, reject_reason FROM adm")
def admit_requests(spark, sf):
    return _admitted(spark, sf).select("event_id", "reject_reason")


@query(
    "request_counters",
    f"""WITH {RAW_REQ} SELECT 'requests_total' AS counter, count(*) AS n FROM adm
    UNION ALL SELECT reject_reason, count(*) FROM adm WHERE reject_reason IS NOT NULL GROUP BY reject_reason""",
)
def request_counters(spark, sf):
    return logs.request_counters(_admitted(spark, sf))


@query(
    "rate_limit",
    f"""WITH {LOG} SELECT event_id, tenant_id,
      row_number() OVER (PARTITION BY tenant_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 2 AS allowed FROM log""",
)
def rate_limit(spark, sf):
    log = b.events_utc(spark, sf)
    return logs.rate_limit(log, id_col="event_id", window_seconds=3600, max_requests=2).select(
        "event_id", "tenant_id", "allowed"
    )


@query(
    "rate_limit_default",
    """WITH d AS (SELECT event_id, 't' || (event_id % 2)::VARCHAR AS tenant_id,
      floor(epoch(ts) / 86400) AS day, ts FROM events)
    SELECT event_id, tenant_id, row_number() OVER (PARTITION BY tenant_id, day ORDER BY ts, event_id) <= 120 AS allowed FROM d""",
)
def rate_limit_default(spark, sf):
    """The default quota per minute, on a log in which a day's requests of two tenants come within one minute."""
    log = b.events_utc(spark, sf)
    day = F.floor(F.unix_micros("ts") / F.lit(86_400_000_000))
    within = F.pmod(F.unix_micros("ts"), F.lit(86_400_000_000))
    squeezed = log.select(
        "event_id",
        F.concat(F.lit("t"), (F.col("event_id") % 2).cast("string")).alias("tenant_id"),
        F.timestamp_micros((day * 60_000_000 + F.floor(within / 1440)).cast("long")).alias("ts"),
        F.unix_micros("ts").alias("_us"),
    ).withColumn("order_id", F.struct("_us", "event_id"))
    return logs.rate_limit(squeezed, id_col="order_id").select("event_id", "tenant_id", "allowed")


@query(
    "task_latency",
    f"""WITH {LOG} SELECT task_type, count(*) AS task_count,
      (sum(greatest(trunc(latency_ms)::BIGINT, 0)) // count(*))::BIGINT AS latency_avg_ms FROM log GROUP BY task_type""",
)
def task_latency(spark, sf):
    return logs.task_latency(b.events_utc(spark, sf))


# ---- jobs --------------------------------------------------------------------------------

JOBS = """job AS (
  SELECT event_id // 5 AS job_id, event_id % 5 AS seq, 't' || ((event_id // 5) % 7)::VARCHAR AS tenant_id, ts,
    CASE WHEN event_id % 5 = 0 THEN 'queued' WHEN event_id % 5 = 1 THEN 'running'
      WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'failed' ELSE 'running' END AS status
  FROM events),
last AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS rn FROM job),
ends AS (SELECT job_id, min(ts) AS c, max(ts) AS u, max(ts) FILTER (status = 'running') AS b, max(ts) FILTER (status IN ('completed', 'failed')) AS d FROM job GROUP BY job_id),
state AS (SELECT last.job_id, status, tenant_id, floor(epoch(c))::BIGINT AS created_at, floor(epoch(b))::BIGINT AS started_at, floor(epoch(u))::BIGINT AS updated_at,
    CASE WHEN status IN ('completed', 'failed') THEN floor(epoch(d))::BIGINT END AS completed_at
  FROM last JOIN ends USING (job_id) WHERE rn = 1)"""


def job_events(events):
    """The event table as job events: five steps per job."""
    e = F.col("event_id")
    step = e % 5
    status = (
        F.when(step == 0, fixed.JOB_QUEUED)
        .when(step == 1, fixed.JOB_RUNNING)
        .when(F.col("event_type") == "purchase", fixed.JOB_COMPLETED)
        .when(F.col("event_type") == "error", fixed.JOB_FAILED)
        .otherwise(fixed.JOB_RUNNING)
    )
    job = F.expr("event_id div 5")
    return events.select(
        job.alias("job_id"),
        step.alias("seq"),
        F.concat(F.lit("t"), (job % 7).cast("string")).alias("tenant_id"),
        b.utc(F.col("ts")).alias("ts"),
        status.alias("status"),
    )


def _times(df, *columns):
    return df.withColumns({c: b.epoch(F.col(c)) for c in columns})


def _states(spark, sf):
    state = logs.job_state(job_events(table(spark, sf, "events")), carry=("tenant_id",))
    return _times(state, "created_at", "started_at", "updated_at", "completed_at")


@query("job_state", f"WITH {JOBS} SELECT * FROM state")
def job_state(spark, sf):
    return _states(spark, sf)


@query("job_lookup", f"WITH {JOBS} SELECT * FROM state WHERE job_id = 45 AND tenant_id = 't3'")
def job_lookup(spark, sf):
    """One job, asked for by its tenant; another tenant's question finds nothing."""
    states = _states(spark, sf)
    return logs.job_by_id(states, 45, "t3").unionByName(logs.job_by_id(states, 45, "t4"))


@query("tenant_scope", f"WITH {JOBS} SELECT * FROM state WHERE tenant_id = 't3'")
def tenant_scope(spark, sf):
    return logs.tenant_scope(_states(spark, sf), "t3")


# ---- feedback -----------------------------------------------------------------------------


def feedback_records(log):
    return log.select(
        "tenant_id",
        "message_id",
        F.col("task_type").alias("feedback"),
        F.from_json("props", "map<string,string>").alias("attributes"),
        F.col("ts").alias("created_at"),
    )


_FEEDBACK_SQL = f"""WITH {LOG} SELECT tenant_id, message_id, task_type AS feedback,
  json_extract_string(props, '$.k') AS k, floor(epoch(ts))::BIGINT AS created_at FROM log"""


def _flat_feedback(df):
    return _times(
        df.select("tenant_id", "message_id", "feedback", F.col("attributes")["k"].alias("k"), "created_at"), "created_at"
    )


@query("feedback_log", _FEEDBACK_SQL)
def feedback_log(spark, sf):
    path = scratch_path(spark, "feedback")
    files.append_log(feedback_records(b.events_utc(spark, sf)), path)
    return _flat_feedback(spark.read.parquet(path))


@query(
    "feedback_labels",
    f"""WITH {LOG}, {LAB}, inf AS (SELECT 't' || (doc_id % 7)::VARCHAR AS tenant_id, doc_id::VARCHAR AS message_id, max_by(label, attempt) AS label
      FROM (SELECT doc_id, CASE attempt WHEN 0 THEN 1 - label ELSE label END AS label, attempt FROM lab, (VALUES (0), (1)) AS a(attempt))
      GROUP BY ALL)
    SELECT event_id, inf.label, CASE task_type WHEN 'error' THEN 1 WHEN 'click' THEN 0 END AS corrected_label
    FROM log JOIN inf USING (tenant_id, message_id)""",
)
def feedback_labels(spark, sf):
    log = b.events_utc(spark, sf).withColumnRenamed("task_type", "feedback")
    done = b.labelled_documents(spark, sf).select(
        F.concat(F.lit("t"), (F.col("doc_id") % 7).cast("string")).alias("tenant_id"),
        F.col("doc_id").cast("string").alias("message_id"),
        F.explode(F.array(F.struct((1 - F.col("label")).alias("label"), F.lit(0).alias("attempt")), F.struct("label", F.lit(1).alias("attempt")))).alias("_try"),
    ).select("tenant_id", "message_id", "_try.*")
    joined = logs.feedback_labels(log, done, {"error": 1, "click": 0}, order_col="attempt")
    return joined.select("event_id", "label", "corrected_label")


# ---- streams --------------------------------------------------------------------------------


def _event_stream(spark, sf):
    path = f"{sf.rstrip('/')}/events.parquet"
    return jobs.parquet_stream(spark, path, spark.read.parquet(path).schema)


# Append mode emits a window once the watermark has passed its end.
_CLOSED = "HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)"


@query(
    "stream_quota",
    f"""WITH {LOG} SELECT tenant_id, epoch(date_trunc('hour', ts))::BIGINT AS window_start, count(*) AS n,
      greatest(count(*) - 2, 0) AS denied FROM log GROUP BY tenant_id, date_trunc('hour', ts) {_CLOSED}""",
)
def stream_quota(spark, sf):
    stream = jobs.stream_quota(b.as_log(_event_stream(spark, sf)), window="1 hour", max_requests=2)
    return _times(jobs.run_to_table(stream, "quota"), "window_start")


@query(
    "stream_task_latency",
    f"""WITH {LOG} SELECT task_type, epoch(date_trunc('hour', ts))::BIGINT AS window_start, count(*) AS task_count,
      (sum(greatest(trunc(latency_ms)::BIGINT, 0)) // count(*))::BIGINT AS latency_avg_ms
    FROM log GROUP BY task_type, date_trunc('hour', ts) {_CLOSED}""",
)
def stream_task_latency(spark, sf):
    stream = jobs.stream_task_latency(b.as_log(_event_stream(spark, sf)))
    return _times(jobs.run_to_table(stream, "latency"), "window_start")


@query("stream_scoring", RESPONSE_SQL)
def stream_scoring(spark, sf):
    path = f"{sf.rstrip('/')}/documents.parquet"
    docs = jobs.parquet_stream(spark, path, spark.read.parquet(path).schema)
    requests = b.with_subject(docs).withColumn("request_id", F.col("doc_id").cast("string"))
    scored = jobs.stream_scoring(requests, overrides=policy_table(spark, b.POLICY_ROWS))
    return flat_response(jobs.run_to_table(scored, "responses"))


@query("stream_feedback", _FEEDBACK_SQL)
def stream_feedback(spark, sf):
    records = feedback_records(b.as_log(_event_stream(spark, sf)))
    return _flat_feedback(jobs.run_to_table(jobs.stream_feedback(records, dedup=False), "feedback"))


@query("stream_feedback_dedup", f"WITH {LOG} SELECT DISTINCT tenant_id, message_id, task_type AS feedback FROM log")
def stream_feedback_dedup(spark, sf):
    """Feedback without the repeats of a tenant's word on a message."""
    records = feedback_records(b.as_log(_event_stream(spark, sf)))
    return jobs.run_to_table(jobs.stream_feedback(records), "feedback-once").select("tenant_id", "message_id", "feedback")


@query(
    "stream_job_state",
    f"WITH {JOBS} SELECT job_id, status, tenant_id, updated_at FROM state",
)
def stream_job_state(spark, sf):
    latest = jobs.merge_job_state(job_events(_event_stream(spark, sf)), scratch_path(spark, "jobs"))
    return _times(latest.select("job_id", "status", "tenant_id", F.col("ts").alias("updated_at")), "updated_at")
