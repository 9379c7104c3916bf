"""Insight over logs: job changes, re-anchored quota, acceptance, anomalies, trends, sketches, registry, bulk sending."""

from pyspark.sql import functions as F

from .. import fixed
from ..operators import answers, bulk, logs, metrics, registry, sketches, trends
from ..session import scratch_path
from ..streaming import job_states, jobs
from . import base as b
from .base import LOG, query, table
from .log_queries import JOBS, _event_stream, _times, job_events
from .model_queries import METRICS, predictions

# ---- job changes ------------------------------------------------------------------------


@query("stream_job_changes", f"WITH {JOBS} SELECT * FROM state")
def stream_job_changes(spark, sf):
    """The last change of every job, from keyed state; equals the batch states."""
    changes, _ = job_states.write_job_changes(job_states.job_changes(job_events(_event_stream(spark, sf)), carry=("tenant_id",)))
    return _times(job_states.current_states(changes), "created_at", "started_at", "updated_at", "completed_at")


@query(
    "job_durations",
    f"""WITH {JOBS}, d AS (SELECT tenant_id, status, completed_at - created_at AS s FROM state)
    SELECT tenant_id, status, count(*) AS jobs, count(s) AS ended, sum(s)::BIGINT AS total_seconds, max(s) AS longest_seconds FROM d GROUP BY ALL""",
)
def job_durations(spark, sf):
    states = logs.job_state(job_events(table(spark, sf, "events")), carry=("tenant_id",))
    return logs.job_durations(_times(states, "created_at", "completed_at"))


# ---- quota ------------------------------------------------------------------------------


@query(
    "rate_limit_anchored",
    f"""WITH RECURSIVE {LOG}, starts AS (
      SELECT min(ts) AS a FROM log UNION ALL
      SELECT (SELECT min(ts) FROM log WHERE ts >= a + INTERVAL 1 HOUR) FROM starts WHERE a IS NOT NULL),
    w AS (SELECT event_id, tenant_id, ts, a FROM log ASOF JOIN (SELECT a FROM starts WHERE a IS NOT NULL) s ON ts >= a)
    SELECT event_id, tenant_id, row_number() OVER (PARTITION BY tenant_id, a ORDER BY ts, event_id) <= 2 AS allowed FROM w""",
)
def rate_limit_anchored(spark, sf):
    """Windows of an hour that start at the first request an hour or more after the last start."""
    log = b.events_utc(spark, sf)
    return logs.rate_limit(log, id_col="event_id", window_seconds=3600, max_requests=2, anchored=True).select(
        "event_id", "tenant_id", "allowed"
    )


# ---- acceptance -------------------------------------------------------------------------

# Every other event is an inference, the others are feedback on the message.
ANSWERS = f"""{LOG},
inf AS (SELECT event_id AS inference_id, tenant_id, (event_id // 100)::VARCHAR AS message_id, ts, 0.0005::DOUBLE * (1 + event_id % 3) AS cost_usd
  FROM log WHERE event_id % 2 = 0),
fb AS (SELECT event_id AS feedback_id, tenant_id, (event_id // 100)::VARCHAR AS message_id, ts,
    CASE WHEN task_type IN ('purchase', 'click') THEN 'accepted' ELSE 'rejected' END AS feedback FROM log WHERE event_id % 2 = 1),
told AS (SELECT inference_id, arg_min(feedback, (fb.ts, feedback_id)) AS feedback FROM inf JOIN fb USING (tenant_id, message_id)
  WHERE fb.ts BETWEEN inf.ts AND inf.ts + INTERVAL 5 DAY GROUP BY inference_id),
one AS (SELECT inf.*, feedback FROM inf LEFT JOIN told USING (inference_id)),
closed AS (SELECT * FROM one WHERE ts < (SELECT max(ts) - INTERVAL 7 DAY FROM log))"""

_RATES = """count(*) AS inferences, count(feedback) AS answered, count(*) FILTER (feedback = 'accepted') AS accepted,
  round(count(*) FILTER (feedback = 'accepted')::DOUBLE / nullif(count(feedback), 0), 6) AS acceptance_rate, round(sum(cost_usd), 6) AS cost_usd,
  round(sum(cost_usd) / count(*), 6) AS cost_per_inference, round(sum(cost_usd) / nullif(count(*) FILTER (feedback = 'accepted'), 0), 6) AS cost_per_accepted"""


def _sides(log):
    message = F.expr("event_id div 100").cast("string")
    inferences = log.where("event_id % 2 = 0").select(
        "tenant_id", message.alias("message_id"), F.col("event_id").alias("inference_id"), "ts",
        (F.lit(fixed.COST_USD) * (1 + F.col("event_id") % 3)).alias("cost_usd"),
    )
    said = F.when(F.col("task_type").isin("purchase", "click"), "accepted").otherwise("rejected")
    feedback = log.where("event_id % 2 = 1").select(
        "tenant_id", message.alias("message_id"), F.col("event_id").alias("feedback_id"), said.alias("feedback"), "ts"
    )
    return inferences, feedback


def _rates(linked):
    got = answers.acceptance(answers.first_answers(linked))
    return got.withColumns({c: F.round(c, 6) for c in ("acceptance_rate", "cost_usd", "cost_per_inference", "cost_per_accepted")})


@query("acceptance_rate", f"WITH {ANSWERS} SELECT tenant_id, {_RATES} FROM one GROUP BY tenant_id")
def acceptance_rate(spark, sf):
    return _rates(answers.link_feedback(*_sides(b.events_utc(spark, sf)), within="5 days"))


@query("stream_acceptance", f"WITH {ANSWERS} SELECT tenant_id, {_RATES} FROM closed GROUP BY tenant_id")
def stream_acceptance(spark, sf):
    """The same from two streams, over inferences whose interval has closed with a day to spare."""
    inferences, feedback = (_sides(b.as_log(_event_stream(spark, sf)))[i] for i in (0, 1))
    linked = answers.link_feedback(inferences, feedback, within="5 days", delays=("1 minute", "1 minute"))
    last = b.events_utc(spark, sf).agg(F.max(F.unix_micros("ts")).alias("t")).first()["t"]
    written = jobs.run_to_table(linked, "answers")
    return _rates(written.where(F.unix_micros("ts") < (last or 0) - 7 * 86_400_000_000))


# ---- days -------------------------------------------------------------------------------

# Every third day of a tenant is thinned out to one event in fifty, and one in nine is empty.
DAYS = f"""{LOG},
thin AS (SELECT *, epoch(ts)::BIGINT // 86400 AS d, substr(tenant_id, 2)::BIGINT AS t FROM log),
busy AS (SELECT * FROM thin WHERE CASE WHEN (d + t) % 9 = 0 THEN false WHEN (d + t) % 3 = 0 THEN event_id % 50 = 0 ELSE true END),
span AS (SELECT tenant_id, min(d) AS f, (SELECT max(d) FROM busy) AS l FROM busy GROUP BY tenant_id),
grid AS (SELECT tenant_id, unnest(range(f, l + 1)) AS d FROM span),
mom AS (SELECT tenant_id, d, count(*) AS n, sum(floor(latency_ms)::HUGEINT) AS s, sum(floor(latency_ms)::HUGEINT * floor(latency_ms)::HUGEINT) AS q FROM busy GROUP BY tenant_id, d),
days AS (SELECT tenant_id, d, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(q, 0) AS q FROM grid LEFT JOIN mom USING (tenant_id, d))"""


def _thinned(spark, sf):
    log = b.events_utc(spark, sf)
    day = F.unix_date(trends.day_of(F.col("ts")))
    phase = day + F.substring("tenant_id", 2, 9).cast("int")
    keep = F.when(phase % 9 == 0, F.lit(False)).when(phase % 3 == 0, F.col("event_id") % 50 == 0).otherwise(F.lit(True))
    return log.where(keep)


def _days(spark, sf):
    """Moments of two loads, merged and filled."""
    log = _thinned(spark, sf)
    loads = [trends.daily_moments(log.where(F.col("event_id") % 2 == i), F.col("latency_ms")) for i in (0, 1)]
    return trends.fill_days(trends.merge_moments(loads[0].unionByName(loads[1])))


@query(
    "volume_anomalies",
    f"""WITH {DAYS}, f AS (SELECT *, count(*) OVER w AS k, coalesce(sum(n) OVER w, 0) AS sn, coalesce(sum(n * n) OVER w, 0) AS qn FROM days
      WINDOW w AS (PARTITION BY tenant_id ORDER BY d RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING))
    SELECT tenant_id, d AS day, n AS volume, k AS days_before, round(sn::DOUBLE / nullif(k, 0), 6) AS mean,
      round(sqrt((k * qn - sn * sn)::DOUBLE) / nullif(k, 0), 6) AS deviation,
      round(CASE WHEN k * qn > sn * sn THEN (k * n - sn)::DOUBLE / sqrt((k * qn - sn * sn)::DOUBLE) END, 6) AS z,
      k >= 3 AND k * n <> sn AND (k * n - sn)::DOUBLE * (k * n - sn)::DOUBLE >= 9 * (k * qn - sn * sn)::DOUBLE AS anomalous FROM f""",
)
def volume_anomalies(spark, sf):
    got = trends.volume_anomalies(_days(spark, sf))
    return got.withColumns({"day": F.unix_date("day").cast("long"), **{c: F.round(c, 6) for c in ("mean", "deviation", "z")}})


@query(
    "latency_anomalies",
    f"""WITH {DAYS}, f AS (SELECT *, coalesce(sum(n) OVER w, 0) AS n7, coalesce(sum(s) OVER w, 0) AS s7, coalesce(sum(q) OVER w, 0) AS q7 FROM days
      WINDOW w AS (PARTITION BY tenant_id ORDER BY d RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, (n7 * q7 - s7 * s7)::DOUBLE AS v, s::DOUBLE / nullif(n, 0) AS m, s7::DOUBLE / nullif(n7, 0) AS u FROM f),
    h AS (SELECT *, CASE WHEN v > 0 AND n > 0 AND n7 > 0 THEN (m - u) / (sqrt(v) / n7 / sqrt(n::DOUBLE)) END AS z FROM g)
    SELECT tenant_id, d AS day, n AS volume, round(m, 6) AS mean, round(u, 6) AS usual, round(z, 6) AS z,
      coalesce(abs(z) >= 2, false) AND n >= 5 AS anomalous FROM h""",
)
def latency_anomalies(spark, sf):
    got = trends.value_anomalies(_days(spark, sf), threshold=2.0, min_rows=5)
    return got.withColumns({"day": F.unix_date("day").cast("long"), **{c: F.round(c, 6) for c in ("mean", "usual", "z")}})


@query(
    "tenant_trends",
    f"""WITH {DAYS}, c AS (SELECT tenant_id, task_type AS label, d, count(*) AS n FROM busy GROUP BY ALL),
    s AS (SELECT 'tenant label' AS level, tenant_id, label, d, n FROM c UNION ALL
      SELECT 'tenant', tenant_id, NULL, d, sum(n) FROM c GROUP BY tenant_id, d UNION ALL
      SELECT 'label', NULL, label, d, sum(n) FROM c GROUP BY label, d UNION ALL SELECT 'all', NULL, NULL, d, sum(n) FROM c GROUP BY d),
    t AS (SELECT tenant_id, d, sum(n) AS total FROM c GROUP BY tenant_id, d UNION ALL SELECT NULL, d, sum(n) FROM c GROUP BY d)
    SELECT s.level, s.tenant_id, s.label, s.d AS day, s.n::BIGINT AS n, round(s.n::DOUBLE / t.total, 6) AS share,
      CASE WHEN s.d > (SELECT min(d) FROM c) THEN (s.n - coalesce(p.n, 0))::BIGINT END AS change
    FROM s JOIN t ON s.tenant_id IS NOT DISTINCT FROM t.tenant_id AND s.d = t.d
    LEFT JOIN s AS p ON p.level = s.level AND p.tenant_id IS NOT DISTINCT FROM s.tenant_id AND p.label IS NOT DISTINCT FROM s.label AND p.d = s.d - 1""",
)
def tenant_trends(spark, sf):
    got = trends.tenant_trends(_thinned(spark, sf), label_col="task_type")
    return got.withColumns({"day": F.unix_date("day").cast("long"), "share": F.round("share", 6)})


# ---- percentiles from sketches ----------------------------------------------------------

# Ranks of percentiles from sketches must lie within a hundredth of their share.
_WITHIN = "SELECT task_type, count(*) AS n, true AS p50_ms, true AS p95_ms, true AS p99_ms FROM log GROUP BY task_type"


def _within(spark, sf, stored):
    """Are the ranks of percentiles, rebuilt from stored sketches alone, near enough?"""
    found = sketches.sketch_percentiles(sketches.merge_sketches(stored, ["task_type"]), ["task_type"])
    far = sketches.rank_errors(b.events_utc(spark, sf), found, ["task_type"])
    return far.select("task_type", "n", *[(F.col(c) <= 0.01).alias(c) for c in sketches.SHARES])


@query("latency_sketches", f"WITH {LOG} {_WITHIN}")
def latency_sketches(spark, sf):
    path = scratch_path(spark, "sketches")
    sketches.latency_sketches(b.events_utc(spark, sf), window="1 hour").write.parquet(path)
    return _within(spark, sf, spark.read.parquet(path))


@query(
    "stream_latency_sketches",
    f"""WITH {LOG} SELECT task_type, count(*) AS n, round(avg(latency_ms), 6) AS mean_ms FROM log
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM log) GROUP BY task_type""",
)
def stream_latency_sketches(spark, sf):
    """Daily sketches from a stream, merged over the closed days; counts and means are exact."""
    made = sketches.latency_sketches(b.as_log(_event_stream(spark, sf)), window="1 day", delay="1 minute")
    merged = sketches.merge_sketches(jobs.run_to_table(made, "sketches"), ["task_type"])
    got = sketches.sketch_percentiles(merged, ["task_type"])
    return got.select("task_type", "n", F.round("mean_ms", 6).alias("mean_ms"))


# ---- registry ---------------------------------------------------------------------------

# Four runs per model, each a slice of the predictions, at one hour's distance; decided one after the other.
RUNS = METRICS.replace("GROUP BY model, task)", "GROUP BY model, task, run)", 1).replace(
    "count(*) AS support FROM pred", "count(*) AS support, run FROM (SELECT *, doc_id % 4 AS run FROM pred)"
)


@query(
    "run_registry",
    f"""WITH RECURSIVE {RUNS},
    g AS (SELECT task, run, p, r, f1, p >= 0.3 AND r >= 0.3 AND f1 >= 0.3 AS ok FROM met),
    steps AS (SELECT task, -1::BIGINT AS run, NULL::DOUBLE AS bp, NULL::DOUBLE AS br, NULL::DOUBLE AS bf, false AS promoted FROM (SELECT DISTINCT task FROM g)
      UNION ALL SELECT g.task, g.run, CASE WHEN yes THEN p ELSE bp END, CASE WHEN yes THEN r ELSE br END, CASE WHEN yes THEN f1 ELSE bf END, yes
      FROM (SELECT g.*, s.bp, s.br, s.bf, g.ok AND coalesce(p >= bp - 0.02 AND r >= br - 0.02 AND f1 >= bf - 0.02, true) AS yes
        FROM steps s JOIN g ON g.task = s.task AND g.run = s.run + 1) g)
    SELECT task, 'run' || run::VARCHAR AS run_id, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, promoted
    FROM steps JOIN g USING (task, run)""",
)
def run_registry(spark, sf):
    """Three loads into one registry; what a load has decided binds the next."""
    measured = metrics.classification_metrics(
        predictions(spark, sf).withColumn("run", F.col("doc_id") % 4), ["model", "task", "run"]
    )
    runs = measured.select(
        "task", F.concat(F.lit("run"), F.col("run").cast("string")).alias("run_id"),
        F.timestamp_seconds(F.col("run") * 3600).alias("at"), "precision", "recall", "f1", "run",
    )
    gates = metrics.gate_table(spark, {t: (0.3, 0.3, 0.3) for t in fixed.GATES})
    path = scratch_path(spark, "registry")
    for part in ("run = 0", "run IN (1, 2)", "run >= 2"):
        registry.register_runs(runs.where(part), gates, path, tolerance=0.02)
    rows = registry.read_registry(spark, path)
    return rows.select("task", "run_id", *[F.round(m, 6).alias(m) for m in registry.KEY_METRICS], "promoted")


# ---- bulk sending -----------------------------------------------------------------------

# A message per event; every fifth carries one of four mass texts.
_MASS = "CASE WHEN event_id % 5 = 0 THEN 'Mass  mail ' || (event_id % 4)::VARCHAR ELSE 'note ' || (event_id % 3000)::VARCHAR END"


@query(
    "bulk_senders",
    f"""WITH {LOG}, m AS (SELECT tenant_id, (epoch(ts)::BIGINT // 86400) * 3600 AS hour, lower({_MASS}) AS t FROM log)
    SELECT tenant_id, hour, md5(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS content, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 3""",
)
def bulk_senders(spark, sf):
    """A day of the log counts as an hour, so that contents come together; two loads with a sketch each."""
    log = b.events_utc(spark, sf)
    number = F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("Mass  mail "), (F.col("event_id") % 4).cast("string"))).otherwise(
        F.concat(F.lit("note "), (F.col("event_id") % 3000).cast("string"))
    )
    squeezed = F.timestamp_seconds(F.floor(F.unix_micros("ts") / F.lit(86_400_000_000)) * 3600)
    sent = bulk.contents(log.select("tenant_id", text.alias("text"), squeezed.alias("ts"), number.alias("id")))
    loads = [bulk.count_min(sent.where(F.pmod(F.xxhash64("content"), F.lit(2)) == i)) for i in (0, 1)]
    return bulk.bulk_senders(sent, 3, bulk.merge_count_min(loads[0].unionByName(loads[1])))
