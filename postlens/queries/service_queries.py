"""Envelopes of all tasks, shuffled splits, review queue, retention and byte checks."""

import datetime as dt

from pyspark.sql import functions as F

from .. import fixed
from ..operators import corpus, logs, review
from ..operators.policy import policy_table
from ..plans.score import prepare_requests, score_messages
from ..session import materialize, scratch_path
from ..sources import raw, retention, splits
from . import base as b
from .base import LOG, REQ, query, table
from .data_queries import LAB
from .text_queries import _JSON_SQL

# ---- envelopes of all nine tasks ----------------------------------------------------------

_TOKENS = "((strlen(j) + 5 * (length(j) - length(translate(j, '<>&', '')))) // 4)::INT AS input_tokens"
_DRAFT = "'Hi,' || chr(10) || chr(10) || 'Thanks for reaching out. I have reviewed your note about follow up and will follow up with the next steps shortly.' || chr(10) || chr(10) || 'Best regards,'"
_LINE = "trim(replace(t, chr(10), ' '))"
_SUMMARY = f"CASE WHEN strlen({_LINE}) <= 180 THEN {_LINE} ELSE {b.sql_cut(_LINE, 177)} || '...' END"
_PRIORITY = f"least(1.0::DOUBLE, 0.35::DOUBLE + {b.sql_presence('t', ('urgent', 'deadline', 'today'))} * 0.5::DOUBLE)"
_CALLS = {"spam": "spam-classification", "phish": "phishing-classification"}
_OTHER = (
    (fixed.TASK_DRAFT, 0.92, _DRAFT, "NULL::DOUBLE", "instruction-conditioned draft generation"),
    (fixed.TASK_REWRITE, 0.93, "'Thank you for your message.'", "NULL::DOUBLE", "tone-aware rewrite"),
    (fixed.TASK_SUMMARY, 0.9, _SUMMARY, "NULL::DOUBLE", "extractive summary pipeline"),
    (fixed.TASK_SEARCH, 0.85, "''", "NULL::DOUBLE", "embedding retrieval baseline"),
    (fixed.TASK_PRIORITY, 0.82, "NULL::VARCHAR", _PRIORITY, "priority signal aggregation"),
    (fixed.TASK_ANOMALY, 0.84, "NULL::VARCHAR", "0.1::DOUBLE", "tenant anomaly baseline"),
    (fixed.TASK_FEEDBACK, 1.0, "'accepted'", "NULL::DOUBLE", "feedback accepted"),
)
_TOLD = {
    "spam": ("content pattern analysis,sender/wording heuristic embedding", "fallback conservative spam scorer"),
    "phish": ("link/authentication signal analysis,impersonation phrase detection", "fallback conservative phishing scorer"),
}


def _classified_sql(task):
    usual, fallback = _TOLD[task]
    return f"""SELECT * FROM (WITH {b.sql_routed(task)}, j AS (SELECT *, {_JSON_SQL}::VARCHAR AS j FROM routed)
      SELECT doc_id, '{_CALLS[task]}' AS task_type, model_name, round(confidence, 6) AS confidence, NULL::VARCHAR AS answer, round(score, 6) AS number,
        label, recommended_action, flags AS safety_flags, CASE WHEN fb THEN '{fallback}' ELSE '{usual}' END AS explanations, {_TOKENS} FROM j)"""


def _other_sql(task, confidence, answer, number, told):
    return f"""SELECT * FROM (WITH {REQ}, j AS (SELECT *, {_JSON_SQL}::VARCHAR AS j FROM txt)
      SELECT doc_id, '{task}' AS task_type, 'local-primary-v1' AS model_name, {confidence}::DOUBLE AS confidence, {answer} AS answer, round({number}, 6) AS number,
        NULL::VARCHAR AS label, NULL::VARCHAR AS recommended_action, {b.FLAGS_SQL} AS safety_flags, '{told}' AS explanations, {_TOKENS} FROM j)"""


#: Field of the result that holds a text, and that which holds a number, per task.
_RESULT = {
    fixed.TASK_SPAM: (None, "spam_score"),
    fixed.TASK_PHISHING: (None, "phishing_score"),
    fixed.TASK_DRAFT: ("draft", None),
    fixed.TASK_REWRITE: ("rewrite", None),
    fixed.TASK_SUMMARY: ("summary", None),
    fixed.TASK_SEARCH: ("query", None),
    fixed.TASK_PRIORITY: (None, "priority_score"),
    fixed.TASK_ANOMALY: (None, "anomaly_score"),
    fixed.TASK_FEEDBACK: ("status", None),
}


@query("task_envelopes", " UNION ALL ".join([_classified_sql(t) for t in _CALLS] + [_other_sql(*t) for t in _OTHER]))
def task_envelopes(spark, sf):
    """The answer to every message by every task."""
    # what the tasks share is worked out once; they read the request text, not the fields it is made of
    requests = materialize(prepare_requests(b.message_requests(spark, sf)).drop("subject", "body", "doc_id"), "requests")
    policy, out = policy_table(spark, b.POLICY_ROWS), None
    for task, (text, number) in _RESULT.items():
        e = score_messages(requests, task, overrides=policy, prepared=True)
        decided = text is None and number.endswith(("spam_score", "phishing_score"))
        flat = e.select(
            F.col("request_id").cast("bigint").alias("doc_id"),
            "task_type",
            "model_name",
            F.round("confidence", 6).alias("confidence"),
            (F.col(f"result.{text}") if text else F.lit(None).cast("string")).alias("answer"),
            (F.round(F.col(f"result.{number}").cast("double"), 6) if number else F.lit(None).cast("double")).alias("number"),
            *[(F.col(f"result.{c}") if decided else F.lit(None).cast("string")).alias(c) for c in ("label", "recommended_action")],
            F.array_join("safety_flags", ",").alias("safety_flags"),
            F.array_join("explanations", ",").alias("explanations"),
            F.col("usage.estimated_input_tokens").alias("input_tokens"),
        )
        out = flat if out is None else out.unionByName(flat)
    return out


# ---- split files --------------------------------------------------------------------------


@query(
    "split_files",
    f"""WITH {LAB}, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || doc_id::VARCHAR), doc_id) AS k,
        count(*) OVER (PARTITION BY label) AS n FROM lab),
    s AS (SELECT doc_id, label, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r)
    SELECT split, row_number() OVER (PARTITION BY split ORDER BY md5('42|order|' || doc_id::VARCHAR), doc_id) AS position, doc_id AS msg_id, label FROM s""",
)
def split_files(spark, sf):
    """Splits written in shuffled order, several files each, and read back file by file."""
    docs = b.labelled_documents(spark, sf).select(F.col("doc_id").alias("msg_id"), "text", "label", "source")
    cut = corpus.stratified_split(docs)
    path = splits.save_shuffled_splits(cut, scratch_path(spark, "split-files"), "spam_", rows_per_file=100)
    parts = [splits.load_in_order(spark, path, s).select(F.lit(s).alias("split"), "position", "msg_id", "label") for s in fixed.SPLITS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- review queue -------------------------------------------------------------------------

# What was predicted: spam for two of three messages, with a confidence of two digits of a digest.
INFERRED = """inf AS (SELECT 't' || (doc_id % 7)::VARCHAR AS tenant_id, doc_id::VARCHAR AS message_id,
    CASE WHEN doc_id % 3 = 0 THEN 'ham' ELSE 'spam' END AS label, ('0x' || substr(md5(doc_id::VARCHAR), 1, 2))::INT AS confidence FROM documents)"""


@query(
    "review_queue",
    f"""WITH {LOG}, {INFERRED}, w AS (SELECT tenant_id, message_id, max(confidence) AS confidence, count(*) AS reports
      FROM log JOIN inf USING (tenant_id, message_id) WHERE label = 'spam' AND task_type IN ('error', 'view', 'click') GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY confidence DESC, reports DESC, message_id) AS rank FROM w)
    SELECT tenant_id, message_id, confidence, reports, rank FROM k WHERE rank <= 10""",
)
def review_queue(spark, sf):
    """The ten most confident spam verdicts of each tenant that users contradict."""
    doc = F.col("doc_id").cast("string")
    done = table(spark, sf, "documents").select(
        F.concat(F.lit("t"), (F.col("doc_id") % 7).cast("string")).alias("tenant_id"),
        doc.alias("message_id"),
        F.when(F.col("doc_id") % 3 == 0, "ham").otherwise("spam").alias("label"),
        F.conv(F.substring(F.md5(doc), 1, 2), 16, 10).cast("int").alias("confidence"),
    )
    said = F.when(F.col("task_type").isin("error", "view", "click"), " Not spam").otherwise("spam")
    feedback = b.events_utc(spark, sf).select("tenant_id", "message_id", said.alias("feedback"))
    return review.review_queue(logs.feedback_labels(feedback, done), 10)


# ---- retention ----------------------------------------------------------------------------

KEPT_FROM = dt.datetime(2024, 1, 15, 9, 30, tzinfo=dt.timezone.utc)


@query(
    "retention",
    f"""WITH {LOG} SELECT epoch(date_trunc('day', ts))::BIGINT // 86400 AS day, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id
    FROM log WHERE ts >= TIMESTAMP '2024-01-15 09:30:00' GROUP BY ALL""",
)
def retention_days(spark, sf):
    """Three loads of the log, expired in the middle of a day and vacuumed."""
    log, path = b.events_utc(spark, sf), scratch_path(spark, "managed-log")
    for i in range(3):
        retention.append(log.where(F.col("event_id") % 3 == i), path, ts_col="ts")
    retention.expire(spark, path, KEPT_FROM, log.schema, ts_col="ts")
    retention.vacuum(spark, path, grace_seconds=-60)
    rows = retention.read(spark, path, log.schema)
    day = F.floor(F.unix_micros("ts") / F.lit(86_400_000_000)).alias("day")
    return rows.groupBy(day).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


# ---- bytes --------------------------------------------------------------------------------

#: Endings that are no UTF-8 (or are, the first and the last), by id.
_TAILS = ("", "FF", "C3", "E282", "EFBF", "EDA080", "C0AF", "F0908080")


@query(
    "utf8_verdicts",
    f"""WITH l AS (SELECT doc_id, (doc_id % 8)::INT AS kind, strlen(regexp_replace(coalesce(text, ''), '[\\r\\n]', ' ', 'g')) AS n FROM documents)
    SELECT kind, count(*) AS lines, count(*) FILTER (kind NOT IN (0, 7)) AS bad, coalesce(sum(n) FILTER (kind NOT IN (0, 7)), 0)::BIGINT AS bad_bytes FROM l GROUP BY kind""",
)
def utf8_verdicts(spark, sf):
    """Lines written as bytes, one in eight with each ending, read as bytes; ``bad_bytes`` sums the offsets of the first bad one."""
    d = table(spark, sf, "documents")
    line = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]", " ").cast("binary")
    kind = F.col("doc_id") % len(_TAILS)
    tail = F.unhex(F.element_at(F.array(*[F.lit(t) for t in _TAILS]), (kind + 1).cast("int")))
    path = scratch_path(spark, "raw-lines")
    d.select(F.concat(kind.cast("string").cast("binary"), line, tail).cast("string").alias("value")).write.text(path)
    judged = raw.encoding_verdicts(raw.read_lines(spark, path))
    named = judged.withColumn("kind", F.substring("line", 1, 1).cast("string").cast("int"))
    return named.groupBy("kind").agg(
        F.count("*").alias("lines"), F.count_if(F.col("verdict") == raw.BAD_ENCODING).alias("bad"), F.coalesce(F.sum(F.col("bad_byte") - 1), F.lit(0)).alias("bad_bytes")
    )
