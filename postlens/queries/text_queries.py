"""Cleaning, masking, safety and scoring queries."""

from pyspark.sql import functions as F

from .. import fixed
from ..functions import safety, scoring, text as tx
from ..operators import corpus
from ..operators.policy import policy_table, resolve_policy
from ..operators.scorers import decide, route
from ..plans.score import classify, sanitize_requests, score_messages
from . import base as b
from .base import FLAGS_SQL, MSG, POLICY_ROWS, REQ, query, messages, table

_MAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
_URL = r"""(?i)https?://[^\s<>"'']+|www\.[^\s<>"'']+|ftp://[^\s<>"'']+"""
_PHONE = r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b"


def _masked(x):
    x = f"regexp_replace({x}, '{_MAIL}', '<EMAIL>', 'g')"
    x = f"regexp_replace({x}, '{_URL}', '<URL>', 'g')"
    return f"regexp_replace({x}, '{_PHONE}', '<PHONE>', 'g')"


def _unescaped(x):
    # The entities that occur in the tables, some cut off before their semicolon;
    # the ampersand last, so nothing is decoded twice.
    for entity, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{entity};?', '{char}', 'g')"
    return x


def _spaced(x):
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _cleaned(x):
    x = f"regexp_replace({_unescaped(x)}, '<[^>]+>', ' ', 'g')"
    x = f"regexp_replace({x}, '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F\\p{{Cf}}\\p{{Co}}]', '', 'g')"
    return f"substr(lower({_spaced(_masked(x))}), 1, 4096)"


@query("html_unescape", f"SELECT page_id, {_unescaped('html')} AS html FROM pages")
def html_unescape(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.unescape_html(F.col("html")).alias("html"))


@query("strip_html", "SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS html FROM pages")
def strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("html"))


# The tables hold no compatibility characters, so some are put in front.
@query("nfkc_normalize", "SELECT doc_id, 'FREE fine 1 km2 ' || text AS text FROM documents")
def nfkc_normalize(spark, sf):
    marked = F.concat(F.lit("ＦＲＥＥ ﬁne ① ㎢ "), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", tx.normalize_nfkc(marked).alias("text"))


@query(
    "strip_control",
    "SELECT doc_id, regexp_replace('a' || chr(7) || 'b' || chr(8203) || chr(173) || chr(13) || chr(10) || chr(9) || text,"
    " '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F\\p{Cf}\\p{Co}]', '', 'g') AS text FROM documents",
)
def strip_control(spark, sf):
    marked = F.concat(F.lit("a\x07b\u200b\u00ad\r\n\t"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", tx.strip_control(marked).alias("text"))


@query("mask_pii", f"WITH {MSG} SELECT doc_id, {_masked('subject')} AS subject, {_masked('body')} AS body FROM msg")
def mask_pii(spark, sf):
    return messages(spark, sf).select(
        "doc_id", tx.mask_pii(F.col("subject")).alias("subject"), tx.mask_pii(F.col("body")).alias("body")
    )


_LOOSE_SQL = "'  ' || subject || chr(9) || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || body || ' ' || chr(10)"


@query("normalize_ws", f"WITH {MSG} SELECT doc_id, {_spaced(_LOOSE_SQL)} AS text FROM msg")
def normalize_ws(spark, sf):
    loose = F.concat(F.lit("  "), F.col("subject"), F.lit("\t  \n\n\n\n"), F.col("body"), F.lit(" \n"))
    return messages(spark, sf).select("doc_id", tx.normalize_whitespace(loose).alias("text"))


@query(
    "clean_text",
    f"""WITH {MSG}, raw AS (
      SELECT 'message' AS kind, doc_id AS id, subject || chr(10) || body AS x FROM msg
      UNION ALL SELECT 'page', page_id, html FROM pages)
    SELECT kind, id, {_cleaned('x')} AS text FROM raw""",
)
def clean_text(spark, sf):
    mail = messages(spark, sf).select(
        F.lit("message").alias("kind"),
        F.col("doc_id").alias("id"),
        F.concat("subject", F.lit("\n"), "body").alias("x"),
    )
    pages = table(spark, sf, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("x")
    )
    return mail.unionByName(pages).select("kind", "id", tx.clean_text(F.col("x")).alias("text"))


@query(
    "truncate_fields",
    f"WITH {MSG} SELECT doc_id, subject, substr(body, 1, 8000) AS body, substr(body || body, 1, 8000) AS thread FROM msg",
)
def truncate_fields(spark, sf):
    both = messages(spark, sf).withColumn("thread", F.concat("body", "body"))
    return corpus.truncate_fields(both).select("doc_id", "subject", "body", "thread")


_KINDS = "doc_id % 5"


@query(
    "assemble_text",
    f"""WITH {MSG}, r AS (
      SELECT doc_id, CASE WHEN {_KINDS} IN (0, 1) THEN subject END AS subject,
        CASE WHEN {_KINDS} = 0 THEN body ELSE '' END AS body, CASE WHEN {_KINDS} = 1 THEN body END AS txt,
        CASE WHEN {_KINDS} = 2 THEN body ELSE '' END AS thread, CASE WHEN {_KINDS} = 3 THEN body END AS q FROM msg),
    a AS (SELECT *, regexp_replace(concat_ws(' ', nullif(subject, ''), nullif(body, ''), nullif(txt, '')),
        '^\\s+|\\s+$', '', 'g') AS joined FROM r)
    SELECT doc_id, coalesce(nullif(joined, ''), nullif(thread, ''), q, '') AS text,
      coalesce(nullif(joined, ''), nullif(thread, ''), q, '') = '' AS rejected FROM a""",
)
def assemble_text(spark, sf):
    kind = F.col("doc_id") % 5
    body = F.col("body")
    parts = messages(spark, sf).select(
        "doc_id",
        tx.assemble_text(
            F.when(kind.isin(0, 1), F.col("subject")),
            F.when(kind == 0, body).otherwise(""),
            F.when(kind == 1, body),
            F.when(kind == 2, body).otherwise(""),
            F.when(kind == 3, body),
        ).alias("text"),
    )
    return parts.withColumn("rejected", F.col("text") == "")


# ---- safety ---------------------------------------------------------------------------


@query(
    "safety_flags",
    f"WITH {REQ} SELECT doc_id, {FLAGS_SQL} AS flags, strlen(subject) AS subject_bytes,"
    " strlen(body) AS body_bytes FROM req",
)
def safety_flags(spark, sf):
    clean = safety.analyze_and_sanitize(messages(spark, sf), ["subject", "body"])
    return clean.select(
        "doc_id",
        F.array_join("safety_flags", ",").alias("flags"),
        F.octet_length("subject").cast("bigint").alias("subject_bytes"),
        F.octet_length("body").cast("bigint").alias("body_bytes"),
    )


@query(
    "safety_nested",
    f"""WITH {MSG}, n AS (
      SELECT doc_id, list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '[\\x00-\\x08\\x0B-\\x1F]', '', 'g')) AS lines,
        regexp_replace(chr(1) || subject, '[\\x00-\\x08\\x0B-\\x1F]', '', 'g') AS s FROM msg)
    SELECT doc_id, concat_ws(',', 'control-characters-sanitized',
        CASE WHEN len(list_filter(lines, lambda x: strlen(x) > 8000)) > 0 THEN 'input-truncated' END,
        CASE WHEN regexp_matches(s, '{b.INJECTION_SQL}')
          OR len(list_filter(lines, lambda x: regexp_matches(x, '{b.INJECTION_SQL}'))) > 0
          THEN 'prompt-injection-suspected' END) AS flags,
      s AS subject, list_sum(list_transform(lines, lambda x: least(strlen(x), 8000)))::BIGINT AS line_bytes FROM n""",
)
def safety_nested(spark, sf):
    nested = messages(spark, sf).select(
        "doc_id",
        F.struct(
            F.split("body", "\n").alias("lines"),
            F.create_map(F.lit("subject"), F.concat(F.lit("\x01"), F.col("subject"))).alias("head"),
        ).alias("input"),
    )
    clean = safety.analyze_and_sanitize(nested, ["input"])
    sizes = F.transform("input.lines", lambda x: F.least(F.octet_length(x), F.lit(8000)).cast("bigint"))
    return clean.select(
        "doc_id",
        F.array_join("safety_flags", ",").alias("flags"),
        F.col("input.head")["subject"].alias("subject"),
        F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("line_bytes"),
    )


@query(
    "safety_override",
    f"WITH {b.sql_routed('phishing')} SELECT doc_id, recommended_action, flags FROM routed",
)
def safety_override(spark, sf):
    done = classify(messages(spark, sf), fixed.TASK_PHISHING, overrides=policy_table(spark, POLICY_ROWS))
    return done.select("doc_id", "recommended_action", F.array_join("safety_flags", ",").alias("flags"))


# ---- scores ---------------------------------------------------------------------------


def _texts(spark, sf):
    return sanitize_requests(messages(spark, sf))


def _r6(c):
    return F.round(c, 6)


@query(
    "term_presence",
    f"""WITH {REQ} SELECT doc_id, round({b.sql_presence('t', fixed.PROMOTIONAL_TERMS)}, 6) AS promotional,
      round({b.sql_presence('t', fixed.PRIORITY_TERMS)}, 6) AS priority, 0::DOUBLE AS no_terms FROM txt""",
)
def term_presence(spark, sf):
    t = F.col("request_text")
    return _texts(spark, sf).select(
        "doc_id",
        _r6(scoring.term_presence(t, fixed.PROMOTIONAL_TERMS)).alias("promotional"),
        _r6(scoring.term_presence(t, fixed.PRIORITY_TERMS)).alias("priority"),
        scoring.term_presence(t, ()).alias("no_terms"),
    )


@query("spam_score", f"WITH {REQ} SELECT doc_id, round({b.SPAM_SQL}, 6) AS score FROM txt")
def spam_score(spark, sf):
    return _texts(spark, sf).select("doc_id", _r6(scoring.spam_score(F.col("request_text"))).alias("score"))


@query("phishing_score", f"WITH {REQ} SELECT doc_id, round({b.PHISH_SQL}, 6) AS score FROM txt")
def phishing_score(spark, sf):
    return _texts(spark, sf).select("doc_id", _r6(scoring.phishing_score(F.col("request_text"))).alias("score"))


@query(
    "fallback_score",
    f"""WITH {REQ} SELECT doc_id, round({b.sql_presence('t', b.SPAM_FB)}, 6) AS spam,
      round({b.sql_presence('t', b.PHISH_FB)}, 6) AS phishing FROM txt""",
)
def fallback_score(spark, sf):
    t = F.col("request_text")
    return _texts(spark, sf).select(
        "doc_id",
        _r6(scoring.term_presence(t, fixed.FALLBACK_SPAM_TERMS)).alias("spam"),
        _r6(scoring.term_presence(t, fixed.FALLBACK_PHISHING_TERMS)).alias("phishing"),
    )


@query(
    "feature_contributions",
    f"""WITH {REQ} SELECT doc_id,
      round({b.sql_presence('t', ('free', 'buy now', 'discount', 'offer'))}, 6) AS promotional_terms,
      round({b.sql_presence('t', ('urgent', 'act now', 'limited time'))}, 6) AS urgency_language,
      round({b.sql_presence('t', ('verify account', 'password', 'login', 'credential'))}, 6) AS credential_request,
      round({b.sql_presence('t', ('ceo', 'finance team', 'security department'))}, 6) AS impersonation_risk FROM txt""",
)
def feature_contributions(spark, sf):
    t = F.col("request_text")
    parts = {**scoring.spam_contributions(t), **scoring.phishing_contributions(t)}
    return _texts(spark, sf).select("doc_id", *[_r6(c).alias(n) for n, c in parts.items()])


@query(
    "calibrated_confidence",
    f"""WITH {REQ}, s AS (SELECT doc_id, {b.SPAM_SQL} AS a, {b.PHISH_SQL} AS p FROM txt)
    SELECT doc_id, round({b.sql_calibrate('a')}, 6) AS spam, round({b.sql_calibrate('p')}, 6) AS phishing FROM s""",
)
def calibrated_confidence(spark, sf):
    t = F.col("request_text")
    scores = _texts(spark, sf).select("doc_id", scoring.spam_score(t).alias("a"), scoring.phishing_score(t).alias("p"))
    return scores.select(
        "doc_id",
        _r6(scoring.calibrate(F.col("a"))).alias("spam"),
        _r6(scoring.calibrate(F.col("p"))).alias("phishing"),
    )


@query(
    "priority_heuristic",
    f"""WITH {REQ} SELECT doc_id, round(least(1.0::DOUBLE, 0.35::DOUBLE
      + {b.sql_presence('t', ('urgent', 'deadline', 'today'))} * 0.5::DOUBLE), 6) AS score FROM txt""",
)
def priority_heuristic(spark, sf):
    return _texts(spark, sf).select("doc_id", _r6(scoring.priority_heuristic(F.col("request_text"))).alias("score"))


def _word_sql(words):
    return f"list_has_any(w, [{', '.join(b.lit(x) for x in words)}])::INT::DOUBLE"


FEATURES_SQL = f"""{MSG}, x AS (SELECT doc_id, subject || ' ' || body AS x FROM msg),
w AS (SELECT doc_id, x, lower(x) AS l, regexp_split_to_array(lower(x), '\\s+') AS w FROM x),
feat AS (
  SELECT doc_id, {_word_sql(('urgent', 'asap', 'immediately', 'deadline', 'today', 'emergency'))} AS urgency,
    {_word_sql(('meeting', 'call', 'schedule', 'calendar', 'invite', 'standup', 'sync'))} AS meeting,
    contains(x, '?')::INT::DOUBLE AS question,
    regexp_matches(l, 'please|could you|can you|follow up|kindly|need you')::INT::DOUBLE AS action,
    {_word_sql(('attached', 'attachment', 'see file', 'enclosed', 'document', 'spreadsheet'))} AS attachment,
    (CASE WHEN length(x) < 100 THEN 0 WHEN length(x) < 500 THEN 1 ELSE 2 END)::DOUBLE AS length_bucket FROM w)"""


def _feature_rows(spark, sf):
    joined = messages(spark, sf).select("doc_id", F.concat_ws(" ", "subject", "body").alias("text"))
    return joined.select("doc_id", *[c.alias(n) for n, c in scoring.priority_features(F.col("text")).items()])


@query("priority_features", f"WITH {FEATURES_SQL} SELECT * FROM feat")
def priority_features(spark, sf):
    return _feature_rows(spark, sf)


@query(
    "priority_label",
    f"""WITH {FEATURES_SQL}, s AS (
      SELECT doc_id, 2 * urgency + meeting + question + 0.5 * action + 0.5 * attachment AS s FROM feat),
    c AS (SELECT doc_id, CASE WHEN s >= 2 THEN 2 WHEN s >= 0.5 THEN 1 ELSE 0 END AS c FROM s)
    SELECT doc_id, c AS class, ['low', 'medium', 'high'][c + 1] AS label, [0.2, 0.5, 0.9][c + 1]::DOUBLE AS score FROM c""",
)
def priority_label(spark, sf):
    signals = [F.col(n) for n in scoring.FEATURES[:5]]
    cls = _feature_rows(spark, sf).select("doc_id", scoring.priority_class(*signals).alias("class"))
    return cls.withColumns(
        {"label": scoring.priority_label(F.col("class")), "score": scoring.priority_value(F.col("class"))}
    )


@query(
    "template_reply",
    f"""WITH {MSG}, r AS (
      SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE trim(subject) END AS intent,
        CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE body END AS txt,
        ['Friendly', 'formal', 'neutral', NULL][(doc_id % 4)::INT + 1] AS tone FROM msg)
    SELECT doc_id, 'Hi,' || chr(10) || chr(10) || 'Thanks for reaching out. I have reviewed your note about '
        || CASE WHEN trim(intent) = '' THEN 'follow up' ELSE intent END
        || ' and will follow up with the next steps shortly.' || chr(10) || chr(10) || 'Best regards,' AS draft,
      CASE WHEN lower(tone) = 'friendly' THEN 'Thanks so much for your message — I really appreciate it.'
        WHEN lower(tone) = 'formal' THEN 'Thank you for your message. I appreciate your correspondence.'
        WHEN trim(txt) = '' THEN 'Thank you for your message.' ELSE txt END AS rewrite FROM r""",
)
def template_reply(spark, sf):
    d = F.col("doc_id")
    return messages(spark, sf).select(
        "doc_id",
        scoring.draft_reply(F.when(d % 3 == 0, F.lit("  ")).otherwise(F.col("subject"))).alias("draft"),
        scoring.rewrite_reply(
            F.when(d % 5 == 0, F.lit(" ")).otherwise(F.col("body")),
            b.choose(d, ("Friendly", "formal", "neutral", None)),
        ).alias("rewrite"),
    )


_JSON_SQL = "to_json({'body': body, 'subject': subject})"


@query(
    "usage_cost",
    f"""WITH {REQ}, j AS (SELECT doc_id, {_JSON_SQL}::VARCHAR AS j FROM req)
    SELECT doc_id, ((strlen(j) + 5 * (length(j) - length(translate(j, '<>&', '')))) // 4)::INT AS input_tokens,
      128 AS output_tokens, 0.0005::DOUBLE AS cost_usd FROM j""",
)
def usage_cost(spark, sf):
    spent = _texts(spark, sf).select(
        "doc_id", scoring.usage({"subject": F.col("subject"), "body": F.col("body")}).alias("u")
    )
    return spent.select(
        "doc_id",
        F.col("u.estimated_input_tokens").alias("input_tokens"),
        F.col("u.estimated_output_tokens").alias("output_tokens"),
        F.col("u.estimated_cost_usd").alias("cost_usd"),
    )


@query(
    "tenant_policy",
    f"""WITH {MSG}, {b.POLICY_SQL} SELECT doc_id, tenant_id, {b._POLICY_COLUMNS}
    FROM msg LEFT JOIN pol USING (tenant_id)""",
)
def tenant_policy(spark, sf):
    rows = messages(spark, sf).select("doc_id", "tenant_id")
    return resolve_policy(rows, policy_table(spark, POLICY_ROWS))


@query(
    "policy_decision",
    f"""WITH {REQ}, {b.POLICY_SQL}, s AS (
      SELECT doc_id, {b.SPAM_SQL} AS a, {b.PHISH_SQL} AS p, {b._POLICY_COLUMNS} FROM txt LEFT JOIN pol USING (tenant_id))
    SELECT doc_id, 'spam' AS task, CASE WHEN a >= spam_threshold THEN 'spam' ELSE 'ham' END AS label,
      CASE WHEN a >= spam_threshold THEN 'quarantine' ELSE 'allow' END AS recommended_action FROM s
    UNION ALL SELECT doc_id, 'phishing', CASE WHEN p >= phishing_threshold THEN 'phishing' ELSE 'legitimate' END,
      CASE WHEN p >= phishing_threshold THEN 'block' ELSE 'allow' END FROM s""",
)
def policy_decision(spark, sf):
    rows = resolve_policy(_texts(spark, sf), policy_table(spark, POLICY_ROWS))
    t = F.col("request_text")

    def task(name, score):
        done = decide(rows.withColumn("score", score), name)
        short = "spam" if name == fixed.TASK_SPAM else "phishing"
        return done.select("doc_id", F.lit(short).alias("task"), "label", "recommended_action")

    return task(fixed.TASK_SPAM, scoring.spam_score(t)).unionByName(
        task(fixed.TASK_PHISHING, scoring.phishing_score(t))
    )


@query(
    "route_with_fallback",
    f"""WITH {b.sql_routed('spam')} SELECT doc_id, model_name, round(score, 6) AS score,
      round(confidence, 6) AS confidence, label, base_action AS recommended_action, NOT fb AS has_contributions,
      CASE WHEN fb THEN 'fallback conservative spam scorer'
        ELSE 'content pattern analysis|sender/wording heuristic embedding' END AS explanations FROM routed""",
)
def route_with_fallback(spark, sf):
    done = route(_texts(spark, sf), fixed.TASK_SPAM, overrides=policy_table(spark, POLICY_ROWS))
    return done.select(
        "doc_id",
        "model_name",
        _r6(F.col("score")).alias("score"),
        _r6(F.col("confidence")).alias("confidence"),
        "label",
        "recommended_action",
        F.col("feature_contributions").isNotNull().alias("has_contributions"),
        F.array_join("explanations", "|").alias("explanations"),
    )


RESPONSE_SQL = f"""WITH {b.sql_routed('spam')}, j AS (SELECT *, {_JSON_SQL}::VARCHAR AS j FROM routed)
SELECT doc_id, tenant_id, model_name, '1.0.0' AS model_version, 'spam-classification' AS task_type,
  round(confidence, 6) AS confidence, 'isotonic-baseline-v1' AS confidence_calibration,
  round(score, 6) AS spam_score, label, recommended_action, flags AS safety_flags,
  CASE WHEN NOT fb THEN round({b.sql_presence('t', ('free', 'buy now', 'discount', 'offer'))}, 6) END AS promotional_terms,
  false AS cache_hit,
  ((strlen(j) + 5 * (length(j) - length(translate(j, '<>&', '')))) // 4)::INT AS input_tokens FROM j"""


def flat_response(envelope):
    return envelope.select(
        F.col("request_id").cast("bigint").alias("doc_id"),
        "tenant_id",
        "model_name",
        "model_version",
        "task_type",
        _r6(F.col("confidence")).alias("confidence"),
        "confidence_calibration",
        _r6(F.col("result.spam_score")).alias("spam_score"),
        F.col("result.label").alias("label"),
        F.col("result.recommended_action").alias("recommended_action"),
        F.array_join("safety_flags", ",").alias("safety_flags"),
        _r6(F.col("feature_contributions")["promotional_terms"]).alias("promotional_terms"),
        "cache_hit",
        F.col("usage.estimated_input_tokens").alias("input_tokens"),
    )


@query("inference_response", RESPONSE_SQL)
def inference_response(spark, sf):
    requests = b.message_requests(spark, sf)
    return flat_response(score_messages(requests, fixed.TASK_SPAM, overrides=policy_table(spark, POLICY_ROWS)))


@query(
    "tenant_label_counts",
    f"""WITH {b.sql_routed('spam')} SELECT tenant_id, label, recommended_action, count(*) AS n,
      round(avg(score), 6) AS mean_score FROM routed GROUP BY ALL""",
)
def tenant_label_counts(spark, sf):
    """Flagship: sanitise, route, decide and override every message, then count per tenant."""
    done = classify(messages(spark, sf), fixed.TASK_SPAM, overrides=policy_table(spark, POLICY_ROWS))
    return done.groupBy("tenant_id", "label", "recommended_action").agg(
        F.count("*").alias("n"), _r6(F.avg("score")).alias("mean_score")
    )
