"""Source, corpus, validation and store queries."""

from pyspark.sql import functions as F

from .. import fixed
from ..functions.labels import guess_column, normalize_label
from ..operators import corpus, threads, validation as v
from ..session import scratch_path
from ..sources import adapters, files, store
from . import base as b
from .base import MSG, query, table
from .text_queries import _cleaned

_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"

_RAW_LABEL_SQL = f"lower(trim({b.sql_choose('doc_id', b.RAW_LABELS)}))"
_LABEL_SQL = f"""CASE WHEN {_RAW_LABEL_SQL} IN ('1', 'true', 'yes', 'spam', 'junk', 'phishing', 'malicious') THEN 1
  WHEN {_RAW_LABEL_SQL} IN ('0', 'false', 'no', 'ham', 'legitimate', 'safe', 'not spam') THEN 0
  WHEN {_RAW_LABEL_SQL} = 'nan' THEN 0 WHEN try_cast({_RAW_LABEL_SQL} AS DOUBLE) >= 0.5 THEN 1
  WHEN try_cast({_RAW_LABEL_SQL} AS DOUBLE) < 0.5 THEN 0 END"""

LAB = """lab AS (SELECT doc_id, text, toxic AS label, quality, source FROM documents JOIN labels USING (doc_id))"""


def _raw(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("message_body"), b.choose(F.col("doc_id"), b.RAW_LABELS).alias("is_spam")
    )


@query("normalize_label", f"SELECT doc_id, {_LABEL_SQL} AS label FROM documents")
def normalize_labels(spark, sf):
    return _raw(spark, sf).select("doc_id", normalize_label(F.col("is_spam")).alias("label"))


@query(
    "ingest_extra",
    f"""SELECT doc_id, {_TRIM.format('text')} AS text, {_LABEL_SQL} AS label, 'hf-extra/raw' AS source FROM documents
    WHERE {_LABEL_SQL} IS NOT NULL AND {_TRIM.format('text')} <> ''""",
)
def ingest_extra(spark, sf):
    return adapters.ingest_extra(_raw(spark, sf), "raw", keep=["doc_id"])


_GUESSED = (("documents", "text", None), ("benchmark", "text", None), ("conversations", "text", None),
            ("pages", None, None), ("embeddings", None, "label"), ("labels", None, None))


@query(
    "guess_schema",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {b.lit(x)}::VARCHAR AS text_column, {b.lit(y)}::VARCHAR AS label_column,"
        f" count(*) AS n_rows, count({x or 'NULL'}) AS n_texts FROM {t}"
        for t, x, y in _GUESSED
    ),
)
def guess_schema(spark, sf):
    """Guessed columns of each table and how many rows they fill."""
    parts = []
    for name, _, _ in _GUESSED:
        df = table(spark, sf, name)
        text_col = guess_column(df.columns, fixed.TEXT_COLUMN_CANDIDATES)
        label_col = guess_column(df.columns, fixed.LABEL_COLUMN_CANDIDATES)
        texts = F.count(text_col) if text_col else F.lit(0).cast("bigint")
        parts.append(
            df.agg(F.count("*").alias("n_rows"), texts.alias("n_texts")).select(
                F.lit(name).alias("table_name"),
                F.lit(text_col).cast("string").alias("text_column"),
                F.lit(label_col).cast("string").alias("label_column"),
                "n_rows",
                "n_texts",
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_ADAPTED_SQL = f"""{MSG}, {LAB}, adapted AS (
  SELECT 0 AS source_rank, doc_id, text, label, 'sms' AS source FROM lab
  UNION ALL SELECT 1, doc_id, {_TRIM.format("msg.subject || chr(10) || chr(10) || msg.body")}, label, 'mail/train'
    FROM msg JOIN lab USING (doc_id)
  UNION ALL SELECT 2, doc_id, text, quality, 'phishing' FROM lab)"""


def _adapted(spark, sf):
    lab = b.labelled_documents(spark, sf)
    mail = b.messages(spark, sf).withColumnRenamed("body", "message").join(lab.select("doc_id", "label"), "doc_id")
    combined = lab.select("doc_id", F.col("text").alias("text_combined"), F.col("quality").alias("label"))
    keep = ["doc_id"]
    return [
        adapters.adapt_text_label(lab, "sms", text_col="text", keep=keep),
        adapters.adapt_subject_message(mail, "mail", "train", keep=keep),
        adapters.adapt_phishing(combined, "phishing", keep=keep),
    ]


@query("adapt_sources", f"WITH {_ADAPTED_SQL} SELECT doc_id, text, label, source FROM adapted")
def adapt_sources(spark, sf):
    return adapters.union_corpora(_adapted(spark, sf)).drop("source_rank")


@query(
    "union_corpora",
    f"""WITH {_ADAPTED_SQL} SELECT source_rank, source, doc_id, label, length(text)::INT AS chars FROM adapted
    UNION ALL SELECT 3, 'benchmark', item_id, NULL, length(text)::INT FROM benchmark""",
)
def union_corpora(spark, sf):
    extra = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("doc_id"), "text", F.lit("benchmark").alias("source")
    )
    corpora = adapters.assemble({"spam": [*_adapted(spark, sf), extra]})
    return corpora["spam"].select("source_rank", "source", "doc_id", "label", F.length("text").alias("chars"))


PAIRS = """pairs AS (
  SELECT a.conv_id, a.turn, a.text, z.text AS summary, a.role AS topic FROM conversations a
  JOIN conversations z ON z.conv_id = a.conv_id AND z.turn = a.turn + 1)"""


def conversation_pairs(spark, sf):
    return threads.message_pairs(table(spark, sf, "conversations"), "chat/train")


@query("thread_pairs", f"WITH {PAIRS} SELECT conv_id, turn, text, summary, topic, 'chat/train' AS source FROM pairs")
def thread_pairs(spark, sf):
    pairs = conversation_pairs(spark, sf).withColumnRenamed("text", "dialogue")
    return adapters.adapt_dialogue(pairs, "chat", "train", keep=["conv_id", "turn"])


@query(
    "thread_summary",
    f"""WITH c AS (SELECT conv_id, turn, text FROM conversations
      UNION ALL SELECT conv_id + 1000000000000, turn, 'hi' || repeat(' ', 400) || text FROM conversations
      UNION ALL SELECT conv_id + 2000000000000, turn, 'hi' || repeat(chr(10), 150) || text FROM conversations
      UNION ALL SELECT conv_id + 3000000000000, turn, repeat(' ', 9) FROM conversations),
    l AS (SELECT conv_id, turn, {_TRIM.format("text")} AS x FROM c),
    j AS (SELECT conv_id, coalesce(trim(replace(string_agg(x, chr(10) ORDER BY turn) FILTER (x <> ''), chr(10), ' ')), '') AS s
      FROM l GROUP BY conv_id)
    SELECT conv_id, CASE WHEN strlen(s) <= 180 THEN s ELSE {b.sql_cut('s', 177)} || '...' END AS summary FROM j""",
)
def thread_summary(spark, sf):
    """Threads as they are, with long runs of blanks or line feeds in each turn, and with blank turns only."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    variants = [(0, F.col("text"))]
    variants += [(10**12, F.concat(F.lit("hi" + " " * 400), "text")), (2 * 10**12, F.concat(F.lit("hi" + "\n" * 150), "text"))]
    variants += [(3 * 10**12, F.lit(" " * 9))]
    each = F.explode(F.array(*[F.struct((F.col("conv_id") + n).alias("conv_id"), "turn", t.alias("text")) for n, t in variants]))
    return threads.thread_summaries(turns.select(each.alias("t")).select("t.*"))


# ---- files ------------------------------------------------------------------------------


@query(
    "jsonl_roundtrip",
    """SELECT doc_id AS msg_id, text, toxic AS label, source FROM documents LEFT JOIN labels USING (doc_id)""",
)
def jsonl_roundtrip(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    rows = table(spark, sf, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("msg_id"), "text", "label", "source"
    )
    path = scratch_path(spark, "jsonl")
    files.write_jsonl(rows, path)
    return files.read_jsonl(spark, path)


@query(
    "csv_corpus",
    f"""WITH {LAB}, r AS (SELECT {_TRIM.format('text')} AS text, label, 'csv/mail' AS source FROM lab
      UNION ALL SELECT {_TRIM.format('text')}, {_LABEL_SQL}, 'csv/mail' FROM documents)
    SELECT md5(text) AS text_md5, label, source, count(*) AS n FROM r
    WHERE text <> '' AND label IS NOT NULL GROUP BY ALL""",
)
def csv_corpus(spark, sf):
    """Two CSV layouts in one tree, and a third without a label column."""
    root = scratch_path(spark, "csv")

    def write(df, name):
        df.write.options(
            header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(f"{root}/{name}")

    write(b.labelled_documents(spark, sf).select("text", "label"), "plain")
    write(_raw(spark, sf).select("message_body", "is_spam"), "odd")
    write(table(spark, sf, "benchmark").select("item_id", "text"), "unlabelled")
    rows = files.read_csv_corpus(spark, root, "csv/mail")
    return rows.groupBy(F.md5("text").alias("text_md5"), "label", "source").agg(F.count("*").alias("n"))


# ---- preprocessing ------------------------------------------------------------------------

CLEAN = f"""{MSG}, cleaned AS (
  SELECT doc_id AS msg_id, {_cleaned("body")} AS text, tenant_id AS source FROM msg)"""


def _records(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("msg_id"), "text", "source")


@query("preprocess_corpus", f"WITH {CLEAN} SELECT msg_id, text, source FROM cleaned WHERE length(text) >= 10")
def preprocess_corpus(spark, sf):
    return corpus.preprocess_records(_records(spark, sf), deduplicate=False)


@query(
    "dedup_exact",
    f"""WITH {CLEAN} SELECT msg_id, text, source FROM (
      SELECT *, row_number() OVER (PARTITION BY text ORDER BY msg_id) AS rn FROM cleaned WHERE length(text) >= 10)
    WHERE rn = 1""",
)
def dedup_exact(spark, sf):
    return corpus.preprocess_records(_records(spark, sf))


@query(
    "preprocess_report",
    f"""WITH {CLEAN} SELECT count(*) AS total, count(DISTINCT text) FILTER (length(text) >= 10) AS kept,
      count(*) FILTER (length(text) < 10) AS dropped_short,
      count(*) FILTER (length(text) >= 10) - count(DISTINCT text) FILTER (length(text) >= 10) AS dropped_dup
    FROM cleaned""",
)
def preprocess_report(spark, sf):
    return corpus.preprocess_report(_records(spark, sf))


def _pair_clean(x, n):
    return _cleaned(x).replace("substr(lower(", "substr((").replace(", 1, 4096)", f", 1, {n})")


@query(
    "preprocess_pairs",
    f"""WITH {PAIRS}, c AS (
      SELECT conv_id * 100000 + turn AS pair_id, {_pair_clean('text', 2048)} AS text,
        {_pair_clean('summary', 512)} AS summary, topic FROM pairs),
    k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY pair_id) AS rn FROM c
      WHERE length(text) >= 50 AND length(summary) >= 10)
    SELECT pair_id, text, summary, topic FROM k WHERE rn = 1""",
)
def preprocess_pairs(spark, sf):
    rows = numbered_pairs(spark, sf)
    return corpus.preprocess_pairs(rows.select("pair_id", "text", "summary", "topic"))


def numbered_pairs(spark, sf):
    return conversation_pairs(spark, sf).withColumn("pair_id", F.col("conv_id") * 100000 + F.col("turn"))


# ---- validation -----------------------------------------------------------------------------
# Labels come from the label table (missing for many documents), some turned into 99.

VAL = """val AS (
  SELECT doc_id AS msg_id, CASE WHEN doc_id % 50 = 7 THEN NULL WHEN doc_id % 50 = 8 THEN ' hi ' ELSE text END AS text,
    CASE WHEN quality = 0 AND toxic = 1 THEN 99 ELSE toxic END AS label
  FROM documents LEFT JOIN labels USING (doc_id)),
ver AS (SELECT *, CASE WHEN text IS NULL THEN 'missing_text' WHEN label IS NULL THEN 'missing_label'
  WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 5 THEN 'too_short'
  WHEN label NOT IN (0, 1) THEN 'unexpected_label' ELSE 'valid' END AS verdict FROM val)"""


def _verdicts(spark, sf):
    labels = table(spark, sf, "labels")
    d = F.col("doc_id")
    text = F.when(d % 50 == 7, F.lit(None)).when(d % 50 == 8, F.lit(" hi ")).otherwise(F.col("text"))
    label = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), 99).otherwise(F.col("toxic"))
    rows = table(spark, sf, "documents").join(labels, "doc_id", "left").select(
        d.alias("msg_id"), text.alias("text"), label.alias("label")
    )
    return v.record_verdicts(rows, expected_labels=(0, 1))


@query("validate_rows", f"WITH {VAL} SELECT msg_id, verdict FROM ver")
def validate_rows(spark, sf):
    return _verdicts(spark, sf).select("msg_id", "verdict")


@query(
    "validate_report",
    f"""WITH {VAL}, l AS (SELECT label, count(*) AS n FROM ver WHERE verdict = 'valid' GROUP BY label),
    a AS (SELECT count(*) AS total, count(*) FILTER (verdict = 'valid') AS valid,
      count(*) FILTER (verdict IN ('missing_text', 'missing_label', 'unexpected_label')) AS errors,
      count(*) FILTER (verdict = 'too_short') AS warnings,
      count(DISTINCT text) FILTER (verdict = 'valid') AS texts FROM ver),
    m AS (SELECT count(*) AS n_labels, max(n) AS hi, min(n) AS lo FROM l),
    r AS (SELECT *, (valid - texts)::DOUBLE / total AS rate,
      CASE WHEN n_labels >= 2 THEN hi::DOUBLE / greatest(lo, 1) END AS ratio FROM a, m)
    SELECT total, valid, errors AS n_errors,
      warnings + coalesce(ratio > 20, false)::INT + (rate > 0.10)::INT AS n_warnings, n_labels,
      round(rate, 6) AS duplicate_rate, round(ratio, 6) AS imbalance_ratio,
      coalesce(ratio > 20, false) AS imbalance_warning, rate > 0.10 AS duplicate_warning, errors = 0 AS is_ok FROM r""",
)
def validate_report(spark, sf):
    row = v.validation_report(_verdicts(spark, sf))
    return row.withColumns(
        {"duplicate_rate": F.round("duplicate_rate", 6), "imbalance_ratio": F.round("imbalance_ratio", 6)}
    )


@query(
    "positional_split",
    f"""WITH {LAB}, r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id::VARCHAR), doc_id) AS k, count(*) OVER () AS n FROM lab)
    SELECT doc_id AS msg_id, CASE WHEN k <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS part FROM r""",
)
def positional_split(spark, sf):
    """Nine tenths by digest order, without strata, and the rest."""
    docs = b.labelled_documents(spark, sf).select(F.col("doc_id").alias("msg_id"))
    train, val = corpus.positional_split(docs)
    return train.select("msg_id", F.lit("train").alias("part")).unionByName(val.select("msg_id", F.lit("val").alias("part")))


@query(
    "label_distribution",
    f"WITH {VAL} SELECT label, count(*) AS n FROM ver WHERE verdict = 'valid' GROUP BY label",
)
def label_distribution(spark, sf):
    return v.label_distribution(_verdicts(spark, sf))


@query(
    "validation_issues",
    f"""WITH {VAL} (SELECT 'error' AS kind, msg_id AS record_id, verdict FROM ver
      WHERE verdict IN ('missing_text', 'missing_label', 'unexpected_label') ORDER BY msg_id LIMIT 5)
    UNION ALL (SELECT 'warning', msg_id, verdict FROM ver WHERE verdict = 'too_short' ORDER BY msg_id LIMIT 5)""",
)
def validation_issues(spark, sf):
    return v.first_issues(_verdicts(spark, sf))


@query(
    "validate_pairs",
    f"""WITH {PAIRS}, w AS (SELECT CASE WHEN text IS NULL THEN 'missing_text' WHEN summary IS NULL THEN 'missing_summary'
      WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 50 THEN 'dialogue_too_short'
      WHEN length(regexp_replace(summary, '^\\s+|\\s+$', '', 'g')) < 10 THEN 'summary_too_short' ELSE 'valid' END AS verdict
      FROM pairs)
    SELECT count(*) AS total, count(*) FILTER (verdict = 'valid') AS valid,
      count(*) FILTER (verdict IN ('missing_text', 'missing_summary')) AS n_errors,
      count(*) FILTER (verdict IN ('dialogue_too_short', 'summary_too_short')) AS n_warnings,
      count(*) FILTER (verdict IN ('missing_text', 'missing_summary')) = 0 AS is_ok FROM w""",
)
def validate_pairs(spark, sf):
    return v.pair_report(v.pair_verdicts(conversation_pairs(spark, sf)))


# ---- splits and the store -----------------------------------------------------------------------

SPLIT = """labelled AS (SELECT doc_id, coalesce(toxic, 0) AS label FROM documents LEFT JOIN labels USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || doc_id::VARCHAR), doc_id) AS rn,
    count(*) OVER (PARTITION BY label) AS n FROM labelled),
split AS (SELECT doc_id, label, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train'
    WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM ranked)"""


def _split(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    rows = table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left").fillna(0, ["label"])
    return corpus.stratified_split(rows, id_col="doc_id")


@query("stratified_split", f"WITH {SPLIT} SELECT doc_id, label, split FROM split")
def stratified_split(spark, sf):
    return _split(spark, sf)


@query("split_sizes", f"WITH {SPLIT} SELECT label, split, count(*) AS n FROM split GROUP BY ALL")
def split_sizes(spark, sf):
    return corpus.split_sizes(_split(spark, sf))


RECORDS = f"""{SPLIT}, rec AS (
  SELECT doc_id::VARCHAR AS id, source AS tenant_id,
    ['spam', 'phishing', 'summarization', 'priority'][(doc_id % 4)::INT + 1] AS domain, split, text, label, source, lang
  FROM documents JOIN split USING (doc_id))"""


def _store(spark, sf):
    """The documents as training records in a fresh store; returns its path."""
    docs = table(spark, sf, "documents")
    rows = docs.join(_split(spark, sf), "doc_id").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("tenant_id"),
        b.choose(F.col("doc_id"), fixed.DOMAINS).alias("domain"),
        "split",
        "text",
        F.col("label").cast("int").alias("label"),
        "source",
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
    )
    path = scratch_path(spark, "store")
    store.add_records(rows, path)
    return path


@query(
    "store_append",
    f"""WITH {RECORDS} SELECT domain, split, lang, count(*) AS n, count(*) AS n_stamped FROM rec GROUP BY ALL""",
)
def store_append(spark, sf):
    records = store.read_records(spark, _store(spark, sf))
    return records.groupBy("domain", "split", F.col("metadata")["lang"].alias("lang")).agg(
        F.count("*").alias("n"), F.count("created_at").alias("n_stamped")
    )


@query(
    "store_query",
    f"WITH {RECORDS} SELECT id, tenant_id, label, length(text)::INT AS chars FROM rec WHERE domain = 'spam' AND split = 'train'",
)
def store_query(spark, sf):
    found = store.query_records(store.read_records(spark, _store(spark, sf)), "spam", "train")
    return found.select("id", "tenant_id", "label", F.length("text").alias("chars"))


@query(
    "dataset_versions",
    f"""WITH {RECORDS} SELECT 'v1' AS version, domain, count(*) FILTER (split = 'train') AS train_count,
      count(*) FILTER (split = 'val') AS val_count, count(*) FILTER (split = 'test') AS test_count,
      'first' AS description FROM rec GROUP BY domain""",
)
def dataset_versions(spark, sf):
    path = scratch_path(spark, "versions")
    store.tag_version(store.read_records(spark, _store(spark, sf)), path, "v1", "first")
    return store.list_versions(spark, path).drop("created_at")
