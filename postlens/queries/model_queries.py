"""Metrics, gates, ROUGE, search and model training queries."""

from pyspark.sql import functions as F

from .. import fixed
from ..operators import metrics as m, rouge as r, search
from ..functions import scoring
from ..plans import evaluate as ev, train
from ..session import scratch_path
from . import base as b
from .base import query, table
from .data_queries import LAB, PAIRS, numbered_pairs

# Scores mix the label with digits of the id's digest and are cut to two
# decimals, so that ties occur.
PRED = f"""{LAB},
pred AS (
  SELECT doc_id, model, task, y_true, y_score, (y_score >= 0.5)::INT AS y_pred FROM (
    SELECT doc_id, 'terms' AS model, 'spam-classification' AS task, label AS y_true,
      floor((('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::INT::DOUBLE / 65535 * 0.6::DOUBLE + label * 0.4::DOUBLE) * 100) / 100 AS y_score FROM lab
    UNION ALL SELECT doc_id, 'links', 'phishing-classification', quality,
      floor((('0x' || substr(md5(doc_id::VARCHAR), 5, 4))::INT::DOUBLE / 65535 * 0.5::DOUBLE + quality * 0.5::DOUBLE) * 100) / 100 FROM lab))"""


def predictions(spark, sf):
    rows = b.labelled_documents(spark, sf).select("doc_id", "label", "quality")
    digest = F.md5(F.col("doc_id").cast("string"))

    def part(start):
        return F.conv(F.substring(digest, start, 4), 16, 10).cast("double") / 65535

    def score(start, spread, truth, lift):
        return F.floor((part(start) * F.lit(spread) + F.col(truth) * F.lit(lift)) * 100) / 100

    models = F.array(
        F.struct(
            F.lit("terms").alias("model"),
            F.lit(fixed.TASK_SPAM).alias("task"),
            F.col("label").alias("y_true"),
            score(1, 0.6, "label", 0.4).alias("y_score"),
        ),
        F.struct(
            F.lit("links").alias("model"),
            F.lit(fixed.TASK_PHISHING).alias("task"),
            F.col("quality").alias("y_true"),
            score(5, 0.5, "quality", 0.5).alias("y_score"),
        ),
    )
    said = rows.select("doc_id", F.explode(models).alias("p")).select("doc_id", "p.*")
    return said.withColumn("y_pred", (F.col("y_score") >= 0.5).cast("int"))


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    "class_weights",
    f"""WITH {LAB} SELECT coalesce(sum(label), 0)::BIGINT AS n_pos, (count(*) - sum(label))::BIGINT AS n_neg,
      round((count(*) - sum(label))::DOUBLE / greatest(sum(label), 1), 6) AS pos_weight FROM lab""",
)
def class_weights(spark, sf):
    return rounded(m.class_weights(b.labelled_documents(spark, sf)), "pos_weight")


METRICS = f"""{PRED}, conf AS (
  SELECT model, task, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true <> 1 AND y_pred = 1) AS fp,
    count(*) FILTER (y_true = 1 AND y_pred <> 1) AS fn, count(*) FILTER (y_true <> 1 AND y_pred <> 1) AS tn,
    count(*) AS support FROM pred GROUP BY model, task),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p,
    CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r FROM conf),
met AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr)"""


@query(
    "classification_metrics",
    f"""WITH {METRICS} SELECT model, task, tp, fp, fn, tn, support, round(p, 6) AS precision, round(r, 6) AS recall,
      round(fp::DOUBLE / greatest(fp + tn, 1), 6) AS false_positive_rate,
      round(fn::DOUBLE / greatest(fn + tp, 1), 6) AS false_negative_rate, round(f1, 6) AS f1 FROM met""",
)
def classification_metrics(spark, sf):
    got = m.classification_metrics(predictions(spark, sf))
    return rounded(got, "precision", "recall", "f1", "false_positive_rate", "false_negative_rate")


@query(
    "roc_auc",
    f"""WITH {PRED}, rk AS (SELECT *, rank() OVER (PARTITION BY model, task ORDER BY y_score)
      + (count(*) OVER (PARTITION BY model, task, y_score) - 1) / 2.0::DOUBLE AS mid FROM pred)
    SELECT model, task, round((sum(mid) FILTER (y_true = 1) - count(*) FILTER (y_true = 1)
        * (count(*) FILTER (y_true = 1) + 1) / 2.0::DOUBLE)
      / (count(*) FILTER (y_true = 1)::DOUBLE * count(*) FILTER (y_true = 0)), 6) AS roc_auc
    FROM rk GROUP BY model, task""",
)
def roc_auc(spark, sf):
    return rounded(m.ranking_metrics(predictions(spark, sf)), "roc_auc").drop("average_precision")


@query(
    "average_precision",
    f"""WITH {PRED}, g AS (SELECT model, task, y_score, sum(y_true)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM pred GROUP BY ALL),
    c AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY model, task) AS np FROM g
      WINDOW w AS (PARTITION BY model, task ORDER BY y_score DESC))
    SELECT model, task, round(sum(pos / np * cp / cn), 6) AS average_precision FROM c GROUP BY model, task""",
)
def average_precision(spark, sf):
    return rounded(m.ranking_metrics(predictions(spark, sf)), "average_precision").drop("roc_auc")


@query(
    "per_class_report",
    f"""WITH {PRED}, cls AS (SELECT DISTINCT model, task, y_true AS c FROM pred UNION SELECT model, task, y_pred FROM pred),
    k AS (SELECT cls.model, cls.task, c, count(*) FILTER (y_true = c) AS sup, count(*) FILTER (y_pred = c) AS said,
        count(*) FILTER (y_true = c AND y_pred = c) AS hit
      FROM cls JOIN pred ON pred.model = cls.model AND pred.task = cls.task GROUP BY ALL),
    p AS (SELECT *, CASE WHEN said > 0 THEN hit::DOUBLE / said ELSE 0 END AS p,
        CASE WHEN sup > 0 THEN hit::DOUBLE / sup ELSE 0 END AS r FROM k),
    f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM p)
    SELECT model, task, c::VARCHAR AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, sup AS support FROM f
    UNION ALL SELECT model, task, 'accuracy', NULL, NULL, round(sum(hit) / sum(sup), 6), sum(sup)::BIGINT FROM f GROUP BY model, task
    UNION ALL SELECT model, task, 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(sup)::BIGINT FROM f GROUP BY model, task
    UNION ALL SELECT model, task, 'weighted avg', round(sum(p * sup) / sum(sup), 6), round(sum(r * sup) / sum(sup), 6),
      round(sum(f * sup) / sum(sup), 6), sum(sup)::BIGINT FROM f GROUP BY model, task""",
)
def per_class_report(spark, sf):
    return rounded(m.per_class_report(predictions(spark, sf)), "precision", "recall", "f1")


_LATENCY_SQL = """round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms,
  round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms,
  round(count(*) / greatest(sum(value) / 1000, 1e-9), 6) AS throughput_rps"""


@query(
    "latency_metrics",
    f"SELECT event_type AS task_type, {_LATENCY_SQL} FROM events GROUP BY event_type",
)
def latency_metrics(spark, sf):
    log = b.events_utc(spark, sf)
    got = m.latency_metrics(log, ["task_type"])
    return rounded(got, "mean_ms", "p50_ms", "p95_ms", "p99_ms", "throughput_rps")


@query(
    "promotion_gate",
    f"""WITH {METRICS}, gate AS (SELECT * FROM (VALUES ('spam-classification', 0.9::DOUBLE, 0.85::DOUBLE, 0.88::DOUBLE),
      ('phishing-classification', 0.92::DOUBLE, 0.88::DOUBLE, 0.9::DOUBLE)) g(task, mp, mr, mf)),
    o AS (SELECT *, p >= mp AND r >= mr AND f1 >= mf AS ok FROM met JOIN gate USING (task))
    SELECT model, task, ok AS promoted, CASE WHEN ok THEN '' ELSE printf('precision=%.4f (min ', p) || mp::VARCHAR
      || printf('), recall=%.4f (min ', r) || mr::VARCHAR || printf('), f1=%.4f (min ', f1) || mf::VARCHAR || ')' END AS failure_reason FROM o
    UNION ALL SELECT 'all models', NULL, bool_and(ok), '' FROM o""",
)
def promotion_gate(spark, sf):
    """The gate per model, and a last row that says whether all passed."""
    gated = m.promotion_gate(m.classification_metrics(predictions(spark, sf)), m.gate_table(spark))
    whole = m.all_promoted(gated).select(
        F.lit("all models").alias("model"),
        F.lit(None).cast("string").alias("task"),
        F.col("all_promoted").alias("promoted"),
        F.lit("").alias("failure_reason"),
    )
    return gated.select("model", "task", "promoted", "failure_reason").unionByName(whole)


@query(
    "evaluation_report",
    f"""WITH {METRICS}, g AS (SELECT model, task, y_score, sum(y_true)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM pred GROUP BY ALL),
    c AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY model, task) AS np,
        sum(n - pos) OVER (PARTITION BY model, task) AS nn FROM g
      WINDOW w AS (PARTITION BY model, task ORDER BY y_score DESC)),
    k AS (SELECT model, task, sum(pos / np * cp / cn) AS ap, sum((n - pos) * (cp - pos / 2)) / max(np * nn) AS auc FROM c GROUP BY ALL)
    SELECT model, task, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1,
      round(auc, 6) AS roc_auc, round(ap, 6) AS average_precision,
      p >= CASE WHEN task = 'spam-classification' THEN 0.9 ELSE 0.92 END
        AND r >= CASE WHEN task = 'spam-classification' THEN 0.85 ELSE 0.88 END
        AND f1 >= CASE WHEN task = 'spam-classification' THEN 0.88 ELSE 0.9 END AS promoted
    FROM met JOIN k USING (model, task)""",
)
def evaluation_report(spark, sf):
    """The whole harness: quality, ranking and gate per model."""
    got = ev.evaluate(predictions(spark, sf), m.gate_table(spark))
    short = got.select(
        "model", "task", "support", "precision", "recall", "f1", "roc_auc", "average_precision", "promoted"
    )
    return rounded(short, "precision", "recall", "f1", "roc_auc", "average_precision")


@query(
    "evaluation_report_file",
    f"""WITH {METRICS}, lat AS (SELECT CASE doc_id % 2 WHEN 0 THEN 'terms' ELSE 'links' END AS model, (doc_id % 97)::DOUBLE AS ms FROM documents)
    SELECT model, task, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round(l.mean_ms, 6) AS mean_ms, round(l.p95_ms, 6) AS p95_ms,
      p >= CASE WHEN task = 'spam-classification' THEN 0.9 ELSE 0.92 END AND r >= CASE WHEN task = 'spam-classification' THEN 0.85 ELSE 0.88 END
        AND f1 >= CASE WHEN task = 'spam-classification' THEN 0.88 ELSE 0.9 END AS promoted
    FROM met JOIN (SELECT model, avg(ms) AS mean_ms, quantile_cont(ms, 0.95) AS p95_ms FROM lat GROUP BY model) l USING (model)""",
)
def evaluation_report_file(spark, sf):
    """The report with latencies, written as JSON lines and read back."""
    said = predictions(spark, sf)
    model = F.when(F.col("doc_id") % 2 == 0, "terms").otherwise("links")
    timed = table(spark, sf, "documents").select(model.alias("model"), (F.col("doc_id") % 97).cast("double").alias("latency_ms"))
    tasks = F.when(F.col("model") == "terms", fixed.TASK_SPAM).otherwise(fixed.TASK_PHISHING)
    path = scratch_path(spark, "report")
    ev.evaluate(said, m.gate_table(spark), latencies=timed.withColumn("task", tasks), report_path=path)
    schema = "model string, task string, support long, precision double, recall double, f1 double, mean_ms double, p95_ms double, promoted boolean"
    return rounded(spark.read.schema(schema).json(path), "precision", "recall", "f1", "mean_ms", "p95_ms")


# ---- ROUGE -------------------------------------------------------------------------------


def _pairs(spark, sf):
    rows = numbered_pairs(spark, sf)
    return rows.select("pair_id", F.col("summary").alias("prediction"), F.col("text").alias("reference"))


def _rouge_sql():
    toks = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
    grams = {
        1: "w",
        2: "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])",
    }
    ctes = [f"""{PAIRS}, t AS (SELECT conv_id * 100000 + turn AS pair_id, 'a' AS side, {toks.format('summary')} AS w FROM pairs
      UNION ALL SELECT conv_id * 100000 + turn, 'b', {toks.format('text')} FROM pairs)"""]
    for n, expr in grams.items():
        ctes.append(f"""g{n} AS (SELECT pair_id, side, unnest({expr}) AS g FROM t),
        c{n} AS (SELECT pair_id, g, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM g{n} GROUP BY ALL),
        s{n} AS (SELECT pair_id, sum(least(a, b))::DOUBLE AS h, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM c{n} GROUP BY pair_id)""")
    f = "coalesce(CASE WHEN s{0}.h > 0 THEN 2 * (s{0}.h / s{0}.a) * (s{0}.h / s{0}.b) / (s{0}.h / s{0}.a + s{0}.h / s{0}.b) END, 0)"
    return f"""WITH {', '.join(ctes)} SELECT ids.pair_id, round({f.format(1)}, 6) AS rouge1, round({f.format(2)}, 6) AS rouge2
      FROM (SELECT DISTINCT pair_id FROM t) ids LEFT JOIN s1 USING (pair_id) LEFT JOIN s2 USING (pair_id)"""


# Without stems, which SQL does not have; the summary below uses them.
@query("rouge_n", _rouge_sql())
def rouge_n(spark, sf):
    pairs = _pairs(spark, sf)
    both = r.rouge_n(pairs, 1, stem=False).join(r.rouge_n(pairs, 2, stem=False), "pair_id")
    return rounded(both, "rouge1", "rouge2")


@query("rouge_l")
def rouge_l(spark, sf):
    return rounded(r.rouge_l(_pairs(spark, sf)), "rougeL")


@query("rouge_summary")
def rouge_summary(spark, sf):
    return ev.summarizer_report(r.rouge_summary(_pairs(spark, sf)), "next-turn")


# ---- search ------------------------------------------------------------------------------


def _cos_sql(a, z):
    return (
        f"(list_inner_product({a}::DOUBLE[], {z}::DOUBLE[]) / (sqrt(list_inner_product({a}::DOUBLE[], {a}::DOUBLE[]))"
        f" * sqrt(list_inner_product({z}::DOUBLE[], {z}::DOUBLE[]))))"
    )


@query(
    "semantic_topk",
    f"""WITH d AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    m AS (SELECT label, i, avg(x) AS x FROM d GROUP BY label, i),
    q AS (SELECT label::BIGINT AS query_id, list(x ORDER BY i) AS v FROM m GROUP BY label),
    s AS (SELECT query_id, vec_id, round({_cos_sql('v', 'embedding')}, 6) + 0::DOUBLE AS score FROM q, embeddings),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, score, rank::INT AS rank FROM k WHERE rank <= 5""",
)
def semantic_topk(spark, sf):
    """The five vectors nearest to the mean vector of each label."""
    vectors = table(spark, sf, "embeddings")
    return search.semantic_topk(vectors, search.label_centroids(vectors), 5)


@query(
    "pair_cosine",
    f"""SELECT l.vec_id AS left_id, r.vec_id AS right_id, round({_cos_sql('l.embedding', 'r.embedding')}, 4) + 0::DOUBLE AS cosine
    FROM embeddings l JOIN embeddings r ON r.vec_id = l.vec_id + 1""",
)
def pair_cosine(spark, sf):
    vectors = table(spark, sf, "embeddings")
    pairs = vectors.select(F.col("vec_id").alias("left_id"), (F.col("vec_id") + 1).alias("right_id"))
    return search.pair_cosine(pairs, vectors)


@query(
    "predict_from_probs",
    f"""WITH {PRED} SELECT doc_id, model, (y_score > 1 - y_score)::INT AS label, round(greatest(y_score, 1 - y_score), 6) AS confidence,
      round(y_score, 6) AS score FROM pred""",
)
def predict_from_probs(spark, sf):
    rows = predictions(spark, sf).withColumn("probs", F.array(1 - F.col("y_score"), F.col("y_score")))
    parts = scoring.predict_from_probabilities(F.col("probs"))
    got = rows.select("doc_id", "model", *[c.alias(n) for n, c in parts.items()])
    return rounded(got, "confidence", "score")


# ---- training -------------------------------------------------------------------------------


@query("priority_model_eval")
def priority_model_eval(spark, sf):
    """Train the priority model on nine tenths, report on the last tenth."""
    rows = b.messages(spark, sf).select("doc_id", F.concat_ws(" ", "subject", "body").alias("text"))
    _, guesses = train.train_priority_model(rows, id_col="doc_id")
    return rounded(m.per_class_report(guesses, []), "precision", "recall", "f1")


@query("text_model_gate")
def text_model_gate(spark, sf):
    """Train the weighted text model and gate it on its test split."""
    rows = b.labelled_documents(spark, sf).select("doc_id", "text", "label")
    _, guesses = train.train_text_model(rows, id_col="doc_id")
    return m.promotion_gate(m.classification_metrics(guesses), m.gate_table(spark))
