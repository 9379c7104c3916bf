"""Metrics, percentiles, ROUGE and search against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens import fixed
from postlens.functions.stem import stem_word
from postlens.operators import metrics as m, ranks, rouge as r, search
from postlens.plans import evaluate as ev, train


def predictions(spark, truth, guess, score=None):
    rows = [("m", fixed.TASK_SPAM, t, g, s) for t, g, s in zip(truth, guess, score or [0.0] * len(truth))]
    return spark.createDataFrame(rows, "model string, task string, y_true int, y_pred int, y_score double")


def one(spark, truth, guess):
    return m.classification_metrics(predictions(spark, truth, guess)).first()


def test_metric_identities(spark):
    perfect = one(spark, [0, 0, 1, 1, 1], [0, 0, 1, 1, 1])
    assert (perfect["precision"], perfect["recall"], perfect["f1"]) == (1.0, 1.0, 1.0)
    assert (perfect["false_positive_rate"], perfect["false_negative_rate"], perfect["support"]) == (0.0, 0.0, 5)
    assert one(spark, [0, 0, 0], [1, 1, 1])["false_positive_rate"] == 1.0
    missed = one(spark, [1, 1, 1], [0, 0, 0])
    assert missed["false_negative_rate"] == 1.0 and missed["precision"] == missed["f1"] == 0.0


def brute_auc(truth, score):
    pos = [s for t, s in zip(truth, score) if t]
    neg = [s for t, s in zip(truth, score) if not t]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(truth, score):
    total, out, seen_recall = sum(truth), 0.0, 0.0
    for cut in sorted(set(score), reverse=True):
        chosen = [t for t, s in zip(truth, score) if s >= cut]
        recall = sum(chosen) / total
        out += (recall - seen_recall) * sum(chosen) / len(chosen)
        seen_recall = recall
    return out


@pytest.mark.parametrize("decimals", [1, 2, 9])
def test_ranking_metrics(spark, decimals):
    rnd = random.Random(decimals)
    truth = [int(rnd.random() < 0.3) for _ in range(400)]
    score = [round(min(1.0, max(0.0, rnd.gauss(0.4 + 0.2 * t, 0.2))), decimals) for t in truth]
    row = m.ranking_metrics(predictions(spark, truth, truth, score)).first()
    assert row["roc_auc"] == pytest.approx(brute_auc(truth, score), abs=1e-12)
    assert row["average_precision"] == pytest.approx(brute_ap(truth, score), abs=1e-12)


def test_ranking_of_one_class_is_zero(spark):
    row = m.ranking_metrics(predictions(spark, [1, 1], [1, 1], [0.1, 0.9])).first()
    assert (row["roc_auc"], row["average_precision"]) == (0.0, 0.0)


@pytest.mark.parametrize("buckets", [2, 7, 256])
def test_running_totals(spark, buckets):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.choice([0.5, rnd.random()]), rnd.randint(0, 5)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    got = {(x["k"], x["v"]): (x["cum_n"], x["total_n"]) for x in ranks.running_totals(df, ["k"], "v", ["n"], buckets=buckets).collect()}
    for k, v in {(k, v) for k, v, _ in rows}:
        below = sum(n for a, b, n in rows if a == k and b <= v)
        assert got[(k, v)] == (below, sum(n for a, _, n in rows if a == k))


def test_latency(spark):
    rnd = np.random.default_rng(0)
    values = np.concatenate([rnd.gamma(2, 20, 3000), np.full(3000, 42.0)])
    df = spark.createDataFrame([(float(x),) for x in values], "latency_ms double")
    row = m.latency_metrics(df).first()
    for name, q in (("p50_ms", 50), ("p95_ms", 95), ("p99_ms", 99)):
        assert row[name] == pytest.approx(np.percentile(values, q))
    assert row["mean_ms"] == pytest.approx(values.mean())
    assert row["throughput_rps"] == pytest.approx(len(values) / (values.sum() / 1000))
    near = m.latency_metrics(df, approximate=True).first()
    assert near["p95_ms"] == pytest.approx(np.percentile(values, 95), rel=0.01)


def test_latency_of_one_and_of_none(spark):
    df = spark.createDataFrame([(100.0,)], "latency_ms double")
    assert m.latency_metrics(df).first()["p99_ms"] == 100.0
    assert tuple(m.latency_metrics(df.limit(0)).first()) == (0.0,) * 5


def test_per_class_report(spark):
    truth, guess = [0, 0, 1, 1, 2, 2, 2], [0, 1, 1, 1, 2, 0, 3]
    rows = {x["class"]: x for x in m.per_class_report(predictions(spark, truth, guess), ["model"]).collect()}
    assert rows["1"]["precision"] == pytest.approx(2 / 3) and rows["1"]["recall"] == 1.0
    assert rows["3"]["support"] == 0 and rows["3"]["f1"] == 0.0
    assert rows["accuracy"]["f1"] == pytest.approx(4 / 7)
    assert rows["macro avg"]["recall"] == pytest.approx((0.5 + 1 + 1 / 3 + 0) / 4)
    assert rows["weighted avg"]["recall"] == pytest.approx(4 / 7)


@pytest.mark.parametrize("p, rec, f1, ok", [(0.99, 0.97, 0.98, True), (0.71, 0.97, 0.9, False), (0.99, 0.63, 0.89, False), (0.97, 0.96, 0.42, False), (0.9, 0.85, 0.88, True)])
def test_gate(spark, p, rec, f1, ok):
    df = spark.createDataFrame([("m", fixed.TASK_SPAM, p, rec, f1)], "model string, task string, precision double, recall double, f1 double")
    row = m.promotion_gate(df, m.gate_table(spark)).first()
    assert row["promoted"] is ok and (row["failure_reason"] == "") is ok
    if not ok:
        assert row["failure_reason"] == f"precision={p:.4f} (min 0.9), recall={rec:.4f} (min 0.85), f1={f1:.4f} (min 0.88)"


def test_all_promoted_of_nothing(spark):
    df = spark.createDataFrame([], "promoted boolean")
    assert tuple(m.all_promoted(df).first()) == (0, True)


def test_harness_writes_a_report(spark, tmp_path):
    df = predictions(spark, [0, 1, 1, 0], [0, 1, 1, 0], [0.1, 0.8, 0.9, 0.2])
    lat = spark.createDataFrame([("m", fixed.TASK_SPAM, 10.0), ("m", fixed.TASK_SPAM, 20.0)], "model string, task string, latency_ms double")
    row = ev.evaluate(df, m.gate_table(spark), latencies=lat, report_path=str(tmp_path / "r")).first()
    assert row["promoted"] and row["roc_auc"] == 1.0 and row["p50_ms"] == 15.0
    assert spark.read.json(str(tmp_path / "r")).first()["model"] == "m"


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    assert tuple(m.class_weights(df).first()) == (1, 3, 3.0)
    assert m.class_weights(df.where("label = 0")).first()["pos_weight"] == 3.0


# ---- ROUGE -----------------------------------------------------------------------------------


def rouge_model(said, real, n):
    import re

    a, b = (re.sub("[^a-z0-9]+", " ", t.lower()).split() for t in (said, real))
    if n == "L":
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        hits, na, nb = table[-1, -1], len(a), len(b)
    else:
        ga, gb = (Counter(zip(*[w[i:] for i in range(n)])) for w in (a, b))
        hits, na, nb = sum((ga & gb).values()), sum(ga.values()), sum(gb.values())
    return 0.0 if not hits else 2 * (hits / na) * (hits / nb) / (hits / na + hits / nb)


def test_rouge(spark):
    rnd = random.Random(2)
    words = "the cat, sat on a Mat-9 dog é ran".split()
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) for _ in range(80)]
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(texts, reversed(texts)))] + [(99, "the cat sat", "the cat sat"), (100, "", "")]
    df = spark.createDataFrame(rows, "pair_id long, prediction string, reference string")
    for n, frame in ((1, r.rouge_n(df, 1, stem=False)), (2, r.rouge_n(df, 2, stem=False)), ("L", r.rouge_l(df, stem=False))):
        got = {x["pair_id"]: x[f"rouge{n}"] for x in frame.collect()}
        assert got == {i: pytest.approx(rouge_model(a, b, n)) for i, a, b in rows}
    whole = r.rouge_summary(df.where("pair_id = 99")).first()
    assert tuple(whole) == (100.0, 100.0, 100.0, 1)
    assert tuple(r.rouge_summary(df.limit(0)).first()) == (0.0, 0.0, 0.0, 0)


# Examples of the published algorithm.
STEMS = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre plastered plaster bled bled
motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss
fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form
formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow
inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ
angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll dying die enjoy enjoy died die flies fli geologi geolog""".split()


def test_stems():
    got = {w: stem_word(w) for w in STEMS[::2]}
    assert got == dict(zip(STEMS[::2], STEMS[1::2]))


def test_stemmed_rouge(spark):
    df = spark.createDataFrame([(1, "running dogs jumped", "run dog jump")], "pair_id long, prediction string, reference string")
    assert tuple(r.rouge_summary(df).first()) == (100.0, 100.0, 100.0, 1)
    assert r.rouge_n(df, 1, stem=False).first()["rouge1"] == 0.0


def test_rouge_needs_no_shuffle_of_ngrams(spark):
    df = spark.createDataFrame([(1, "a b", "a c")], "pair_id long, prediction string, reference string")
    plan = r.rouge_n(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


# ---- search -------------------------------------------------------------------------------------


@pytest.mark.parametrize("max_queries", [1000, 7])
def test_topk_equals_brute_force(spark, max_queries):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(120, 8)).round(1)
    vectors = np.concatenate([base, base[:40]])  # exact copies tie
    queries = rnd.normal(size=(20, 8))
    v = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(queries)], "query_id long, query_vec array<double>")
    got = search.semantic_topk(v, q, 4, max_queries=max_queries, slice_rows=50).collect()
    stored = vectors.astype(np.float32).astype(float)
    cos = np.round((queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ (stored / np.linalg.norm(stored, axis=1, keepdims=True)).T, 6)
    want = {(i, k + 1, j) for i in range(20) for k, j in enumerate(sorted(range(160), key=lambda j: (-cos[i, j], j))[:4])}
    assert {(x["query_id"], x["rank"], x["vec_id"]) for x in got} == want


def test_topk_edge_cases(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vec array<double>")
    assert [(x["vec_id"], x["score"]) for x in search.semantic_topk(v, q, 5).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0)]
    assert search.semantic_topk(v, q.limit(0), 5).count() == 0


# ---- training --------------------------------------------------------------------------------------


def test_priority_model_learns_the_rule(spark):
    base = ["urgent deadline today please respond", "can you join the meeting?", "see the attached document", "just saying hello", "lunch was nice"]
    df = spark.createDataFrame([(i, base[i % 5]) for i in range(200)], "msg_id long, text string")
    model, guesses = train.train_priority_model(df)
    assert guesses.count() == 20
    assert guesses.where("y_true <> y_pred").count() == 0
    assert model.transform(train.priority_training_rows(df)).where("prediction <> priority").count() == 0


def test_text_model_gate(spark, tmp_path):
    rows = [(i, ("buy cheap pills now" if i % 3 == 0 else "see you at lunch tomorrow") + f" {i % 7}", int(i % 3 == 0)) for i in range(150)]
    df = spark.createDataFrame(rows, "msg_id long, text string, label int")
    cfg = train.TextModelConfig(features=256, max_iter=10)
    model, guesses = train.train_text_model(df, cfg)
    path = str(tmp_path / "model")
    assert train.promote_text_model(model, guesses, m.gate_table(spark), path).first()["promoted"]
    assert train.PipelineModel.load(path).transform(df).count() == 150
    bad = guesses.withColumn("y_pred", F.lit(0))
    with pytest.raises(train.GateNotPassed):
        train.promote_text_model(model, bad, m.gate_table(spark), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def _plain_rouge(rows, n):
    """Bags of n-grams per id, in plain Python."""
    bags = {}
    for i, said, real in rows:
        for side, text in enumerate((said, real)):
            words = re.findall("[a-z0-9]+", (text or "").lower())
            bags.setdefault(i, (Counter(), Counter()))[side].update(zip(*(words[k:] for k in range(n))))
    out = {}
    for i, (a, b) in bags.items():
        h = sum((a & b).values())
        p, r = h / max(1, sum(a.values())), h / max(1, sum(b.values()))
        out[i] = 2 * p * r / (p + r) if h else 0.0
    return out


@pytest.mark.parametrize("repeats", [False, True])
def test_rouge_keeps_no_table_of_ngrams(spark, repeats):
    rng = random.Random(5)
    text = lambda: rng.choice([None, "", " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 30)))])
    rows = [(i, text(), text()) for i in range(60)] + [(None, "a b a", "a a b")]
    rows += [(i % 3 or None, text(), text()) for i in range(40)] if repeats else []
    df = spark.createDataFrame(rows, "pair_id long, prediction string, reference string")
    for n in (1, 2):
        got = r.rouge_n(df, n, stem=False)
        assert {x["pair_id"]: x[f"rouge{n}"] for x in got.collect()} == pytest.approx(_plain_rouge(rows, n))
        assert got.count() == len({x[0] for x in rows})
        # counted in the order of ids: no grouping, whose memory would grow with the input
        assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
