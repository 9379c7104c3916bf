"""Preprocessing, splitting, validation, sources and the store."""

import random

import pytest
from pyspark.sql import functions as F

from postlens import fixed, schemas
from postlens.operators import corpus, threads, validation as v
from postlens.plans.prepare import prepare_classification, prepare_pairs
from postlens.session import scratch_path
from postlens.sources import adapters, files, store


def records(spark, texts, labels=None):
    labels = labels if labels is not None else [0] * len(texts)
    rows = [(i, t, l, "test") for i, (t, l) in enumerate(zip(texts, labels))]
    return spark.createDataFrame(rows, schemas.MESSAGE)


# ---- preprocessing ---------------------------------------------------------------------


def test_preprocess_counts(spark):
    def kept(texts, **options):
        return corpus.preprocess_records(records(spark, texts), **options).count()

    lunch, train = "Lunch moved to one o'clock.", "The train to Basel is late"
    assert kept([lunch, train, lunch.upper(), f" {train}\t"]) == 2
    assert kept([lunch] * 7 + [train] * 4) == 2
    assert kept(["ok", "", train, "no."]) == 1
    assert kept([train] * 6, deduplicate=False) == 6


def test_first_copy_wins_and_keeps_its_fields(spark):
    df = records(spark, ["Same  text here", "other text here", "same text HERE", None], [1, 0, 0, 1]).orderBy(F.col("msg_id").desc())
    rows = sorted(tuple(r) for r in corpus.preprocess_records(df).collect())
    assert rows == [(0, "same text here", 1, "test"), (1, "other text here", 0, "test")]
    report = corpus.preprocess_report(df).first()
    assert report.asDict() == {"total": 4, "kept": 2, "dropped_short": 1, "dropped_dup": 1}


def test_report_of_nothing(spark):
    row = corpus.preprocess_report(records(spark, [])).first()
    assert row.asDict() == {"total": 0, "kept": 0, "dropped_short": 0, "dropped_dup": 0}


def test_pairs(spark):
    long, short = "A long dialogue " * 5, "Summary text"
    rows = [(0, long, short), (1, long, "another summary"), (2, "short", short), (3, long + "b", "tiny")]
    df = spark.createDataFrame(rows, "pair_id long, text string, summary string")
    got = corpus.preprocess_pairs(df).collect()
    assert [(r["pair_id"], r["text"]) for r in got] == [(0, long.strip())]


# ---- split -------------------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [(100, 200), (1, 0), (3, 9), (57, 1001)])
@pytest.mark.parametrize("digits", [1, 3])
def test_split_sizes_are_exact(spark, sizes, digits):
    labels = [0] * sizes[0] + [1] * sizes[1]
    df = records(spark, [f"m{i}" for i in range(len(labels))], labels)
    got = corpus.stratified_split(df, prefix_digits=digits)
    assert got.select("msg_id").distinct().count() == got.count() == len(labels)
    counts = {(r["label"], r["split"]): r["n"] for r in corpus.split_sizes(got).collect()}
    for label, n in enumerate(sizes):
        want = {"train": int(n * 0.8), "val": int(n * 0.1)}
        want["test"] = n - sum(want.values())
        assert {s: counts.get((label, s), 0) for s in fixed.SPLITS} == want


def test_split_is_reproducible_and_seeded(spark):
    df = records(spark, [f"m{i}" for i in range(300)], [i % 2 for i in range(300)])

    def ids(seed, frame):
        return sorted(r[0] for r in corpus.stratified_split(frame, seed=seed).where("split = 'train'").select("msg_id").collect())

    assert ids(42, df) == ids(42, df.repartition(7)) != ids(7, df)


def test_split_ratios_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        corpus.stratified_split(records(spark, ["x", "y"]), ratios=(0.5, 0.25, 0.5))


def test_split_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(corpus, "broadcast_if_small", lambda d: d)
    df = records(spark, [f"m{i}" for i in range(50)], [i % 3 for i in range(50)])
    small = sorted(tuple(r) for r in corpus.stratified_split(df).collect())
    monkeypatch.undo()
    assert small == sorted(tuple(r) for r in corpus.stratified_split(df).collect())


def test_positional_split(spark):
    train, val = corpus.positional_split(records(spark, [f"m{i}" for i in range(19)]))
    assert (train.count(), val.count()) == (17, 2)


def test_positional_split_of_few_rows(spark):
    for ids in ([], ["m1"], ["m1", "m2", None], [None, None]):
        train, val = corpus.positional_split(records(spark, ids))
        assert "NestedLoop" not in train._jdf.queryExecution().executedPlan().toString()
        assert train.count() + val.count() == len(ids) and train.count() <= 0.9 * len(ids)


# ---- validation ------------------------------------------------------------------------------


def report(spark, rows, **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "msg_id long, text string, label int")
    return v.validation_report(v.record_verdicts(df, **options)).first()


def test_validation_report(spark):
    invoices = [(f"Invoice {1000 + i} is due at the end of the month", i % 3 % 2) for i in range(63)]
    clean = report(spark, invoices)
    assert (clean["is_ok"], clean["valid"], clean["duplicate_rate"]) == (True, 63, 0.0)
    failing = {
        "nothing": [],
        "no text": [*invoices, (None, 1)],
        "no label": [*invoices, ("The label of this one is missing", None)],
    }
    assert {name: report(spark, rows)["is_ok"] for name, rows in failing.items()} == dict.fromkeys(failing, False)
    assert report(spark, failing["nothing"])["n_errors"] == 1
    brief = report(spark, [("no", 1), ("yes", 0)])
    assert (brief["is_ok"], brief["n_warnings"], brief["valid"]) == (True, 2, 0)
    assert not report(spark, [("A label nobody knows", -4)], expected_labels=(0, 1))["is_ok"]
    copies = report(spark, [("Parking garage closed on Sunday", 1)] * 25)
    assert copies["duplicate_warning"] and copies["duplicate_rate"] == pytest.approx(24 / 25)


def test_copies_across_labels_and_imbalance(spark):
    rows = [("same text again", 0)] + [("same text again", 1)] + [(f"different text {i}", 0) for i in range(40)]
    row = report(spark, rows)
    assert row["duplicate_rate"] == pytest.approx(1 / 42)
    assert row["imbalance_ratio"] == 41.0 and row["imbalance_warning"]


def test_texts_that_are_not_strings(spark):
    df = spark.createDataFrame([(1, 5, 0)], "msg_id long, text int, label int")
    assert v.record_verdicts(df).first()["verdict"] == "text_not_string"


def test_first_issues(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else None, 0) for i in range(30)], "msg_id long, text string, label int")
    rows = v.first_issues(v.record_verdicts(df)).collect()
    assert sorted((r["kind"], r["record_id"]) for r in rows) == [("error", i) for i in (0, 2, 4, 6, 8)] + [("warning", i) for i in (1, 3, 5, 7, 9)]


def test_pair_validation(spark):
    rows = [("x" * 60, "a good summary"), ("x" * 60, None), ("short", "a good summary"), ("x" * 60, "s")]
    df = spark.createDataFrame(rows, "text string, summary string")
    row = v.pair_report(v.pair_verdicts(df)).first()
    assert row.asDict() == {"total": 4, "valid": 1, "n_errors": 1, "n_warnings": 2, "is_ok": False}


# ---- threads ---------------------------------------------------------------------------------


def test_long_thread_summary(spark):
    rnd = random.Random(1)
    turns = []
    for thread, n in enumerate([1, 3, 500, 2000]):
        for turn in range(n):
            text = rnd.choice(["", "  ", "ok", "é" * rnd.randint(1, 300), " padded \n line "])
            turns.append((thread, turn, text))
    turns.append((9, 0, "hi" + " " * 400))
    df = spark.createDataFrame(turns, "conv_id long, turn long, text string").repartition(5)
    got = {r["conv_id"]: r["summary"] for r in threads.thread_summaries(df).collect()}
    for thread in {t for t, _, _ in turns}:
        said = [x.strip() for t, _, x in turns if t == thread and x.strip()]
        line = "\n".join(said).replace("\n", " ").strip()
        raw = line.encode()
        want = line if len(raw) <= 180 else raw[:177].decode("utf-8", "replace") + "..."
        assert got.get(thread, "") == want


# ---- sources -----------------------------------------------------------------------------------


def test_jsonl_blank_and_bad_lines(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"msg_id": 1, "text": "é\\n", "label": 1, "source": "s"}\n\n   \n{"msg_id": 2, "text": "b"}\n')
    rows = sorted(tuple(r) for r in files.read_jsonl(spark, str(tmp_path / "ok.jsonl")).collect())
    assert rows == [(1, "é\n", 1, "s"), (2, "b", None, None)]
    (tmp_path / "bad.jsonl").write_text('{"msg_id": 1}\nnot json\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_saved_splits_load_again(spark, tmp_path):
    df = records(spark, [f"tëxt {i}" for i in range(20)], [None] * 20).withColumn("split", F.when(F.col("msg_id") < 15, "train").otherwise("val"))
    path = files.save_splits(df, str(tmp_path), "spam_")
    assert files.load_split(spark, str(tmp_path), "val", "spam_").count() == 5
    assert files.load_split(spark, str(tmp_path), prefix="spam_").count() == 20
    line = spark.read.text(path).first()[0]
    assert "tëxt" in line and '"label":null' in line


def test_csv_corpus(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_text('text,label\n"two\nlines, ""quoted""",spam\n  ,ham\nkept,0.2\n')
    (tmp_path / "deep" / "b.csv").write_text("id,Message_Body,is_spam\n1,from b,yes\n2,unknown,maybe\n")
    (tmp_path / "odd name [1] 5%.csv").write_text("text,label\nodd name,1\n")
    (tmp_path / "deep" / "c.csv").write_text("x,y\n1,2\n")
    (tmp_path / "deep" / "d.txt").write_text("text,label\nno,spam\n")
    rows = sorted(tuple(r) for r in files.read_csv_corpus(spark, str(tmp_path), "csv/x").collect())
    assert rows == [("from b", 1, "csv/x"), ("kept", 0, "csv/x"), ("odd name", 1, "csv/x"), ('two\nlines, "quoted"', 1, "csv/x")]


def test_adapters(spark):
    df = spark.createDataFrame([(" s ", None, "1")], "subject string, message string, label string")
    assert tuple(adapters.adapt_subject_message(df, "mail", "test").first()) == ("s", 1, "mail/test")
    first_last = spark.createDataFrame([(7, "x", 1)], "body int, other string, cls int")
    assert tuple(adapters.adapt_phishing(first_last, "p").first()) == ("7", 1, "p")
    dialogue = spark.createDataFrame([("d", "s")], "dialogue string, summary string")
    assert tuple(adapters.adapt_dialogue(dialogue, "d", "train").first()) == ("d", "s", "", "d/train")
    assert adapters.ingest_extra(dialogue, "x") is None


def test_store(spark):
    path, versions = scratch_path(spark, "t-store"), scratch_path(spark, "t-versions")
    rows = [("1", "spam", "train", "a"), ("2", "spam", "val", "b"), ("3", "phishing", "train", "c")]
    df = spark.createDataFrame(rows, "id string, domain string, split string, text string")
    store.add_records(df, path)
    store.add_records(df.limit(1), path, rebalance=True)
    all_records = store.read_records(spark, path)
    assert store.query_records(all_records).count() == 4
    assert store.query_records(all_records, "spam", "train").count() == 2
    assert store.query_records(all_records, split="train").count() == 3
    assert all_records.where("created_at is null").count() == 0
    plan = store.query_records(all_records, "spam", "train")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(domain" in plan
    store.tag_version(all_records, versions, "v1")
    store.tag_version(all_records, versions, "v2", "again")
    got = {(r["version"], r["domain"]): (r["train_count"], r["val_count"], r["test_count"]) for r in store.list_versions(spark, versions).collect()}
    assert got[("v1", "spam")] == got[("v2", "spam")] == (2, 1, 0) and len(got) == 4


# ---- whole job -------------------------------------------------------------------------------------


def test_prepare(spark, tmp_path):
    texts = [f"Message number {i % 90} says hello" for i in range(100)] + ["no"]
    done = prepare_classification(records(spark, texts, [i % 2 for i in range(101)]), out_dir=str(tmp_path), prefix="spam_")
    assert done.records.count() == 90 and done.report.first()["valid"] == 90
    parts = {s: files.load_split(spark, str(tmp_path), s, "spam_") for s in fixed.SPLITS}
    assert {s: p.count() for s, p in parts.items()} == {"train": 72, "val": 8, "test": 10}
    ids = [r[0] for p in parts.values() for r in p.select("msg_id").collect()]
    assert len(set(ids)) == 90
    pairs = spark.createDataFrame([(i, f"A dialogue of some length, number {i}, goes on and on", "a summary of it") for i in range(10)], "pair_id long, text string, summary string")
    assert prepare_pairs(pairs).report.first()["valid"] == 10
