"""Split files, review queue, retention and byte checks against plain models."""

import datetime as dt
import glob
import hashlib
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from postlens import fixed, schemas
from postlens.operators import review
from postlens.session import scratch_path, shared_dir
from postlens.sources import raw, retention, splits

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- split files --------------------------------------------------------------------------------


def test_split_files_follow_the_order_of_digests(spark, tmp_path):
    rows = [(i, f"text {i}\nline", i % 2, "s", "train" if i % 10 < 8 else "val" if i % 10 < 9 else "test") for i in range(3000)]
    df = spark.createDataFrame(rows, "msg_id long, text string, label int, source string, split string").repartition(7)
    path = splits.save_shuffled_splits(df, str(tmp_path), "spam_", rows_per_file=400)
    assert path.endswith("spam_splits")
    for split in ("train", "val", "test"):
        files = sorted(glob.glob(f"{path}/split={split}/*.json"))
        ids = [json.loads(line)["msg_id"] for f in files for line in open(f, encoding="utf-8")]
        want = sorted((r[0] for r in rows if r[4] == split), key=lambda i: hashlib.md5(f"42|order|{i}".encode()).hexdigest())
        assert ids == want
        got = splits.load_in_order(spark, path, split).orderBy("position").collect()
        assert [(r["position"], r["msg_id"]) for r in got] == list(enumerate(want, 1)) and got[0]["text"].endswith("\nline")
    assert len(glob.glob(f"{path}/split=train/*.json")) >= 5


def test_split_files_of_a_hot_id_and_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([(None, "t", 1, "s", "train")] * 50 + [(7, "t", 1, "s", "train")] * 50, "msg_id long, text string, label int, source string, split string")
    path = splits.save_shuffled_splits(df, str(tmp_path), "hot_", rows_per_file=10)
    assert splits.load_in_order(spark, path, "train").agg(F.count("*"), F.countDistinct("position"), F.max("position")).first() == (100, 100, 100)
    assert splits.in_file_order(df.limit(0), "msg_id").count() == 0


# ---- review queue -------------------------------------------------------------------------------


def test_review_queue(spark):
    rnd = random.Random(4)
    rows = [("hot" if rnd.random() < 0.8 else f"t{rnd.randint(1, 3)}", f"m{rnd.randint(0, 700)}") for _ in range(3000)]
    rows = [(t, m, rnd.choice(["spam", "spam", "ham"]), rnd.choice(["not spam", " Not Spam", "spam", None]), rnd.choice([None, 0.9, 0.95, round(rnd.random(), 1)])) for t, m in rows]
    df = spark.createDataFrame(rows, "tenant_id string, message_id string, label string, feedback string, confidence double").repartition(6)
    got = {}
    for r in review.review_queue(df, 20).orderBy("rank").collect():
        got.setdefault(r["tenant_id"], []).append((r["message_id"], r["confidence"], r["reports"]))
    found = {}
    for t, m, label, said, c in rows:
        if label == "spam" and (said or "").strip().lower() == "not spam":
            old = found.setdefault((t, m), [None, 0])
            old[0], old[1] = max((x for x in (old[0], c) if x is not None), default=None), old[1] + 1
    want = {}
    for (t, m), (c, n) in sorted(found.items(), key=lambda x: (x[1][0] is None, -(x[1][0] or 0), -x[1][1], x[0][1])):
        want.setdefault(t, []).append((m, c, n))
    assert got == {t: rows[:20] for t, rows in want.items()}
    parts = [review.review_queue(df.where(F.hash("message_id") % 2 == i), 20) for i in (-1, 0, 1)]
    merged = review.top_per_key(
        parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("rank"), ["tenant_id"],
        [F.col("confidence").desc_nulls_last(), F.col("reports").desc(), F.col("message_id")], 20,
    )
    assert {(r["tenant_id"], r["message_id"]) for r in merged.collect()} == {(t, m) for t, rows in got.items() for m, _, _ in rows}


def test_a_task_sends_few_rows_of_a_key(spark):
    df = spark.range(0, 10_000, 1, 4).select(F.pmod("id", F.lit(1)).alias("k"), F.col("id").alias("x"))
    plan = plan_of(review.top_per_key(df, ["k"], [F.col("x").desc()], 5))
    assert plan.count("WindowGroupLimit") >= 3 and plan.rindex("WindowGroupLimit") > plan.rindex("Exchange")


# ---- retention ----------------------------------------------------------------------------------

LOG = "id long, created_at timestamp, pad string"


def log(spark, days, per_day=20, start=0):
    rows = [(start + d * 1000 + i, T0 + dt.timedelta(days=d, hours=i), "p") for d in days for i in range(per_day)]
    return rows, spark.createDataFrame(rows, LOG)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_retention_drops_days_and_rewrites_one(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = spark.createDataFrame([], LOG).schema
    assert retention.read(spark, path, schema).count() == 0
    one, df = log(spark, range(5))
    two, more = log(spark, range(3, 8), start=500)
    assert retention.append(df, path) == 1 and retention.append(more, path) == 2
    rows = one + two + [(9999, None, "p")]
    retention.append(spark.createDataFrame(rows[-1:], LOG), path)
    before = retention.read(spark, path, schema)
    assert ids(before) == sorted(r[0] for r in rows)
    limit = T0 + dt.timedelta(days=3, hours=5)
    untouched = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/loads/*/_day=2024-01-0[5-8]/*")}
    assert retention.expire(spark, path, limit, schema) == {"dropped": 4, "rewritten": 2, "kept": 5}
    want = sorted(r[0] for r in rows if r[1] is not None and r[1] >= limit)
    assert ids(retention.read(spark, path, schema)) == want
    assert ids(before) == sorted(r[0] for r in rows)  # who has read the old manifest still has its files
    assert ids(retention.read(spark, path, schema, version=3)) == sorted(r[0] for r in rows)
    assert retention.vacuum(spark, path) == {"loads": 0, "days": 0, "manifests": 3}  # younger than the grace
    gone = retention.vacuum(spark, path, grace_seconds=-60)
    assert gone["days"] == 5 and gone["loads"] == 1
    assert ids(retention.read(spark, path, schema)) == want
    assert untouched and all(os.stat(f).st_mtime_ns == t for f, t in untouched.items())
    assert retention.expire(spark, path, limit, schema)["rewritten"] == 1 and ids(retention.read(spark, path, schema)) == want
    assert retention.expire(spark, path, T0 + dt.timedelta(days=99), schema)["kept"] == 0 and retention.read(spark, path, schema).count() == 0


def test_a_load_that_was_not_committed_is_not_read(spark, tmp_path):
    path = str(tmp_path / "log")
    rows, df = log(spark, range(2))
    retention.append(df, path)
    retention._write_load(df, path, "created_at")
    os.makedirs(f"{path}/manifests/v00000002")  # a job died while it wrote its manifest
    assert ids(retention.read(spark, path, df.schema)) == sorted(r[0] for r in rows)
    with pytest.raises(Exception):
        retention.append(df, path)
    retention.vacuum(spark, path, grace_seconds=-60)
    assert retention.append(df, path) == 2 and retention.read(spark, path, df.schema).count() == 2 * len(rows)


def test_old_intermediate_tables_go(spark):
    old, new = scratch_path(spark, "old"), scratch_path(spark, "new")
    for p in (old, new):
        spark.range(3).write.parquet(p)
    for name in os.listdir(f"{shared_dir(spark)}/postlens"):
        if name.startswith("old-"):
            os.utime(f"{shared_dir(spark)}/postlens/{name}", (time.time() - 10**6,) * 2)
    assert retention.clean_scratch(spark) >= 1 and not os.path.exists(old) and spark.read.parquet(new).count() == 3


# ---- bytes --------------------------------------------------------------------------------------


def first_bad(data):
    try:
        data.decode("utf-8")
    except UnicodeDecodeError as error:
        return error.start
    return None


def test_first_bad_byte(spark):
    rnd = random.Random(6)
    bits = [b"a", "é".encode(), "日".encode(), "\U0001f9ff".encode(), b"\xff", b"\xc3", b"\xe2\x82", b"\xef\xbf", b"\xef", b"\xed\xa0\x80", b"\xf0\x90\x80", b"\xc0\xaf", "�".encode()]
    rows = [b"".join(rnd.choice(bits[: 4 if i % 3 else None]) for _ in range(rnd.randint(0, 12))) for i in range(600)] + [b"x" * 100_000 + b"\xff" + b"y" * 10, b"", None]
    df = spark.createDataFrame([(bytearray(r) if r is not None else None,) for r in rows], "line binary")
    got = [(bytes(r["line"]) if r["line"] is not None else None, r["verdict"], r["bad_byte"]) for r in raw.encoding_verdicts(df).collect()]
    want = [(r, raw.BAD_ENCODING if r is not None and first_bad(r) is not None else None, None if r is None else first_bad(r)) for r in rows]
    assert got == want
    assert "Python" not in plan_of(raw.encoding_verdicts(df))


def test_json_lines_with_bad_bytes_are_listed(spark, tmp_path):
    good = json.dumps({"msg_id": 1, "text": "gut � é", "label": 1, "source": "s"}, ensure_ascii=False).encode()
    lines = [good, b'{"msg_id": 2, "text": "caf\xe9"}', b"", b"  ", b"{nope", b'{"msg_id": 3, "text": "cut \xe2\x82"}', b"\xff"]
    (tmp_path / "in.json").write_bytes(b"\n".join(lines) + b"\n")
    got = raw.read_jsonl_checked(spark, str(tmp_path / "in.json")).collect()
    assert sorted(((r["msg_id"], r["text"], r["verdict"], r["bad_byte"]) for r in got), key=repr) == sorted(
        [(1, "gut � é", None, None), (None, None, raw.BAD_ENCODING, 26), (None, None, "bad_json", None), (None, None, raw.BAD_ENCODING, 27), (None, None, raw.BAD_ENCODING, 0)],
        key=repr,
    )
    assert set(schemas.MESSAGE.names) <= set(got[0].asDict())


# ---- files and models that need care ------------------------------------------------------------


def test_csv_files_that_are_left_out_are_listed(spark, tmp_path, monkeypatch):
    from postlens.sources import files

    (tmp_path / "deep").mkdir()
    (tmp_path / "good one.csv").write_text("text,label\na text,1\n")
    (tmp_path / "deep" / "odd [1].csv").write_text("x,y\n1,2\n")
    (tmp_path / "broken.csv").write_text("text,label\na,1\n")
    real = files._headers  # what a reader that skips a corrupt file gets
    monkeypatch.setattr(files, "_headers", lambda *a: {h: [n for n in names if "broken" not in n] for h, names in real(*a).items()})
    got = {os.path.basename(r["file"]): (r["bytes"], r["reason"]) for r in files.skipped_csv(spark, str(tmp_path)).collect()}
    assert got == {"odd [1].csv": (8, "no text or label column"), "broken.csv": (15, "unreadable")}


def test_a_model_sees_the_first_4096_characters(spark):
    import pandas as pd
    from pyspark.sql.types import StructType

    from postlens.operators.scorers import run_external_model

    df = spark.createDataFrame([(1, "ß" * 5000), (2, "short"), (3, None)], "id long, text string")
    out = run_external_model(df, lambda b: pd.DataFrame({"seen": b["text"].str.len().fillna(-1).astype("int64")}), StructType.fromDDL("seen long"))
    assert {r["id"]: (r["seen"], len(r["text"] or "")) for r in out.collect()} == {1: (4096, 5000), 2: (5, 5), 3: (-1, 0)}
    whole = run_external_model(df, lambda b: pd.DataFrame({"seen": b["text"].str.len().fillna(-1).astype("int64")}), StructType.fromDDL("seen long"), max_chars=None)
    assert whole.where("id = 1").first()["seen"] == 5000


def test_prepared_requests_score_alike(spark, sf):
    """The tasks share one sanitising pass; prepared or not, envelopes are equal, and the query sanitises once."""
    from postlens.plans.score import prepare_requests, score_messages
    from postlens.queries import service_queries

    rows = [("1", "t", "Buy\x07 now", "free <script> " + "y" * 9000, None), ("2", None, None, "a\nb", " "), ("3", "u", "", "", "long thread\x01"), (None, "u", None, None, None)]
    df = spark.createDataFrame(rows, "request_id string, tenant_id string, subject string, body string, thread string")
    ready = prepare_requests(df).localCheckpoint().drop("subject", "body")
    for task in fixed.TASKS:
        a, b_ = (score_messages(x, task, prepared=p).drop("timestamp") for x, p in ((df, False), (ready, True)))
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b_.collect()))
    out = service_queries.task_envelopes(spark, sf)
    assert "regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()
