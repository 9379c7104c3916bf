"""Request logs, streams, and the shape of plans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postlens import fixed
from postlens.operators import logs
from postlens.queries import QUERIES
from postlens.session import broadcast_if_small, scratch_path
from postlens.streaming import jobs

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def request_log(spark, n=3000, seed=0):
    """A hot tenant, bursts, and equal times."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        tenant = "hot" if rnd.random() < 0.6 else f"t{rnd.randint(1, 9)}"
        rows.append((i, tenant, T0 + dt.timedelta(seconds=rnd.randint(0, 600))))
    return rows, spark.createDataFrame(rows, "request_id long, tenant_id string, ts timestamp").repartition(6)


@pytest.mark.parametrize("limit", [1, 5, 120])
@pytest.mark.parametrize("broadcast", [True, False])
def test_rate_limit(spark, monkeypatch, limit, broadcast):
    if not broadcast:
        monkeypatch.setattr(logs, "broadcast_if_small", lambda d: d)
    rows, df = request_log(spark)
    got = {r["request_id"]: r["allowed"] for r in logs.rate_limit(df, max_requests=limit).collect()}
    seen, want = {}, {}
    for i, tenant, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        key = (tenant, ts.replace(second=0))
        seen[key] = seen.get(key, 0) + 1
        want[i] = seen[key] <= limit
    assert got == want


def test_rate_limit_keeps_requests_without_time(spark):
    df = spark.createDataFrame([(1, "t", None)], "request_id long, tenant_id string, ts timestamp")
    assert logs.rate_limit(df).count() == 1


def test_admission(spark):
    rows = [
        (1, None, "{}", True), (2, "  ", '{"tenant_id":"a"}', True), (3, "a", '{"tenant_id":"a"}', False), (4, "a", "{nope", True),
        (5, "a", '{"tenant_id":"  "}', True), (6, "a", '{"input":{}}', True), (7, "a", '{"tenant_id":"b"}', True), (8, " a ", '{"tenant_id":"a","input":{"x":1}}', True),
        (9, "a", '{"tenant_id":"a","pad":"' + "x" * 64 + '"}', True), (10, "a", None, True), (11, "a", "", True),
    ]
    df = spark.createDataFrame(rows, "id long, tenant_header string, body string, allowed boolean")
    out = logs.admit_requests(df, allowed_col="allowed", max_bytes=64)
    got = {r["id"]: r["reject_reason"] for r in out.collect()}
    assert got == {
        1: fixed.REASON_MISSING_TENANT, 2: fixed.REASON_MISSING_TENANT, 3: fixed.REASON_RATE_LIMITED, 4: fixed.REASON_BAD_JSON,
        5: fixed.REASON_MISSING_PAYLOAD_TENANT, 6: fixed.REASON_MISSING_PAYLOAD_TENANT, 7: fixed.REASON_TENANT_MISMATCH, 8: None,
        9: fixed.REASON_BAD_JSON, 10: fixed.REASON_BAD_JSON, 11: fixed.REASON_BAD_JSON,
    }
    assert logs.accepted(out).count() == 1 and logs.rejected(out).count() == 10
    counters = {r["counter"]: r["n"] for r in logs.request_counters(out).collect()}
    assert counters[fixed.COUNTER_TOTAL] == 11 and counters[fixed.REASON_BAD_JSON] == 4


def test_task_latency_floors_and_clamps(spark):
    df = spark.createDataFrame([("a", 1.9), ("a", 2.9), ("b", -5.0)], "task_type string, latency_ms double")
    got = {r[0]: (r[1], r[2]) for r in logs.task_latency(df).collect()}
    assert got == {"a": (2, 1), "b": (1, 0)}


def test_job_state(spark):
    t = [T0 + dt.timedelta(seconds=s) for s in range(4)]
    rows = [(1, 0, "queued", t[0], "a", None), (1, 1, "running", t[1], "a", None), (1, 2, "failed", t[1], "a", "boom"), (2, 0, "queued", t[2], "b", None)]
    df = spark.createDataFrame(rows, "job_id long, seq long, status string, ts timestamp, tenant_id string, error string").repartition(3)
    state = logs.job_state(df, carry=("tenant_id", "error"))
    got = {r["job_id"]: r for r in state.collect()}
    assert (got[1]["status"], got[1]["error"]) == ("failed", "boom") and got[1]["completed_at"] == got[1]["updated_at"]
    assert got[2]["status"] == "queued" and got[2]["completed_at"] is None
    assert logs.job_by_id(state, 1, "a").count() == 1
    assert logs.job_by_id(state, 1, "b").count() == 0


def test_broadcast_if_small(spark):
    df = spark.range(10)
    assert broadcast_if_small(df, max_rows=9) is df
    assert broadcast_if_small(df, max_bytes=8) is df
    assert sorted(r[0] for r in broadcast_if_small(df).collect()) == list(range(10))


# ---- streams ----------------------------------------------------------------------------------


def stream_of(spark, df, name, files=3):
    path = scratch_path(spark, name)
    df.coalesce(1).sortWithinPartitions("ts").repartitionByRange(files, "ts").write.parquet(path)
    return jobs.parquet_stream(spark, path, df.schema, max_files=1)


def test_stream_quota_equals_batch_on_closed_windows(spark):
    rows, df = request_log(spark, 800)
    out = jobs.run_to_table(jobs.stream_quota(stream_of(spark, df, "q", files=1), max_requests=3), "quota")
    got = {(r["tenant_id"], r["window_start"]): (r["n"], r["denied"]) for r in out.collect()}
    want = {}
    for _, tenant, ts in rows:
        key = (tenant, ts.replace(second=0, tzinfo=None))
        want[key] = want.get(key, 0) + 1
    end = max(r[2] for r in rows).replace(tzinfo=None) - dt.timedelta(minutes=1)
    closed = {k: (n, max(n - 3, 0)) for k, n in want.items() if k[1] + dt.timedelta(minutes=1) <= end}
    assert got == closed and closed


def test_stream_job_state_over_several_batches(spark):
    rows = [(i % 40, i // 40, ["queued", "running", "completed"][i // 40], T0 + dt.timedelta(seconds=i)) for i in range(120)]
    df = spark.createDataFrame(rows, "job_id long, seq long, status string, ts timestamp")
    path, mark = scratch_path(spark, "j"), scratch_path(spark, "j-mark")
    source = stream_of(spark, df, "jobs")
    latest = jobs.merge_job_state(source, path, checkpoint=mark)
    assert {(r["job_id"], r["status"]) for r in latest.collect()} == {(j, "completed") for j in range(40)}
    # Nothing new: running again changes nothing.
    assert jobs.merge_job_state(source, path, checkpoint=mark).count() == 40
    out = scratch_path(spark, "compact")
    jobs.compact_job_state(spark, path, out)
    assert spark.read.parquet(out).count() == 40
    assert jobs.merge_job_state(source, out, checkpoint=mark).count() == 40


def test_stream_feedback_drops_repeats(spark):
    rows = [("t", "m1", "spam", T0), ("t", "m1", "spam", T0), ("t", "m2", "spam", T0)]
    df = spark.createDataFrame(rows, "tenant_id string, message_id string, feedback string, ts timestamp")
    out = jobs.run_to_table(jobs.stream_feedback(stream_of(spark, df, "f", files=1), ts_col="ts"), "fb")
    assert out.count() == 2


# ---- plans --------------------------------------------------------------------------------------

NEEDS_PYTHON = {
    # entity decoding and NFKC, LCS, matrix products
    "html_unescape", "nfkc_normalize", "clean_text", "preprocess_corpus", "dedup_exact", "preprocess_report",
    "preprocess_pairs", "semantic_topk", "rouge_l", "rouge_summary",
}
EAGER = {"priority_model_eval", "text_model_gate"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plan(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in NEEDS_PYTHON:
        assert "EvalPython" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_cleaning_runs_once(spark, sf):
    plan = QUERIES["dedup_exact"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("regexp_replace(regexp_replace") == 1


def test_split_moves_no_texts(spark, sf):
    from postlens.operators.corpus import stratified_split

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = stratified_split(docs, id_col="doc_id", label_col="n_chars")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_scan_reads_only_needed_columns(spark, sf):
    plan = QUERIES["task_latency"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string,value:double>" in plan
