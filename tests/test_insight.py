"""Job states, re-anchored quota, acceptance, anomalies, trends, sketches, registry and bulk sending against plain models."""

import collections
import datetime as dt
import math
import random

import pytest
from pyspark.sql import Row, functions as F

from postlens.operators import anchors, answers, bulk, logs, metrics, registry, sketches, trends
from postlens.session import scratch_path
from postlens.streaming import job_states, jobs

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(**delta):
    return T0 + dt.timedelta(**delta)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- job states ---------------------------------------------------------------------------------

EVENT = "job_id long, seq long, status string, ts timestamp, tenant_id string"


def write_batches(spark, name, batches, schema=EVENT):
    """A folder of one file per batch, read one file at a time in this order."""
    path = scratch_path(spark, name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def stream_from(spark, path, schema=EVENT):
    return jobs.parquet_stream(spark, path, spark.createDataFrame([], schema).schema, max_files=1)


def test_job_changes_equal_the_batch_states_of_shuffled_and_repeated_events(spark):
    rnd = random.Random(1)
    events = []
    for j in range(25):
        start = at(minutes=rnd.randint(0, 30))
        steps = ["queued", "running", "running", rnd.choice(["completed", "failed", "running"])][: rnd.randint(1, 4)]
        events += [(j, q, s, start + dt.timedelta(minutes=rnd.randint(0, 3)), f"t{j % 3}") for q, s in enumerate(steps)]
    twice = events + rnd.sample(events, 30)
    rnd.shuffle(twice)
    path = write_batches(spark, "job-events", [twice[i::4] for i in range(4)])
    changes, checkpoint = job_states.write_job_changes(job_states.job_changes(stream_from(spark, path), carry=("tenant_id",), delay="2 hours"))
    got = job_states.current_states(changes)
    want = logs.job_state(spark.createDataFrame(events, EVENT), carry=("tenant_id",)).select(*got.columns)
    assert sorted(got.collect()) == sorted(want.collect())
    told = changes.groupBy("job_id").agg(F.sort_array(F.collect_list("change")).alias("c")).collect()
    assert all(r["c"] == list(range(1, len(r["c"]) + 1)) for r in told) and changes.count() <= len(events)
    assert job_states.kept_states(spark, checkpoint).count() == 25


def test_job_state_is_dropped_after_the_end_and_does_not_come_back(spark):
    ended = [(1, 0, "queued", at(), "a"), (1, 1, "completed", at(minutes=1), "a")]
    idle = [(2, 0, "running", at(minutes=2), "a")]
    later = [(3, 0, "queued", at(hours=5), "a"), (4, 0, "running", at(hours=30), "a")]
    repeat = [(1, 1, "completed", at(minutes=1), "a"), (1, 2, "running", at(minutes=2), "a"), (4, 0, "failed", at(hours=30), "b")]
    path = write_batches(spark, "job-ends", [ended + idle])
    checkpoint, out = scratch_path(spark, "ends-checkpoint"), scratch_path(spark, "ends")

    def run(rows=None):
        if rows:
            spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)
        stream = job_states.job_changes(stream_from(spark, path), delay="10 minutes", keep_seconds=3600, idle_seconds=86400)
        changes, _ = job_states.write_job_changes(stream, out, checkpoint)
        return changes, {r["job"] for r in job_states.kept_states(spark, checkpoint).collect()}

    _, kept = run()
    assert kept == {1, 2}
    _, kept = run(later[:1])  # an hour after its end the first job's state goes
    assert kept == {2, 3}
    _, kept = run(later[1:])  # a day after its last event that of one that never ended
    assert 2 not in kept and 4 in kept
    changes, kept = run(repeat)  # late and repeated events change nothing
    assert 1 not in kept
    assert sorted((r["job_id"], r["status"], r["change"]) for r in changes.collect()) == [
        (1, "completed", 2), (1, "queued", 1), (2, "running", 1), (3, "queued", 1), (4, "running", 1),
    ]


def test_job_state_with_a_time_to_live(spark):
    path = write_batches(spark, "job-ttl", [[(1, 0, "queued", at(), "a"), (None, 0, "queued", at(), "a"), (1, 1, "failed", at(minutes=1), "a")]])
    changes = job_states.job_changes(stream_from(spark, path), ttl_seconds=3600)
    out, checkpoint = scratch_path(spark, "ttl"), scratch_path(spark, "ttl-checkpoint")
    with job_states.rocksdb_state(spark):
        query = changes.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(once=True).start(out)
        assert query.awaitTermination(120)
    rows = spark.read.schema(changes.schema).parquet(out).collect()
    assert sorted((r["status"], r["change"]) for r in rows) == [("failed", 2), ("queued", 1)]


# ---- re-anchored quota --------------------------------------------------------------------------


def plain_quota(rows, limit, seconds, anchor=None):
    allowed, counts, start = {}, collections.Counter(), anchor
    for i, tenant, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        if anchor is not None and ts < anchor:
            allowed[i] = True
            continue
        if start is None or (ts - start).total_seconds() >= seconds:
            start, counts = ts, collections.Counter()
        allowed[i] = counts[tenant] < limit
        counts[tenant] += allowed[i]
    return allowed


LOG = "request_id long, tenant_id string, ts timestamp"


@pytest.mark.parametrize("seconds, anchor", [(60, None), (7, None), (60, at(seconds=95))])
def test_quota_windows_start_anew_at_a_request(spark, seconds, anchor):
    rnd = random.Random(seconds)
    rows, clock = [], 0.0
    for i in range(1500):  # dense minutes, pauses, equal times, a hot tenant
        clock += rnd.choice([0, 0, 0.05, 0.3, 1, 1, 3]) if rnd.random() < 0.99 else rnd.choice([59.999999, 60, 61, 4000, 100_000])
        rows.append((i, "hot" if rnd.random() < 0.6 else f"t{rnd.randint(1, 5)}", at(seconds=clock)))
    df = spark.createDataFrame(rows, LOG).repartition(5)
    got = logs.rate_limit(df, max_requests=3, window_seconds=seconds, anchored=True, anchor=None if anchor is None else F.lit(anchor))
    assert {r["request_id"]: r["allowed"] for r in got.collect()} == plain_quota(rows, 3, seconds, anchor)


def test_quota_without_times_or_requests(spark):
    df = spark.createDataFrame([(1, "t", None), (2, "t", None)], LOG)
    assert [r["allowed"] for r in logs.rate_limit(df, max_requests=1, anchored=True).collect()] == [True, True]
    assert logs.rate_limit(df.limit(0), anchored=True).count() == 0


def test_next_times(spark):
    rnd = random.Random(3)
    times = sorted({rnd.choice([1, 1000, 10**6, 10**9, 10**11]) * rnd.randint(0, 50) for _ in range(300)})
    asked = [rnd.randint(0, times[-1] + 5) for _ in range(200)] + times[:50]
    got = anchors.next_times(spark.createDataFrame([(t,) for t in times], "t long"), spark.createDataFrame([(x,) for x in asked], "x long"))
    want = {x: min((t for t in times if t >= x), default=None) for x in asked}
    assert {r["x"]: r["next"] for r in got.collect()} == {x: n for x, n in want.items() if n is not None}


# ---- acceptance ---------------------------------------------------------------------------------

INF = "tenant_id string, message_id string, inference_id long, ts timestamp, cost_usd double"
FB = "tenant_id string, message_id string, feedback_id long, feedback string, ts timestamp"


def sides(rnd, n=300):
    inferences = [(f"t{i % 3}", f"m{rnd.randint(0, 80)}", i, at(minutes=rnd.randint(0, 600)), 0.5) for i in range(n)]
    feedback = [(f"t{i % 3}", f"m{rnd.randint(0, 80)}", i, rnd.choice(["accepted", "rejected"]), at(minutes=rnd.randint(0, 600))) for i in range(n)]
    return inferences, feedback


def plain_answers(inferences, feedback):
    out = {}
    for tenant, message, i, ts, cost in inferences:
        fit = [(f[4], f[2], f[3]) for f in feedback if f[:2] == (tenant, message) and ts <= f[4] <= ts + dt.timedelta(hours=1)]
        out[i] = (tenant, min(fit)[2] if fit else None)
    return out


def test_acceptance(spark):
    inferences, feedback = sides(random.Random(7))
    inferences.append((None, "m1", 900, at(), None))
    linked = answers.link_feedback(spark.createDataFrame(inferences, INF), spark.createDataFrame(feedback, FB))
    first = answers.first_answers(linked)
    want = plain_answers(inferences, feedback)
    assert {r["inference_id"]: (r["tenant_id"], r["feedback"]) for r in first.collect()} == want
    for r in answers.acceptance(first).collect():
        mine = [f for t, f in want.values() if t == r["tenant_id"]]
        told, yes = sum(f is not None for f in mine), mine.count("accepted")
        assert (r["inferences"], r["answered"], r["accepted"]) == (len(mine), told, yes)
        assert r["acceptance_rate"] == (yes / told if told else None) and r["cost_per_accepted"] == (len(mine) * 0.5 / yes if yes else None)


def test_stream_of_answers_equals_the_batch_on_closed_intervals(spark):
    inferences, feedback = sides(random.Random(8))
    streams = []
    for rows, schema, name in ((inferences, INF, "inf"), (feedback, FB, "fb")):
        rows = sorted(rows, key=lambda r: r[schema.split(", ").index("ts timestamp")])
        streams.append(stream_from(spark, write_batches(spark, name, [rows[i * 100 : i * 100 + 100] for i in range(3)], schema), schema))
    linked = answers.link_feedback(*streams, delays=("10 minutes", "10 minutes"))
    got = {r["inference_id"]: (r["tenant_id"], r["feedback"]) for r in answers.first_answers(jobs.run_to_table(linked, "answers")).collect()}
    end = min(max(r[3] for r in inferences), max(r[4] for r in feedback)) - dt.timedelta(minutes=72)
    want = plain_answers(inferences, feedback)
    closed = {r[2] for r in inferences if r[3] < end}
    assert len(closed) > 150 and {i: got.get(i) for i in closed} == {i: want[i] for i in closed}
    assert any(want[i][1] is None for i in closed)


# ---- days ---------------------------------------------------------------------------------------


def day_log(spark, seed, n=4000):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        tenant = rnd.choice(["hot"] * 6 + ["a", "b", None])
        day = rnd.choice([1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 20, 20, 20])
        if tenant != "a" or day < 9:
            rows.append((i, tenant, rnd.choice(["spam", "ham"]), at(days=day, minutes=rnd.randint(0, 1439)), rnd.uniform(0, 50) if i % 11 else None))
    return rows, spark.createDataFrame(rows, "id long, tenant_id string, label string, ts timestamp, ms double").repartition(6)


def test_volume_anomalies_fill_empty_days(spark):
    rows, df = day_log(spark, 1)
    counts = collections.Counter((r[1], r[3].date()) for r in rows)
    parts = [trends.daily_moments(df.where(F.col("id") % 3 == i), F.col("ms")) for i in range(3)]
    merged = trends.merge_moments(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert sorted(merged.collect(), key=str) == sorted(trends.daily_moments(df, F.col("ms")).collect(), key=str)
    days = trends.fill_days(merged)
    got = {(r["tenant_id"], r["day"]): r for r in trends.volume_anomalies(days, threshold=2.0).collect()}
    last = max(d for _, d in counts)
    for tenant in {t for t, _ in counts}:
        first = min(d for t, d in counts if t == tenant)
        span = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
        assert {d for t, d in got if t == tenant} == set(span)
        for k, day in enumerate(span):
            before = [counts[tenant, d] for d in span[max(0, k - 7) : k]]
            r = got[tenant, day]
            assert (r["volume"], r["days_before"]) == (counts[tenant, day], len(before))
            if before:
                mean = sum(before) / len(before)
                spread = math.sqrt(sum((x - mean) ** 2 for x in before) / len(before))
                assert r["mean"] == pytest.approx(mean) and r["deviation"] == pytest.approx(spread, abs=1e-9)
                assert (r["z"] is None) == (spread < 1e-12) and (spread < 1e-12 or r["z"] == pytest.approx((r["volume"] - mean) / spread))
                if spread > 1e-12 and abs(abs((r["volume"] - mean) / spread) - 2) > 1e-6:
                    assert r["anomalous"] == (len(before) >= 3 and abs(r["volume"] - mean) / spread >= 2)
    assert sum(r["anomalous"] for r in got.values()) > 0 and any(r["volume"] == 0 for r in got.values())


def test_a_change_behind_equal_days_stands_out(spark):
    rows = [(i, "t", "x", at(days=d, minutes=i), 1.0) for d in range(6) for i in range(10 if d < 5 else 11)]
    df = spark.createDataFrame(rows, "id long, tenant_id string, label string, ts timestamp, ms double")
    got = trends.volume_anomalies(trends.fill_days(trends.daily_moments(df))).orderBy("day").collect()
    assert [r["anomalous"] for r in got] == [False] * 5 + [True] and all(r["z"] is None for r in got)
    assert trends.volume_anomalies(trends.fill_days(trends.daily_moments(df.limit(0)))).count() == 0


def test_value_anomalies_use_the_rows_of_all_trailing_days(spark):
    rows, df = day_log(spark, 2)
    got = trends.value_anomalies(trends.fill_days(trends.daily_moments(df, F.col("ms"))), min_rows=1).collect()
    for r in got:
        mine = [math.floor(x[4] or 0) for x in rows if x[1] == r["tenant_id"] and x[3].date() == r["day"]]
        usual = [math.floor(x[4] or 0) for x in rows if x[1] == r["tenant_id"] and 1 <= (r["day"] - x[3].date()).days <= 7]
        if mine and usual:
            m, u = sum(mine) / len(mine), sum(usual) / len(usual)
            error = math.sqrt(sum((x - u) ** 2 for x in usual) / len(usual) / len(mine))
            assert r["mean"] == pytest.approx(m) and r["usual"] == pytest.approx(u) and r["z"] == pytest.approx((m - u) / error)


def test_trends(spark):
    rows, df = day_log(spark, 3)
    got = {(r["level"], r["tenant_id"], r["label"], r["day"]): (r["n"], r["share"], r["change"]) for r in trends.tenant_trends(df).collect()}
    counts = collections.Counter()
    for _, tenant, label, ts, _ in rows:
        t, d = tenant or "", ts.date()
        counts.update([("tenant label", t, label, d), ("tenant", t, None, d), ("label", None, label, d), ("all", None, None, d)])
    first = min(k[3] for k in counts)
    want = {}
    for (level, t, label, d), n in counts.items():
        total = counts["tenant", t, None, d] if t is not None else counts["all", None, None, d]
        change = None if d == first else n - counts.get((level, t, label, d - dt.timedelta(days=1)), 0)
        want[level, t, label, d] = (n, n / total, change)
    assert got == want


# ---- sketches -----------------------------------------------------------------------------------


def test_percentiles_from_stored_sketches(spark):
    n = 200_000  # half of one value, a long tail, one hot task
    value = F.when(F.col("id") % 2 == 0, 10.0).otherwise(F.pow(F.lit(1.0001), (F.col("id") * 7919 % n).cast("double")))
    task = F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 10).cast("string")))
    df = spark.range(0, n, 1, 16).select(
        task.alias("task_type"), value.alias("latency_ms"), F.timestamp_seconds(F.lit(T0.timestamp()) + F.col("id") % 86400).alias("ts")
    )
    path = scratch_path(spark, "sketches")
    for day in (0, 1):  # two loads
        sketches.latency_sketches(df.where(F.hash("latency_ms", "ts") % 2 == (day if day == 0 else 1))).write.mode("append").parquet(path)
    sketches.latency_sketches(df.where(F.hash("latency_ms", "ts") % 2 == -1)).write.mode("append").parquet(path)
    merged = sketches.merge_sketches(spark.read.parquet(path), ["task_type"])
    assert merged.agg(F.sum("n")).first()[0] == n
    assert merged.select(F.max(F.octet_length("sketch"))).first()[0] < 20_000
    far = sketches.rank_errors(df, sketches.sketch_percentiles(merged, ["task_type"]), ["task_type"]).collect()
    assert len(far) == 3 and all(r[c] <= 0.01 for r in far for c in sketches.SHARES)
    plan = plan_of(sketches.sketch_percentiles(sketches.merge_sketches(sketches.latency_sketches(df, window=None)), []))
    assert "Python" not in plan


def test_sketches_of_few_or_no_rows_are_exact(spark):
    df = spark.createDataFrame([("a", float(i), at()) for i in range(1, 101)] + [("a", None, at()), ("b", None, at())], "task_type string, latency_ms double, ts timestamp")
    got = sketches.sketch_percentiles(sketches.merge_sketches(sketches.latency_sketches(df), ["task_type"]), ["task_type"]).collect()
    assert [(r["task_type"], r["n"], r["mean_ms"], r["p50_ms"], r["p95_ms"], r["p99_ms"]) for r in got] == [("a", 100, 50.5, 50.0, 95.0, 99.0)]
    assert sketches.sketch_percentiles(sketches.merge_sketches(sketches.latency_sketches(df.limit(0)), ["task_type"]), ["task_type"]).count() == 0


# ---- registry -----------------------------------------------------------------------------------

RUN = "task string, run_id string, at timestamp, precision double, recall double, f1 double"


def test_a_run_that_is_worse_is_refused(spark):
    gates = metrics.gate_table(spark, {"spam": (0.5, 0.5, 0.5)})
    path = scratch_path(spark, "registry")
    first = spark.createDataFrame([("spam", "r1", at(), 0.8, 0.8, 0.8)], RUN)
    rest = spark.createDataFrame([("spam", "r3", at(hours=2), 0.9, 0.8, 0.85), ("spam", "r2", at(hours=1), 0.9, 0.7, 0.79), ("spam", "r1", at(), 0.1, 0.1, 0.1)], RUN)
    low = spark.createDataFrame([("spam", "r4", at(hours=3), 0.4, 0.9, 0.6), ("other", "x", at(), 0.0, 0.0, 0.0), ("spam", "r5", at(hours=4), None, 0.9, 0.9)], RUN)
    for load in (first, rest, rest, low):
        registry.register_runs(load, gates, path)
    rows = {(r["task"], r["run_id"]): (r["promoted"], r["failure_reason"]) for r in registry.read_registry(spark, path).collect()}
    assert registry.read_registry(spark, path).count() == 6
    assert rows[("spam", "r1")] == (True, "") and rows[("spam", "r3")] == (True, "") and rows[("other", "x")] == (True, "")
    assert rows[("spam", "r2")] == (False, "recall=0.7000 (was 0.8000 in r1), f1=0.7900 (was 0.8000 in r1)")
    assert not rows[("spam", "r4")][0] and rows[("spam", "r4")][1].startswith("precision=0.4000 (min 0.5)") and "(was 0.9000 in r3)" in rows[("spam", "r4")][1]
    assert not rows[("spam", "r5")][0] and "precision=missing" in rows[("spam", "r5")][1]
    assert {(r["task"], r["run_id"]) for r in registry.last_promoted(registry.read_registry(spark, path)).collect()} == {("spam", "r3"), ("other", "x")}


def test_runs_equal_a_sequential_model(spark):
    rnd = random.Random(5)
    runs = [(f"k{t}", f"r{i:02d}", at(hours=rnd.randint(0, 4)), *[round(rnd.uniform(0.4, 1), 1) for _ in range(3)]) for t in range(6) for i in range(9)]
    gates = metrics.gate_table(spark, {f"k{t}": (0.5, 0.5, 0.5) for t in range(6)})
    got = {(r["task"], r["run_id"]): r["promoted"] for r in registry.decide_runs(spark.createDataFrame(runs, RUN), gates, tolerance=0.1).collect()}
    want, last = {}, {}
    for task, run, _, *m in sorted(runs, key=lambda r: (r[2], r[1])):
        ok = all(x >= 0.5 for x in m) and all(x >= y - 0.1 for x, y in zip(m, last.get(task, m)))
        want[task, run] = ok
        last[task] = m if ok else last.get(task, m) if task in last else None
        if last[task] is None:
            del last[task]
    assert got == want and {True, False} == set(want.values())


# ---- bulk sending -------------------------------------------------------------------------------


def sent(spark, n=6000):
    """One text fills the hot tenant's first hour, others come often or once."""
    rnd = random.Random(9)
    rows = [("hot", " Same  text", at(minutes=rnd.randint(0, 59))) for _ in range(n // 3)]
    rows += [(rnd.choice(["hot", "a", None]), f"text {rnd.randint(0, 40)}" if i % 3 else f"once {i}", at(minutes=rnd.randint(0, 300))) for i in range(n)]
    rows += [("a", None, at()), ("a", "x", None), ("b", "", at())]
    return spark.createDataFrame(rows, "tenant_id string, text string, ts timestamp").repartition(8)


def by_groups(df, threshold):
    return collections.Counter(map(tuple, df.groupBy("tenant_id", "hour", "content").count().where(F.col("count") >= threshold).collect()))


@pytest.mark.parametrize("threshold", [1, 10, 200])
@pytest.mark.parametrize("width", [8, 2048])
def test_bulk_senders_equal_a_plain_count(spark, threshold, width):
    df = bulk.contents(sent(spark))
    got = bulk.bulk_senders(df, threshold, width=width).select("tenant_id", "hour", "content", "n").collect()
    assert collections.Counter(map(tuple, got)) == by_groups(df, threshold)


def test_bulk_senders_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(bulk, "broadcast_if_small", lambda d: d)
    df = bulk.contents(sent(spark, 1500))
    loads = [bulk.count_min(df.where(F.pmod(F.hash("content"), F.lit(2)) == i)) for i in (0, 1)]
    got = bulk.bulk_senders(df, 5, bulk.merge_count_min(loads[0].unionByName(loads[1])))
    assert collections.Counter(map(tuple, got.select("tenant_id", "hour", "content", "n").collect())) == by_groups(df, 5)


def test_sketches_of_contents_are_combined_before_the_shuffle(spark):
    df = spark.range(0, 40_000, 1, 4).select(F.lit("hot").alias("tenant_id"), F.lit(0).cast("long").alias("hour"), F.md5(F.col("id").cast("string")).alias("content"))
    counters = bulk.count_min(df, width=64)
    assert counters.count() == 4 * 64 and counters.agg(F.sum("n")).first()[0] == 4 * 40_000
    plan = plan_of(counters)
    assert plan.index("HashAggregate") < plan.index("Exchange") < plan.rindex("HashAggregate") and plan.count("Exchange hashpartitioning") == 1


def test_heavy_counters_are_bits_that_a_message_looks_up(spark):
    """Full or sparse, a tenant and hour take a word per 64 counters at most; no message walks the heavy counters one by one."""
    rnd = random.Random(3)
    cells = {"full": {(r, c) for r in range(4) for c in range(100)}, "one": {(3, 99)}, None: {(rnd.randrange(4), rnd.randrange(100)) for _ in range(40)}}
    rows = [(t, 0, r, c, 3 if (r, c) in heavy else 2) for t, heavy in cells.items() for r in range(4) for c in range(100)]
    sketch = spark.createDataFrame([*rows, ("none", 0, 1, 1, 2)], "tenant_id string, hour long, row int, cell long, n long").repartition(4)
    found = {r["tenant_id"]: r for r in bulk.heavy_cells(sketch, 3, 100).collect()}
    for t, heavy in cells.items():
        words = dict(zip(found[t]["words"], found[t]["bits"], strict=True))
        assert len(words) == len(found[t]["words"]) == len({(r * 100 + c) // 64 for r, c in heavy}) and 0 not in words.values()
        assert {divmod(w * 64 + b, 100) for w, bits in words.items() for b in range(64) if bits >> b & 1} == heavy
    assert found.keys() == cells.keys()
    df = bulk.contents(sent(spark, 1500))
    senders = bulk.bulk_senders(df, 5, width=100)
    assert "lambda" not in plan_of(senders) and "array_contains" not in plan_of(senders)
    assert collections.Counter(map(tuple, senders.select("tenant_id", "hour", "content", "n").collect())) == by_groups(df, 5)


def test_job_changes_ask_the_store_once_a_job(spark):
    """A new job costs a read, a write and a timer, however many events it has; later runs of numbers still count once."""
    from types import SimpleNamespace

    asked, value, seen, timers = collections.Counter(), [], {}, set()

    def call(name, work):
        return lambda *a: (asked.update([name]), work(*a))[1]

    state = SimpleNamespace(exists=call("exists", lambda: bool(value)), get=call("get", lambda: value[-1] if value else None), update=call("update", lambda v: value.append(tuple(v))))
    runs = SimpleNamespace(
        containsKey=call("map", lambda k: k in seen), getValue=call("map", seen.get), updateValue=call("map", lambda k, v: seen.update({k: v}))
    )
    handle = SimpleNamespace(
        getValueState=lambda *a: state, getMapState=lambda *a: runs, listTimers=call("timer", lambda: iter(list(timers))),
        deleteTimer=call("timer", timers.discard), registerTimer=call("timer", timers.add),
    )
    jobs_ = job_states.JobStates(1000, 5000, None)
    jobs_.init(handle)

    def batch(*numbers):
        asked.clear()
        rows = [Row(ts=n * 1_000_000, seq=n, status="running", rest=None) for n in numbers]
        return len(list(jobs_.handleInputRows((1,), iter(rows), None)))

    assert batch(0, 1, 2, 3, 4) == 5 and sum(asked.values()) == 3
    assert batch(2, 3, 4, 5, 1000) == 2 and timers == {1000 * 1000 + 5000}
    assert batch(0, 5, 1000) == 0 and batch(62, 1000, 1001, 2) == 1
