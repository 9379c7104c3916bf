"""Job lifecycle as keyed state: one row per change, state dropped after a job has ended.

Every job has a state of its own in the state store: its current row, and the
sequence numbers it has taken in, so that a repeated event counts once.  The
numbers are bit masks over runs of 62; the run in use and the timer stand next
to the row, so a job of few events is read once and written once per batch, and
only other runs are entries of a map.  Events
may come in any order within the watermark's delay.  An event-time timer per job
drops its state: ``keep`` after its end, or ``idle`` after the last event of a
job that never ends.  Events that late are below the watermark by then, so a
dropped job does not come back.

The state is spread over the shuffle partitions by job and lives in RocksDB; the
changes are an append-only table, and the jobs not yet dropped can be read from
the store itself.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from .. import fixed
from ..session import scratch_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The state of a job; times are microseconds, ``rest`` is JSON of the carried columns.
_STATE = "status string, ts long, seq long, rest string, created long, started long, updated long, ended long, changes long"
#: Next to it: the job's timer, the run of sequence numbers in use and which of them came, and whether the map holds others.
_KEPT = _STATE + ", timer long, run long, had long, more boolean"
#: Sequence numbers of a run, a bit each of a long.
_RUN = 62
_ENDED = (fixed.JOB_COMPLETED, fixed.JOB_FAILED)


def apply_event(state: tuple | None, event: tuple[int, int, str, str | None]) -> tuple:
    """The state after one more event (ts, seq, status, rest), whatever the order of events.

    Among events of one time the larger sequence number is the later one; a
    null status neither starts nor ends a job.
    """
    ts, seq, status, rest = event
    if state is None:
        state = (None, None, None, None, ts, None, ts, None, 0)
    last, at, number, carried, created, started, updated, ended, changes = state
    if at is None or (ts, seq) >= (at, number):
        last, at, number, carried = status, ts, seq, rest
    if status == fixed.JOB_RUNNING:
        started = ts if started is None else max(started, ts)
    if status in _ENDED:
        ended = ts if ended is None else max(ended, ts)
    return last, at, number, carried, min(created, ts), started, max(updated, ts), ended, changes


def _shown(state: tuple | None) -> tuple | None:
    """What a change must touch to be told."""
    if state is None:
        return None
    status, _, _, rest, created, started, updated, ended, _ = state
    return status, rest, created, started, updated, ended if status in _ENDED else None


class JobStates(StatefulProcessor):
    """Applies each job's events and emits a row per change."""

    def __init__(self, keep_ms: int, idle_ms: int, ttl_ms: int | None):
        self.keep_ms, self.idle_ms, self.ttl_ms = keep_ms, idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", _KEPT, self.ttl_ms)
        self.seen = handle.getMapState("seen", "run long", "had long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.state.get()
        state, (timer, run, had, more) = (None, (None, None, 0, False)) if kept is None else (tuple(kept[:-4]), kept[-4:])
        changed = False
        for r in sorted(rows, key=lambda r: (r["ts"], r["seq"])):  # the events of one job in one batch
            of, bit = r["seq"] // _RUN, 1 << r["seq"] % _RUN
            if of != run:
                if run is not None:
                    self.seen.updateValue((run,), (had,))
                had = self.seen.getValue((of,))[0] if more and self.seen.containsKey((of,)) else 0
                run, more = of, more or run is not None
                changed = True
            if had & bit:
                continue
            had |= bit
            new = apply_event(state, (r["ts"], r["seq"], r["status"], r["rest"]))
            if _shown(new) != _shown(state):
                new = (*new[:-1], new[-1] + 1)
                status, rest, created, started, updated, completed = _shown(new)
                yield Row(
                    job=key[0], status=status, rest=rest, created_at=created, started_at=started,
                    updated_at=updated, completed_at=completed, change=new[-1],
                )
            state, changed = new, True
        if changed:
            if self.ttl_ms is None:
                due = state[6] // 1000 + (self.keep_ms if state[0] in _ENDED else self.idle_ms)
                if due != timer:
                    if timer is not None:
                        self.handle.deleteTimer(timer)
                    self.handle.registerTimer(due)
                timer = due
            self.state.update((*state, timer, run, had, more))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.state.get()
        if kept is not None and kept[-1]:
            self.seen.clear()
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def job_changes(
    events: DataFrame,
    *,
    job_col: str = "job_id",
    ts_col: str = "ts",
    seq_col: str = "seq",
    carry: Sequence[str] = (),
    delay: str = "1 hour",
    keep_seconds: int = 3600,
    idle_seconds: int = 7 * 86400,
    ttl_seconds: int | None = None,
) -> DataFrame:
    """A stream of job changes: the job's row after each event that changes it, numbered by ``change``.

    Events carry a job, a time, a sequence number and a ``status``; rows without
    a job, time or sequence number are left out.  An event with a sequence number
    that the job has had is ignored.  With ``ttl_seconds`` state expires that
    long after its last update by the cluster's clock instead, whatever the
    events' times are, and no timers are set; such a stream runs under a
    processing-time trigger, since one by the clock is never through.
    """
    rest = F.to_json(F.struct(*carry)) if carry else F.lit(None).cast("string")
    rows = (
        events.withWatermark(ts_col, delay)
        .where(F.col(job_col).isNotNull() & F.col(ts_col).isNotNull() & F.col(seq_col).isNotNull())
        .select(
            F.col(job_col).alias("job"), F.unix_micros(F.col(ts_col)).alias("ts"), F.col(seq_col).cast("long").alias("seq"),
            "status", rest.alias("rest"), F.col(ts_col).alias("_time"),
        )
    )
    kind = rows.schema["job"].dataType.simpleString()
    out = rows.groupBy("job").transformWithState(
        statefulProcessor=JobStates(keep_seconds * 1000, idle_seconds * 1000, None if ttl_seconds is None else ttl_seconds * 1000),
        outputStructType=f"job {kind}, status string, rest string, created_at long, started_at long, updated_at long, completed_at long, change long",
        outputMode="append",
        timeMode="EventTime" if ttl_seconds is None else "ProcessingTime",
    )
    carried = StructType([events.schema[c] for c in carry])
    return out.select(
        F.col("job").alias(job_col),
        "status",
        *[F.from_json("rest", carried)[c].alias(c) for c in carry],
        *[F.timestamp_micros(c).alias(c) for c in ("created_at", "started_at", "updated_at", "completed_at")],
        "change",
    )


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs the RocksDB provider; the session's setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before is not None else spark.conf.unset(_PROVIDER)


def write_job_changes(changes: DataFrame, path: str | None = None, checkpoint: str | None = None) -> tuple[DataFrame, str]:
    """Append everything available to a table of changes; returns the table and the checkpoint."""
    spark = changes.sparkSession
    path, checkpoint = path or scratch_path(spark, "job-changes"), checkpoint or scratch_path(spark, "job-changes-checkpoint")
    with rocksdb_state(spark):
        query = (
            changes.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(path)
        )
        query.awaitTermination()
    return spark.read.schema(changes.schema).parquet(path), checkpoint


def current_states(changes: DataFrame, job_col: str = "job_id") -> DataFrame:
    """Each job's row after its last change."""
    rest = [c for c in changes.columns if c not in (job_col, "change")]
    return changes.groupBy(job_col).agg(F.max_by(F.struct(*rest), "change").alias("_last")).select(job_col, "_last.*")


def kept_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """job, status and updated_at of the jobs whose state is still kept, read from the state store alone."""
    with rocksdb_state(spark):
        store = spark.read.format("statestore").option("stateVarName", "job").load(checkpoint)
    return store.select(
        F.col("key.*"), F.col("value.status").alias("status"), F.timestamp_micros("value.updated").alias("updated_at")
    )
