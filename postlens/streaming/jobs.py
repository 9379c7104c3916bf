"""Streaming forms of quota, latency, scoring, feedback and job-state work.

Each builder takes a streaming frame and returns one; :func:`run_to_table`
drives a stream to a parquet table with a checkpoint in the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import fixed
from ..plans.score import score_messages
from ..session import scratch_path


def stream_quota(
    requests: DataFrame,
    *,
    window: str = "1 minute",
    delay: str = "1 minute",
    max_requests: int = fixed.RATE_LIMIT_PER_MINUTE,
    tenant_col: str = "tenant_id",
    ts_col: str = "ts",
) -> DataFrame:
    """Requests per tenant and window, and how many are over the quota."""
    counts = (
        requests.withWatermark(ts_col, delay)
        .groupBy(tenant_col, F.window(ts_col, window))
        .agg(F.count("*").alias("n"))
    )
    return counts.select(
        tenant_col,
        F.col("window.start").alias("window_start"),
        "n",
        F.greatest(F.col("n") - max_requests, F.lit(0).cast("bigint")).alias("denied"),
    )


def stream_task_latency(
    requests: DataFrame,
    *,
    window: str = "1 hour",
    delay: str = "1 minute",
    task_col: str = "task_type",
    latency_col: str = "latency_ms",
    ts_col: str = "ts",
) -> DataFrame:
    """Requests and mean whole milliseconds per task and window."""
    ms = F.greatest(F.col(latency_col).cast("bigint"), F.lit(0))
    sums = (
        requests.withWatermark(ts_col, delay)
        .groupBy(task_col, F.window(ts_col, window))
        .agg(F.count("*").alias("n"), F.sum(ms).alias("_sum"))
    )
    return sums.select(
        task_col,
        F.col("window.start").alias("window_start"),
        F.col("n").alias("task_count"),
        F.expr("_sum div n").alias("latency_avg_ms"),
    )


def stream_scoring(messages: DataFrame, task: str = fixed.TASK_SPAM, *, overrides: DataFrame | None = None) -> DataFrame:
    """Stateless scoring; the policy is a static, size-checked lookup."""
    return score_messages(messages, task, overrides=overrides)


def stream_feedback(
    feedback: DataFrame, *, ts_col: str = "created_at", delay: str = "10 minutes", dedup: bool = True
) -> DataFrame:
    """Feedback records, repeats within the watermark dropped."""
    if not dedup:
        return feedback
    marked = feedback.withWatermark(ts_col, delay)
    return marked.dropDuplicatesWithinWatermark(["tenant_id", "message_id", "feedback"])


def run_to_table(stream: DataFrame, name: str, *, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process everything available, appending to a parquet table; returns it."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-checkpoint"))
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


# ---- job state -----------------------------------------------------------------------


def merge_job_state(
    events: DataFrame,
    path: str,
    *,
    checkpoint: str | None = None,
    job_col: str = "job_id",
    ts_col: str = "ts",
    seq_col: str = "seq",
) -> DataFrame:
    """Keep each job's latest event in a table, batch by batch.

    A batch is reduced to its latest event per job before it is written, and
    reading reduces again, so order between batches does not matter.  The batch
    id names the folder: a batch that is run again replaces its own output.
    """
    spark = events.sparkSession

    def absorb(batch: DataFrame, batch_id: int) -> None:
        newest = latest_events(batch, job_col, ts_col, seq_col)
        newest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        events.writeStream.foreachBatch(absorb)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "jobs-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return read_job_state(spark, path, job_col, ts_col, seq_col)


def latest_events(df: DataFrame, job_col: str, ts_col: str, seq_col: str) -> DataFrame:
    newest = F.max_by(F.struct("*"), F.struct(ts_col, seq_col))
    return df.groupBy(F.col(job_col).alias("_job")).agg(newest.alias("_e")).select("_e.*")


def read_job_state(
    spark: SparkSession, path: str, job_col: str = "job_id", ts_col: str = "ts", seq_col: str = "seq"
) -> DataFrame:
    rows = spark.read.parquet(path).drop("batch")
    return latest_events(rows, job_col, ts_col, seq_col)


def compact_job_state(spark: SparkSession, path: str, out: str, **columns) -> None:
    """Write one row per job as the first part of a new state table.

    The stream goes on into ``out`` with its old checkpoint.
    """
    read_job_state(spark, path, **columns).write.mode("errorifexists").parquet(f"{out}/batch=-1")


# ---- sources ---------------------------------------------------------------------------


def parquet_stream(
    spark: SparkSession, path: str, schema: StructType, max_files: int | None = None
) -> DataFrame:
    """A table as a stream, whether ``path`` is a folder of files or one file."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    folder, _, name = path.rpartition("/")
    if spark.read.parquet(path).inputFiles()[0].endswith(f"/{name}"):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


__all__: Sequence[str] = [
    "stream_quota",
    "stream_task_latency",
    "stream_scoring",
    "stream_feedback",
    "run_to_table",
    "merge_job_state",
    "read_job_state",
    "compact_job_state",
    "latest_events",
    "parquet_stream",
]
