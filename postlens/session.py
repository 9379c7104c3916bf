"""Session helpers: settings for tests, shared scratch space, bounded frames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 32 << 20


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the local benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("postlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="postlens-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table of this run in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/postlens/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Used where several passes need the same intermediate result; a lost
    executor costs nothing because the table is durable.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add (or replace) a costly column that later filters read, not recompute.

    The optimizer would copy the expression into a filter it pushes down; it
    does not push a filter below a generator.
    """
    others = [c for c in df.columns if c != name]
    staged = df.withColumn("_computed", value)
    return staged.select(*others, F.explode_outer(F.array("_computed")).alias(name)).select(
        *(df.columns if name in df.columns else [*df.columns, name])
    )


def broadcast_if_small(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """``df`` for broadcasting if its measured size allows, else ``df`` itself.

    Reads at most ``max_rows + 1`` rows.  A frame within both bounds comes back
    as local rows with a broadcast hint; a larger one is left to a shuffled
    join, where adaptive execution splits skewed partitions.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > max_bytes:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
