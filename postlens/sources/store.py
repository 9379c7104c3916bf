"""Data-set store: appended training records and version snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed, schemas


def add_records(df: DataFrame, path: str, *, rebalance: bool = False) -> None:
    """Append records; a missing ``created_at`` becomes now.

    Every task writes a file per part it holds.  ``rebalance`` shuffles the
    records first, so that a load from many tasks gives few, even files; large
    parts are split, small ones joined.
    """
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.RECORD.fields if f.name not in df.columns]
    full = df.select("*", *missing).select(*schemas.RECORD.names)
    stamped = full.withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
    if rebalance:
        stamped = stamped.hint("rebalance", "domain", "split")
    stamped.write.mode("append").partitionBy("domain", "split").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RECORD).parquet(path)


def query_records(records: DataFrame, domain: str = "", split: str = "") -> DataFrame:
    """Records of a domain and split; an empty string matches any.

    Both are partition columns of the store, so other parts are not read.
    """
    for name, wanted in (("domain", domain), ("split", split)):
        if wanted:
            records = records.where(F.col(name) == wanted)
    return records


def version_snapshot(records: DataFrame, version: str, description: str = "") -> DataFrame:
    """Record counts per domain and split under a version name."""
    counts = records.groupBy("domain").pivot("split", list(fixed.SPLITS)).count()
    return counts.select(
        F.lit(version).alias("version"),
        "domain",
        *[F.coalesce(F.col(s), F.lit(0).cast("bigint")).alias(f"{s}_count") for s in fixed.SPLITS],
        F.current_timestamp().alias("created_at"),
        F.lit(description).alias("description"),
    )


def tag_version(records: DataFrame, path: str, version: str, description: str = "") -> None:
    version_snapshot(records, version, description).write.mode("append").parquet(path)


def list_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DATASET_VERSION).parquet(path)
