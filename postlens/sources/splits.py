"""Splits as files in shuffled order, and read back in that order.

The order is that of an MD5 per record, over all files of a split.  It is made by
range partitions, so each file is a stretch of the order and no task sorts more
than its stretch; their number follows from a count of the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from .. import fixed, schemas

ROWS_PER_FILE = 250_000


def shuffle_key(id_col: str, seed: int = fixed.SPLIT_SEED) -> Column:
    """Where a record stands: MD5 of the seed and its id; another digest than the one that splits."""
    return F.md5(F.concat(F.lit(f"{seed}|order|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def in_file_order(df: DataFrame, id_col: str, seed: int = fixed.SPLIT_SEED, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """``df`` (with ``split``) in range partitions of about ``rows_per_file`` records, sorted by split and key."""
    total = df.count()
    keyed = df.withColumn("_key", shuffle_key(id_col, seed))
    ranged = keyed.repartitionByRange(max(1, -(-total // rows_per_file)), "split", "_key", id_col)
    return ranged.sortWithinPartitions("split", "_key", id_col).drop("_key")


def save_shuffled_splits(
    df: DataFrame,
    out_dir: str,
    prefix: str = "",
    *,
    id_col: str = "msg_id",
    seed: int = fixed.SPLIT_SEED,
    rows_per_file: int = ROWS_PER_FILE,
    mode: str = "errorifexists",
) -> str:
    """Write the ``split`` parts as JSON lines in shuffled order; returns their folder.

    Files of a split, by name, follow each other in the order; records of one id
    (or without one) lie next to each other.
    """
    path = f"{out_dir.rstrip('/')}/{prefix}splits"
    ordered = in_file_order(df, id_col, seed, rows_per_file)
    ordered.write.mode(mode).option("ignoreNullFields", "false").partitionBy("split").json(path)
    return path


def load_in_order(spark: SparkSession, path: str, split: str, schema: StructType = schemas.MESSAGE) -> DataFrame:
    """The records of a split with ``position``, their place from 1 over its files by name.

    Positions are counted per block of a file and added up over blocks.
    """
    rows = (
        spark.read.schema(schema)
        .option("mode", "FAILFAST")
        .json(f"{path.rstrip('/')}/split={split}")
        .select(
            F.struct(*schema.names).alias("_record"),
            F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at")).alias("_block"),
            F.monotonically_increasing_id().alias("_line"),
        )
    )
    sizes = rows.groupBy("_block").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(1)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block of a file
    offsets = sizes.select("_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy("_line"))
    return rows.withColumn("_in", inside).join(offsets, "_block").select("_record.*", (F.col("_before") + F.col("_in")).alias("position"))
