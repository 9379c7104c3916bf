"""Lines as bytes: records whose bytes are no UTF-8 are found and listed, not repaired in silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType, StringType

from .. import schemas

BAD_ENCODING = "bad_encoding"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at (block of the file), line (bytes without the line feed) of every line.

    The text reader takes bytes as they are; nothing here decodes them.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("line")
    )


def is_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


def first_bad_byte(data: Column) -> Column:
    """Where, from 0, the first sequence starts that is no UTF-8; null if there is none.

    The bytes are compared with their repaired form by halving: up to the first
    repair both are the same.  A cut character whose repair starts with the
    same bytes is found by going back to where a prefix is valid.
    """
    whole = F.make_valid_utf8(data.cast("string")).cast("binary")
    start = F.struct(F.lit(0).alias("low"), F.octet_length(data).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        same = F.substring(data, F.lit(1), middle) == F.substring(whole, F.lit(1), middle)
        return F.when(s["low"] >= s["high"], s).otherwise(
            F.struct(F.when(same, middle).otherwise(s["low"]).alias("low"), F.when(same, s["high"]).otherwise(middle - 1).alias("high"))
        )

    agreed = F.aggregate(F.sequence(F.lit(0), F.lit(31)), start, halve)["low"]
    back = F.filter(F.transform(F.sequence(F.lit(0), F.lit(-3), F.lit(-1)), lambda d: agreed + d), lambda n: (n >= 0) & is_utf8(F.substring(data, F.lit(1), n)))
    return F.when(~is_utf8(data), F.get(back, F.lit(0)))


def encoding_verdicts(lines: DataFrame, data_col: str = "line") -> DataFrame:
    """Add ``verdict`` ("bad_encoding" or null) and ``bad_byte``, the offset of the first bad sequence."""
    return lines.withColumns({"verdict": F.when(~is_utf8(F.col(data_col)), BAD_ENCODING), "bad_byte": first_bad_byte(F.col(data_col))})


def read_jsonl_checked(spark: SparkSession, path: str, schema: StructType = schemas.MESSAGE) -> DataFrame:
    """The records of JSON lines with ``verdict`` and ``bad_byte``; blank lines are skipped.

    A line with bad bytes has null fields and the verdict "bad_encoding", one
    that is no JSON object "bad_json"; a record of the file that has neither is
    for :func:`postlens.operators.validation.record_verdicts` to judge.
    """
    lines = encoding_verdicts(read_lines(spark, path)).where(~F.coalesce(F.col("line").cast("string").rlike(r"^\s*$") & F.col("verdict").isNull(), F.lit(False)))
    typed = StructType([*schema.fields, StructField("_bad", StringType())])
    text = F.when(F.col("verdict").isNull(), F.col("line").cast("string"))
    parsed = lines.withColumn("_r", F.from_json(text, typed, {"columnNameOfCorruptRecord": "_bad"}))
    broken = F.col("verdict").isNull() & (F.col("_r").isNull() | F.col("_r._bad").isNotNull())
    return parsed.select(
        "file", *[F.when(~broken, F.col(f"_r.{n}")).alias(n) for n in schema.names], F.when(broken, "bad_json").otherwise(F.col("verdict")).alias("verdict"), "bad_byte"
    )
