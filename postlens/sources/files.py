"""JSON-lines and CSV corpora, append logs."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import fixed, schemas
from ..functions.labels import guess_column, normalize_label
from ..functions.text import strip_space


def read_jsonl(spark: SparkSession, path: str, schema: StructType = schemas.MESSAGE) -> DataFrame:
    """One JSON object per line; blank lines are skipped, a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def save_splits(df: DataFrame, out_dir: str, prefix: str = "", mode: str = "errorifexists") -> str:
    """Write the ``split`` parts as JSON lines in one pass; returns their folder."""
    path = f"{out_dir.rstrip('/')}/{prefix}splits"
    df.write.mode(mode).option("ignoreNullFields", "false").partitionBy("split").json(path)
    return path


def load_split(
    spark: SparkSession,
    out_dir: str,
    split: str | None = None,
    prefix: str = "",
    schema: StructType = schemas.MESSAGE,
) -> DataFrame:
    """One split (its folder alone is read) or all of them with their name."""
    path = f"{out_dir.rstrip('/')}/{prefix}splits"
    typed = StructType([*schema.fields, StructField("split", StringType())])
    df = read_jsonl(spark, path, typed)
    return df if split is None else df.where(F.col("split") == split).drop("split")


def write_report(df: DataFrame, path: str) -> None:
    """An evaluation report, one JSON object per model."""
    write_jsonl(df, path, mode="overwrite")


def append_log(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append to a log table (inference or feedback records)."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


# ---- CSV ---------------------------------------------------------------------------

_CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "mode": "PERMISSIVE",
    "ignoreCorruptFiles": True,
}


def _headers(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """CSV files under ``root`` grouped by their header line."""
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .option("ignoreCorruptFiles", True)
        .text(root)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),
            "value",
        )
        .where("start = 0")
    )
    first = lines.groupBy("file").agg(F.min_by("value", "row").alias("header"))
    files = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    # Spark lists every input file on the driver as well; no rows come along.
    return {r["header"]: [_literal_path(f) for f in r["files"]] for r in files.collect()}


def _column_names(header: str) -> list[str]:
    """Names in a header line; a name that is empty or repeated gets its position."""
    names: list[str] = []
    for i, name in enumerate(next(csv.reader([header.lstrip("\ufeff")]), [])):
        names.append(name if name and name.lower() not in {n.lower() for n in names} else f"{name}_{i}")
    return names


def _literal_path(uri: str) -> str:
    """A path for a reader from a file URI: decoded, glob characters escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def read_csv_corpus(spark: SparkSession, root: str, source: str, *, multi_line: bool = True) -> DataFrame:
    """Labelled messages from every CSV file under ``root``.

    Files are grouped by header; text and label columns are guessed per group,
    and a group where that fails is left out.  Quoted texts may hold newlines,
    which makes one file one task; pass ``multi_line=False`` for huge files
    without them, and Spark splits the files.
    """
    parts = []
    for header, files in sorted(_headers(spark, root).items()):
        columns = _column_names(header)
        schema = StructType([StructField(c, StringType()) for c in columns])
        df = spark.read.schema(schema).options(**_CSV, multiLine=multi_line).csv(files)
        text_col = guess_column(columns, fixed.TEXT_COLUMN_CANDIDATES)
        label_col = guess_column(columns, fixed.LABEL_COLUMN_CANDIDATES)
        if text_col is not None and label_col is not None:
            parts.append(labelled(df, text_col, label_col, source))
    if not parts:
        return spark.createDataFrame([], "text string, label int, source string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def skipped_csv(spark: SparkSession, root: str) -> DataFrame:
    """file, bytes and reason of the CSV files under ``root`` that :func:`read_csv_corpus` leaves out.

    "unreadable" has no line that the reader could get, "no text or label
    column" a header in which a column could not be guessed.  Files without a
    byte have nothing to leave out and are not listed.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(root)
        .select(F.regexp_replace("path", "^file:/+", "/").alias("file"), F.col("length").alias("bytes"))
    )
    known, unusable = [], []
    for header, names in _headers(spark, root).items():
        columns = _column_names(header)
        found = [guess_column(columns, c) for c in (fixed.TEXT_COLUMN_CANDIDATES, fixed.LABEL_COLUMN_CANDIDATES)]
        (unusable if None in found else known).extend(names)
    listed = [(_plain_path(n), False) for n in known] + [(_plain_path(n), True) for n in unusable]
    seen = spark.createDataFrame(listed, "file string, unusable boolean")
    reason = F.when(F.col("unusable"), "no text or label column").when(F.col("unusable").isNull(), "unreadable")
    return files.join(seen, "file", "left").select("file", "bytes", reason.alias("reason")).where("reason IS NOT NULL")


def _plain_path(path: str) -> str:
    return re.sub(r"^file:/+", "/", re.sub(r"\\([\[\]{}*?\\])", r"\1", path))


def labelled(df: DataFrame, text_col: str, label_col: str, source: str, keep: Sequence[str] = ()) -> DataFrame:
    """(text, label, source) with a normalised label; unusable rows are dropped."""
    rows = df.select(
        *keep,
        strip_space(F.col(f"`{text_col}`").cast("string")).alias("text"),
        normalize_label(F.col(f"`{label_col}`")).alias("label"),
        F.lit(source).alias("source"),
    )
    return rows.where(F.col("label").isNotNull() & (F.col("text") != ""))
