"""Retention for append tables: whole expired days go unread, the boundary day is rewritten, a manifest switches.

A managed table is a folder of loads, each partitioned by day, and a folder of
manifests: the newest says which days of which loads make up the table.  Loads,
expiry and clean-up write new files first and then one new manifest, so a reader
sees the table as it was before or after, and a job that dies leaves files that
no manifest names.  :func:`vacuum` removes those, and the intermediate tables of
this library that nothing reads any more.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.trends import day_of
from ..session import shared_dir

_MANIFEST = "version long, load string, day date"
EPOCH = dt.date(1970, 1, 1)


def _folder(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, which lists and deletes in any store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _children(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and times of change (seconds) of what lies in a folder; none if it is not there."""
    files, where = _folder(spark, path)
    if not files.exists(where):
        return []
    return [(s.getPath().getName(), s.getModificationTime() // 1000) for s in files.listStatus(where)]


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete manifests, ascending."""
    names = [n for n, _ in _children(spark, f"{path}/manifests")]
    done = [n for n in names if n.startswith("v") and any(c == "_SUCCESS" for c, _ in _children(spark, f"{path}/manifests/{n}"))]
    return sorted(int(n[1:]) for n in done)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[tuple[str, dt.date]]]:
    """(version, parts) of the newest manifest, or of a given one; parts are (load, day)."""
    versions = _versions(spark, path)
    version = version if version is not None else (versions[-1] if versions else 0)
    if not version:
        return 0, []
    rows = spark.read.schema(_MANIFEST).json(f"{path}/manifests/v{version:08d}").where("load IS NOT NULL").collect()
    return version, sorted((r["load"], r["day"]) for r in rows)


def _commit(spark: SparkSession, path: str, version: int, parts: list[tuple[str, dt.date]]) -> int:
    """Write the manifest after ``version``; fails if another job has written it, and then changes nothing."""
    rows = [(version + 1, load, day) for load, day in sorted(parts)] or [(version + 1, None, None)]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.json(f"{path}/manifests/v{version + 1:08d}")
    return version + 1


def _write_load(df: DataFrame, path: str, ts_col: str) -> list[tuple[str, dt.date]]:
    load = uuid.uuid4().hex
    dated = df.withColumn("_day", F.coalesce(day_of(F.col(ts_col)), F.lit(EPOCH)))
    dated.write.partitionBy("_day").parquet(f"{path}/loads/{load}")
    return [(load, dt.date.fromisoformat(n[5:])) for n, _ in _children(df.sparkSession, f"{path}/loads/{load}") if n.startswith("_day=")]


def append(df: DataFrame, path: str, *, ts_col: str = "created_at") -> int:
    """Add rows as a load of days (UTC); returns the table's new version.  Rows without a time count to 1970-01-01."""
    spark = df.sparkSession
    version, parts = manifest(spark, path)
    return _commit(spark, path, version, parts + _write_load(df, path, ts_col))


def read(spark: SparkSession, path: str, schema: StructType, version: int | None = None) -> DataFrame:
    """The table's rows, as the newest manifest (or a given version) has them."""
    _, parts = manifest(spark, path, version)
    folders = [f"{path}/loads/{load}/_day={day}" for load, day in parts]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def expire(spark: SparkSession, path: str, before: dt.datetime, schema: StructType, *, ts_col: str = "created_at") -> dict[str, int]:
    """Drop the rows with a time before ``before`` (UTC); counts of parts dropped, rewritten and kept.

    Days that end by then are left out of the new manifest without being read.
    Only the day that holds the limit is read, and its later rows written anew.
    Rows without a time go with the first expiry.
    """
    before = before if before.tzinfo else before.replace(tzinfo=dt.timezone.utc)
    limit = before.astimezone(dt.timezone.utc)
    version, parts = manifest(spark, path)
    kept = [p for p in parts if p[1] > limit.date()]
    edge = [p for p in parts if p[1] == limit.date()]
    new = []
    if edge:
        rows = spark.read.schema(schema).parquet(*[f"{path}/loads/{load}/_day={day}" for load, day in edge])
        new = _write_load(rows.where(F.col(ts_col) >= F.lit(limit)), path, ts_col)
    if len(kept) + len(edge) < len(parts) or edge:
        _commit(spark, path, version, kept + new)
    return {"dropped": len(parts) - len(kept) - len(edge), "rewritten": len(edge), "kept": len(kept)}


def vacuum(spark: SparkSession, path: str, *, versions: int = 1, grace_seconds: int = 86_400) -> dict[str, int]:
    """Delete what the last ``versions`` manifests don't name, if it is older than the grace; counts of loads, days and manifests.

    The grace leaves readers of older versions, and jobs that have not
    committed yet, their files.
    """
    files, _ = _folder(spark, path)
    known = _versions(spark, path)
    named: dict[str, set[str]] = {}
    for version in known[-versions:]:
        for load, day in manifest(spark, path, version)[1]:
            named.setdefault(load, set()).add(f"_day={day}")
    old = time.time() - grace_seconds
    gone = {"loads": 0, "days": 0, "manifests": 0}

    def delete(kind: str, place: str) -> None:
        files.delete(_folder(spark, place)[1], True)
        gone[kind] += 1

    for load, changed in _children(spark, f"{path}/loads"):
        if load not in named:
            if changed <= old:
                delete("loads", f"{path}/loads/{load}")
            continue
        for day, day_changed in _children(spark, f"{path}/loads/{load}"):
            if day.startswith("_day=") and day not in named[load] and day_changed <= old:
                delete("days", f"{path}/loads/{load}/{day}")
    for name, changed in _children(spark, f"{path}/manifests"):
        version = int(name[1:]) if name.startswith("v") else 0
        if version in known[:-versions] or (version not in known and changed <= old):  # an unfinished one bars the next
            delete("manifests", f"{path}/manifests/{name}")
    return gone


def clean_scratch(spark: SparkSession, *, grace_seconds: int = 7 * 86_400) -> int:
    """Delete this library's intermediate tables in the shared folder that have not changed for the grace; how many."""
    root = f"{shared_dir(spark).rstrip('/')}/postlens"
    old = [n for n, changed in _children(spark, root) if changed <= time.time() - grace_seconds]
    files, _ = _folder(spark, root)
    return sum(bool(files.delete(_folder(spark, f"{root}/{n}")[1], True)) for n in old)
