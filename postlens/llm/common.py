"""What the operators of this subpackage share: tables, Arrow maps, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize, scratch_path

__all__ = [
    "BROADCAST_BYTES",
    "Memo",
    "ascii_lower",
    "bounded_batches",
    "broadcast_if_bounded",
    "in_fold",
    "map_rows",
    "materialize",
    "scratch_path",
    "share",
    "table",
    "tidy",
]

BROADCAST_BYTES = 32 << 20
#: Words that one worker remembers; beyond it they are worked out again.
MEMO_WORDS = 400_000
#: Longest key, in characters, that is remembered.
MEMO_KEY = 256
#: Rows and bytes of text that a map holds as Python objects at a time; one row may be longer.
ROWS, ROW_BYTES = 500, 4 << 20
#: Bytes of rows that travel to Python in one batch, and the setting for it; one row may be longer.
BATCH_BYTES, BATCH_SETTING = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Memo(dict):
    """A bounded memo of ``work(key)``, filled on first use; long keys are worked out each time."""

    def __init__(self, work: Callable, limit: int = MEMO_WORDS):
        super().__init__()
        self.work, self.limit = work, limit

    def __missing__(self, key):
        value = self.work(key)
        if len(key) > MEMO_KEY:
            return value
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


def share(spark: SparkSession, value) -> Callable:
    """A function for tasks that gives ``value``, an object whose attributes are plain data.

    Only the attributes are broadcast; the class travels with the function, so
    executors need no copy of this package.
    """
    kind, state = type(value), spark.sparkContext.broadcast(vars(value))

    def load():
        found = object.__new__(kind)
        found.__dict__.update(state.value)
        return found

    return load


def tidy() -> None:
    """Give back what a task held; workers live on, and memos that refer to themselves would stay until the next collection.

    What the collector frees goes back to the system only when the C library, where it can, is told to.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends Python ``BATCH_BYTES`` at a time, unless it has a setting of its own.

    Spark's default is 64 MB, that is 10,000 texts in one buffer.  Buffers of many megabytes cost more than they
    hold: the C library raises its bounds to the largest one given back, and then keeps as much for each thread.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def slices(texts: pa.Array, rows: int = ROWS, size: int = ROW_BYTES) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of texts within both bounds, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        n = min(rows, max(1, int(np.searchsorted(ends, before + size, "right")) - at))
        yield at, min(n, len(ends) - at)
        at += n


def map_rows(
    df: DataFrame,
    keep: Iterable[str],
    text: str,
    fields: list[tuple[str, pa.DataType]],
    work: Callable[[], Callable[[list], list[tuple]]],
) -> DataFrame:
    """``keep`` columns next to what ``work()`` makes of the texts, batch by batch.

    ``work()`` runs once a task and returns a function from a list of texts
    (None allowed) to one tuple of ``fields`` per text.  Only the named columns
    travel to Python, under names of our own, so that no name can clash.
    """
    keep = list(keep)
    narrow = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], df[text].cast("string").alias("t"))
    kept = ", ".join(f"k{i} {narrow.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    types = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double", pa.int32(): "int"}
    made = ", ".join(f"v{i} {types.get(kind, 'array<int>')}" for i, (_, kind) in enumerate(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = work()
        for whole in batches:
            for at, n in slices(whole.column(len(keep))):
                batch = whole.slice(at, n)
                columns = list(zip(*call(batch.column(len(keep)).to_pylist())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(len(keep))]
                    + [pa.array(columns[i], kind) for i, (_, kind) in enumerate(fields)],
                    names=[f"k{i}" for i in range(len(keep))] + [f"v{i}" for i in range(len(fields))],
                )
        del call
        tidy()

    return narrow.mapInArrow(run, ", ".join(x for x in (kept, made) if x)).toDF(*keep, *[n for n, _ in fields])


def broadcast_if_bounded(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, hinted for broadcasting if the bytes of its rows, summed by Spark, stay below ``limit``.

    Give it a written table: it is read once more for the sum.
    """
    width = sum(
        (F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) + 16 for f in df.schema.fields),
        F.lit(16),
    )
    total = df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(df) if total <= limit else df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` alone where the text is ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, *_LETTERS)).otherwise(F.lower(text))


_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_fold(doc_id: Column, buckets: int, bucket: int) -> Column:
    """crc32 of the id's text modulo ``buckets`` is ``bucket``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % buckets == bucket, F.lit(False))
