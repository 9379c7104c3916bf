"""Bulk sending: contents that one tenant sends very often within an hour.

Heavy hitters first: a count-min sketch per tenant and hour, a table of counters
that add up, so sketches of loads merge.  A content's estimate is never below its
count, so those whose estimate reaches the threshold are all that can; they are
counted again, exactly.  Counters and counts are partial sums before any shuffle:
a content that fills an hour costs a task one row.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from ..session import broadcast_if_small, materialize

#: Rows of counters, and counters in a row: estimates exceed counts by at most e / WIDTH of the hour's messages, but for 1.8 % of contents.
DEPTH, WIDTH = 4, 2048
KEYS = ("tenant_id", "hour")
_SALTS = 32


def hour_of(ts: Column) -> Column:
    """The UTC hour of a time, in seconds since 1970."""
    return (F.floor(F.unix_micros(ts) / F.lit(3_600_000_000)) * 3600).cast("long")


def content_hash(text: Column) -> Column:
    """128 bits of the text in lower case with runs of white space as one blank."""
    return F.md5(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")))


def contents(df: DataFrame, *, tenant_col: str = "tenant_id", text_col: str = "text", ts_col: str = "ts") -> DataFrame:
    """tenant_id, hour and content of the messages that have a time and a text."""
    return df.where(F.col(ts_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(tenant_col).alias("tenant_id"), hour_of(F.col(ts_col)).alias("hour"), content_hash(F.col(text_col)).alias("content")
    )


def _cell(content: Column, row: int, width: int) -> Column:
    return F.pmod(F.xxhash64(content, F.lit(row)), F.lit(width))


def _cells(content: Column, depth: int, width: int) -> Column:
    return F.array(*[F.struct(F.lit(d).alias("row"), _cell(content, d, width).alias("cell")) for d in range(depth)])


def _word_and_bit(row: Column, cell: Column, width: int) -> tuple[Column, Column]:
    """The word of 64 counters that holds the bit of a counter, and the place of the bit in it."""
    place = row.cast("long") * F.lit(width) + cell
    return F.shiftrightunsigned(place, 6).cast("int"), place.bitwiseAND(F.lit(63)).cast("int")


def count_min(messages: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """tenant_id, hour, row, cell and n of the counters that are not 0.

    A task sends at most ``depth * width`` counters per tenant and hour, however
    many different contents it has seen.
    """
    placed = messages.select(*KEYS, F.explode(_cells(F.col("content"), depth, width)).alias("c"))
    return placed.groupBy(*KEYS, F.col("c.row").alias("row"), F.col("c.cell").alias("cell")).agg(F.count("*").alias("n"))


def merge_count_min(sketches: DataFrame) -> DataFrame:
    """The sketch of all loads from the sketches of each."""
    return sketches.groupBy(*KEYS, "row", "cell").agg(F.sum("n").alias("n"))


def heavy_cells(sketch: DataFrame, threshold: int, width: int = WIDTH) -> DataFrame:
    """tenant_id, hour, words and bits: the counters that reach the threshold, one bit each.

    Words without a bit are left out, so a tenant and hour take at most
    ``depth * width / 64`` words, and few where few counters are heavy.
    """
    word, bit = _word_and_bit(F.col("row"), F.col("cell"), width)
    heavy = sketch.where(F.col("n") >= threshold).select(*KEYS, word.alias("word"), bit.alias("bit"))
    words = heavy.groupBy(*KEYS, "word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))
    packed = words.groupBy(*KEYS).agg(F.collect_list(F.struct("word", "bits")).alias("w"))
    return packed.select(*KEYS, F.col("w.word").alias("words"), F.col("w.bits").alias("bits"))


def _held(content: Column, depth: int, width: int) -> Column:
    """Has every counter of the content its bit in ``words`` and ``bits``?  Null counts as no."""

    def bit_of(row: int) -> Column:
        word, bit = _word_and_bit(F.lit(row), _cell(content, row, width), width)
        return F.getbit(F.get("bits", F.array_position("words", word).cast("int") - 1), bit) == 1

    return functools.reduce(Column.__and__, [bit_of(d) for d in range(depth)])


def bulk_senders(
    messages: DataFrame, threshold: int, sketch: DataFrame | None = None, depth: int = DEPTH, width: int = WIDTH
) -> DataFrame:
    """tenant_id, hour, content and n of every content sent ``threshold`` times or more by a tenant in an hour.

    ``messages`` is :func:`contents`; ``sketch`` its merged counters, if loads
    have theirs already.  The counters that reach the threshold are at most the
    messages over the threshold, times the depth; their bits are broadcast if few
    enough, else the messages of a tenant and hour are dealt to salted parts.
    A message looks at ``depth`` bits, however many counters are heavy.
    """
    counters = materialize(count_min(messages, depth, width) if sketch is None else sketch, "count-min")
    heavy = materialize(heavy_cells(counters, threshold, width), "heavy-cells").withColumnsRenamed({k: f"_{k}" for k in KEYS})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]
    small = broadcast_if_small(heavy)
    if small is heavy:
        small = heavy.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        messages = messages.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("int"))
        same.append(F.col("_part") == F.col("_salt"))
    possible = messages.join(small, functools.reduce(Column.__and__, same)).where(_held(F.col("content"), depth, width))
    return possible.groupBy(*KEYS, "content").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
