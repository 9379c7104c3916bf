"""Removal of repeated byte strings over suffix arrays (operator 2).

A string of ``length`` bytes belongs to the smallest hash of its 32-byte windows,
so equal strings belong to the same hash.  The strings of a text that follow
each other under one hash make one segment, and shards of segments are dealt by
that hash: every pair of equal strings meets in one shard, no text does.

Before that, equal segments become one: their strings all repeat.  A hash with
one segment, whose strings have it at one place, has nothing else to offer.  Where
that is so in each segment of a hash, equal strings have it equally far in, so
they share one of a few blocks around it; starts whose block stands in no other
segment go too.  What is left, and hashes that may repeat in a segment, goes to
the shards, whose suffixes are sorted by external induced
sorting; neighbours that share ``length`` bytes repeat.  Each different text is
represented once, under its MD5.

Most hashes stand in one segment only.  A first pass shuffles nothing but hashes
to find the others; bitmaps of a fixed size then keep segments and texts that
cannot take part out of every later shuffle.  A bit that is set by chance, or a
bitmap that is full, only lets more through.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import ROWS, bounded_batches, materialize, slices, tidy
from .suffixes import BATCH, Folder, repeated

LENGTH = 400
#: Bytes of a window; shorter strings than this cannot be asked for.
GRAM = 32
#: Bytes of a word's code where repeats are asked for by words.
CODE = 4
#: Blocks of a string by which starts without an equal are told.
BLOCKS = 4
#: What bytes.split takes for a word.
WORD, SPACE = re.compile(rb"[^ \t\n\r\x0b\x0c]+"), re.compile(rb"[ \t\n\r\x0b\x0c]")
#: Bits of a place in the numbers by which segments are found; the hash has the rest but one.
PLACE = 23
#: Bits of a bitmap, 8 MB.
BITS = 1 << 26
#: Longest period of a stretch that is shortened before its suffixes are sorted, and how many bytes must come again to look closer.
PERIOD, SAME = 64, 32
#: Bytes a shard is meant to hold; it may hold any number, on disk.
SHARD_BYTES = 3 << 20

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def segments(data: bytes, length: int, unit: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first and last start, where its first string has the hash first, whether others have it elsewhere) of the segments of a text.

    With a ``unit`` of ``CODE`` bytes, strings start at multiples of it only; ``length`` is one, too.
    Starts are taken ``1 << PLACE`` at a time, where a segment may be cut in two.
    """
    found = []
    for at in range(0, max(len(data) - length, 0) + 1, unit << PLACE):
        m, *places, moves = _segments(data[at : at + (unit << PLACE) + length - unit], length, unit)
        found.append((m, *(x + at for x in places), moves))
    return found[0] if len(found) == 1 else tuple(map(np.concatenate, zip(*found)))


def _segments(data: bytes, length: int, unit: int):
    n, letters = len(data) // unit, length // unit
    if n < letters:
        return (*(np.zeros(0, np.int64),) * 4, np.zeros(0, bool))
    if unit == 1:
        h = _BYTE[np.frombuffer(data, np.uint8)]
    else:
        h = (np.frombuffer(data, np.uint32).astype(np.uint64) + np.uint64(1)) * _BYTE[0]
        h ^= h >> np.uint64(31)
    size, level = 1, 0
    while size < GRAM // unit:
        h = h[:-size] * _STEP[level] + h[size:]
        size, level = 2 * size, level + 1
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # the place goes into the lower bits: the least is the first of those with the smallest hash
    h >>= np.uint64(PLACE + 1)
    h <<= np.uint64(PLACE + 1)
    h |= np.arange(len(h), dtype=np.uint64)
    span, size = letters - GRAM // unit + 1, 1
    while 2 * size <= span:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    if span > size:
        h = np.minimum(h[: len(h) - (span - size)], h[span - size :])
    step = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
    m, at = (h[step] >> np.uint64(PLACE + 1)).view(np.int64), (h[step] & np.uint64((2 << PLACE) - 1)).view(np.int64)
    new = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    first = step[new]
    last = np.append(first[1:], len(h)) - 1
    return m[new], first * unit, last * unit, at[new] * unit, np.diff(np.append(new, len(step))) > 1


def block_edges(length: int, unit: int) -> list[int]:
    """How many bytes a string may have in front of its hash's place, from block to block; the last edge counts as well."""
    return [(length - GRAM) // unit * k // BLOCKS * unit for k in range(BLOCKS + 1)]


def blocks(data: memoryview, first: int, last: int, at: int, edges: list[int]) -> list[int | None]:
    """A hash for each block of what all its strings have around the place ``at``; None for blocks without a start in first..last."""
    out = []
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        some = at - low >= first and (at - high < last or at - high == last and k == len(edges) - 2)
        part = data[at - low : at + GRAM + edges[-1] - high] if some else None
        out.append(xxhash.xxh3_64_intdigest(part) - (1 << 63) if some else None)
    return out


def bitmap(values: DataFrame, bits: int = BITS):
    """A broadcast bitmap, ``bits`` / 8 bytes, with a bit for each of the one column of longs."""
    block = 19  # 64 kB of a bitmap are put together in one task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = batch.column(0).to_numpy()
            for b in np.unique(bit >> block).tolist():
                flags = held.setdefault(b, np.zeros(1 << block, bool))
                flags[bit[bit >> block == b] & ((1 << block) - 1)] = True
        for b, flags in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([np.packbits(flags).tobytes()])], names=["b", "flags"])

    bit = F.col(values.columns[0]).bitwiseAND(bits - 1)
    blocks = max(1, bits >> block)
    rows = (
        values.select(bit.alias("bit"))
        .distinct()
        .repartition(min(blocks, 64), F.shiftright("bit", block))
        .mapInArrow(run, "b long, flags binary")
        .collect()
    )
    whole = np.zeros(bits >> 3, np.uint8)
    width = min(1 << block, bits) >> 3
    for r in rows:
        whole[r["b"] * width : (r["b"] + 1) * width] = np.frombuffer(r["flags"], np.uint8)[:width]
    return values.sparkSession.sparkContext.broadcast(whole)


def in_bitmap(flags: np.ndarray, values: np.ndarray) -> np.ndarray:
    bit = values & (len(flags) * 8 - 1)
    return (flags[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)


def key_number(key: Column) -> Column:
    """Seven bytes of an MD5 as a long."""
    return F.conv(F.hex(F.substring(key, 2, 7)), 16, 10).cast("long")


def maybe(keys: Column, flags) -> Column:
    """Whether the number of a key is in a broadcast bitmap."""

    def run(numbers: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for n in numbers:
            yield pa.array(in_bitmap(flags.value, n.to_numpy(zero_copy_only=False)))
        tidy()

    return F.arrow_udf(run, "boolean")(key_number(keys))


def segment_hashes(texts: DataFrame, length: int, unit: int) -> DataFrame:
    """m and twice of each segment of ``texts``: text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(0), 256):
                found = [segments(t if isinstance(t, bytes) else t.encode("utf-8"), length, unit) for t in batch.column(0).slice(at, n).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([f[i] for f in found])) for i in (0, 4)], names=["m", "twice"]
                )
        tidy()

    return texts.select("text").mapInArrow(run, "m long, twice boolean")


def segment_rows(texts: DataFrame, length: int, unit: int, flags) -> DataFrame:
    """key (MD5), m (hash), h (content), first, last (starts, both included), at, twice, b0.. (blocks), a row per segment whose m is in ``flags``."""
    edges = block_edges(length, unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.int64(), pa.binary(), *[pa.int64()] * 3, pa.bool_(), *[pa.int64()] * BLOCKS)
        names = ["key", "m", "h", "first", "last", "at", "twice", *[f"b{k}" for k in range(BLOCKS)]]
        for batch in batches:
            for at, n in slices(batch.column(0), 256):
                rows = []
                for data in batch.column(0).slice(at, n).to_pylist():
                    data = data if isinstance(data, bytes) else data.encode("utf-8")
                    m, *found = segments(data, length, unit)
                    some = np.flatnonzero(in_bitmap(flags.value, m)) if len(m) else ()
                    if not len(some):
                        continue
                    view, key = memoryview(data), hashlib.md5(data).digest()
                    for x, first, last, place, twice in zip(*(c[some].tolist() for c in (m, *found))):
                        content = xxhash.xxh3_128_digest(view[first : last + length])
                        rows.append((key, x, content, first, last, place, twice, *blocks(view, first, last, place, edges)))
                columns = zip(*rows) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        tidy()

    made = "".join(f", b{k} long" for k in range(BLOCKS))
    return texts.select("text").mapInArrow(run, f"key binary, m long, h binary, first long, last long, at long, twice boolean{made}")


def sharing_a_block(contents: DataFrame, length: int, unit: int) -> DataFrame:
    """m, h, key, first, last of the ``contents`` (m, h, one) with a block that stands in another of the same m, cut to such starts.

    In each all strings must have the hash m at one place.
    """
    edges = block_edges(length, unit)
    parts = []
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        least = F.col("one.at") - (high if k == BLOCKS - 1 else high - unit)
        parts.append(
            F.struct(
                F.lit(k).alias("k"),
                F.col(f"one.b{k}").alias("b"),
                F.greatest("one.first", least).alias("first"),
                F.least("one.last", F.col("one.at") - low).alias("last"),
            )
        )
    each = contents.select("m", "h", "one.key", F.explode(F.array(*parts)).alias("p")).select("m", "h", "key", "p.*").where("b IS NOT NULL")
    common = each.groupBy("m", "k", "b").agg(F.count("*").alias("n")).where("n > 1").select("m", "k", "b")
    left = each.join(common, ["m", "k", "b"], "left_semi")
    return left.groupBy("m", "h", "key").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def cut_segments(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """key, m, first and the bytes of the ``wanted`` segments (key, m, h, first, last)."""
    by_text = wanted.groupBy("key").agg(F.collect_list(F.struct("m", "first", "last")).alias("parts"))
    keyed = texts.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    some = bitmap(wanted.select(key_number(F.col("key")).alias("n")))
    different = keyed.where(maybe(F.col("key"), some)).dropDuplicates(["key"])  # copies go before the shuffle
    joined = different.join(by_text.hint("shuffle_hash"), "key")
    cut = joined.select("key", F.col("text").cast("binary").alias("data"), F.explode("parts").alias("p"))
    return cut.select(
        "key",
        "p.m",
        "p.first",
        F.substring("data", (F.col("p.first") + 1).cast("int"), (F.col("p.last") - F.col("p.first") + length).cast("int")).alias("data"),
    )


def shortened(data: np.ndarray, length: int, unit: int = 1) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """``data`` with its long periodic stretches cut to less than ``2 * (length + period)`` bytes, and where.

    In a stretch that repeats itself every few bytes each string of ``length``
    bytes repeats, before and after the cut, and strings that reach over an end
    of the stretch see nothing of the cut: whole periods go from behind its first
    ``length`` bytes.  A run of a million equal letters would else keep the
    sorting busy with one suffix at a time.
    """
    cuts = []
    if len(data) <= 2 * length + 2:
        return data, cuts
    # a stretch that is long enough holds one of these places, whose next bytes then come again a period behind
    whole, periods = data.tobytes(), set()
    for at in range(0, len(whole) - SAME, length):
        found = whole.find(whole[at : at + SAME], at + 1, at + PERIOD + SAME)
        if found > 0:
            periods.add(math.lcm(found - at, unit))
    for period in sorted(periods):
        same = np.concatenate([[False], data[period:] == data[:-period], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        start, size = edge[::2], edge[1::2] - edge[::2] + period
        gone = np.maximum(size - 2 * length - period, 0) // period * period
        start, gone = start[gone > 0], gone[gone > 0]
        if not len(start):
            continue
        keep = np.ones(len(data), bool)
        for a, n in zip((start + length).tolist(), gone.tolist()):
            keep[a : a + n] = False
        data, total = data[keep], np.cumsum(gone)
        cuts.append((start + length - total + gone, total))
    return data, cuts


def unshortened(places: np.ndarray, cuts: list[tuple[np.ndarray, np.ndarray]], side: str) -> np.ndarray:
    """Places in shortened data as places in the whole; a cut lies before a start ("right") and behind an end ("left") at it."""
    for at, total in reversed(cuts):
        places = places + np.concatenate([[0], total])[np.searchsorted(at, places, side)]
    return places


def digits(codes: np.ndarray, folder: Folder) -> tuple[np.ndarray, int]:
    """``codes`` (uint32; 0 stands for the end of a string) as letters of a text for ``repeated``, and how many a code becomes.

    A code becomes the digits of its rank among all codes.  Each digit has
    letters of its own, so no string can equal one that starts inside a code.
    """
    every = np.zeros(0, np.uint32)
    for k in range(0, len(codes), BATCH):
        every = np.union1d(every, codes[k : k + BATCH])
    width = max(1, -(-int(len(every) - 1).bit_length() // 8))
    out = folder.array(len(codes) * width + 1, np.int16)
    for k in range(0, len(codes), BATCH):
        part = np.asarray(codes[k : k + BATCH])
        rank = np.searchsorted(every, part)
        for i in range(width):
            letter = (rank >> 8 * (width - 1 - i) & 255) + 2 + 256 * i
            out[k * width + i : (k + len(part)) * width : width] = np.where(part == 0, 1, letter)
    out[-1] = 0
    return out, width


def shard_spans(parts: DataFrame, shards: int, length: int, unit: int) -> DataFrame:
    """key, start, end of the bytes of repeated strings, shard by shard; ``parts``: key, m, first, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Folder() as folder:
            keys, firsts, sizes, cuts = [], [], [], []
            size = 0
            with open(f"{folder.path}/text", "wb") as file:
                for batch in batches:
                    for at, n in slices(batch.column(3)):
                        for key, first, data in zip(*(batch.column(i).slice(at, n).to_pylist() for i in (0, 2, 3))):
                            data, cut = shortened(np.frombuffer(data, np.uint8), length, unit)
                            if unit == 1:
                                np.append(data.astype(np.int16) + 2, np.int16(1)).tofile(file)
                            else:
                                np.append(np.frombuffer(data.tobytes(), np.uint32), np.uint32(0)).tofile(file)
                            keys.append(key)
                            firsts.append(first)
                            sizes.append(len(data) // unit + 1)
                            cuts.append(cut)
                            size += sizes[-1]
                if unit == 1:
                    np.zeros(1, np.int16).tofile(file)
            if not keys:
                return
            if unit == 1:
                text, width = np.memmap(f"{folder.path}/text", np.int16, "r", shape=(size + 1,)), 1
            else:
                text, width = digits(np.memmap(f"{folder.path}/text", np.uint32, "r", shape=(size,)), folder)
            letters = length // unit
            found = repeated(text, letters * width, folder)[: size * width : width]
            at, held = 0, []

            def spans() -> pa.RecordBatch:
                by_key, starts, ends = zip(*held)
                every = [k for k, x in zip(by_key, starts) for _ in range(len(x))]
                return pa.RecordBatch.from_arrays(
                    [pa.array(every, pa.binary()), pa.array(np.concatenate(starts)), pa.array(np.concatenate(ends))],
                    names=["key", "start", "end"],
                )

            for i, n in enumerate(sizes):
                hit = found[at : at + max(n - letters, 0)]
                at += n
                if len(held) == ROWS:
                    yield spans()
                    held.clear()
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                if not len(edge):
                    continue
                start = unshortened(edge[::2] * unit, cuts[i], "right") + firsts[i]
                end = unshortened((edge[1::2] - 1) * unit + length, cuts[i], "left") + firsts[i]
                held.append((keys[i], start, end))
            if held:
                yield spans()
            del text, found
        tidy()

    dealt = parts.repartition(shards, "m")
    return dealt.mapInArrow(run, "key binary, start long, end long")


def repeated_spans(texts: DataFrame, length: int = LENGTH, unit: int = 1) -> DataFrame:
    """key (MD5 of the text), start, end: bytes of ``texts`` (text or binary, not null) covered by repeated strings.

    With a ``unit`` of ``CODE`` bytes, strings start at multiples of it only.
    """
    alone = (
        segment_hashes(texts, length, unit).groupBy("m").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where("n > 1 OR twice")
    )
    rows = segment_rows(texts, length, unit, bitmap(alone.select("m")))
    made = [f"b{k}" for k in range(BLOCKS)]
    places = materialize(rows.groupBy("m", "h", "key", "first", "last", "at", "twice", *made).agg(F.count("*").alias("n")), "segments")
    contents = materialize(
        places.groupBy("m", "h").agg(
            F.sum("n").alias("n"), F.min(F.struct("key", "first", "last", "at", "twice", *made)).alias("one")
        ),
        "segment-contents",
    )
    groups = (
        contents.groupBy("m")
        .agg(
            F.count("*").alias("kinds"),
            F.max(F.col("one.twice") & (F.col("n") == 1)).alias("twice"),
            F.max("one.twice").alias("anywhere"),
        )
        .where("kinds > 1 OR twice")
    )
    asked = materialize(contents.join(groups.select("m", "anywhere"), "m").select("m", "h", "one", "anywhere"), "segments-asked")
    wanted = materialize(
        asked.where("anywhere")
        .select("m", "h", "one.key", "one.first", "one.last")
        .unionAll(sharing_a_block(asked.where("NOT anywhere"), length, unit)),
        "segments-wanted",
    )
    total = wanted.agg(F.sum(F.col("last") - F.col("first") + length + 1)).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    unequal = shard_spans(cut_segments(texts, wanted, length), shards, length, unit)
    equal = places.join(contents.where("n > 1").select("m", "h"), ["m", "h"], "left_semi").select(
        "key", F.col("first").alias("start"), (F.col("last") + length).alias("end")
    )
    return equal.unionAll(unequal)


class WordCodes:
    """Codes of the words of a text, from running sums of byte values times powers of an odd number."""

    def __init__(self, size: int = 1 << 16):
        self.size = size
        self.space = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
        self.powers = self.powers_of(2 * size)

    def powers_of(self, n: int) -> list[np.ndarray]:
        """The powers 0 to n - 1 of the number and of its inverse."""
        step = int(_STEP[0])
        return [np.cumprod(np.array([1] + [x] * (n - 1), np.uint64)) for x in (step, pow(step, -1, 1 << 64))]

    def piece(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        up, down = self.powers if n < len(self.powers[0]) else self.powers_of(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        inside = np.zeros(n + 2, bool)
        np.logical_not(self.space[data], out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        h = (total[edge[1::2]] - total[edge[::2]]) * down[edge[::2]]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return np.maximum(h >> np.uint64(32), 1).astype(np.uint32)

    def codes(self, data: bytes) -> np.ndarray:
        """A code above 0 for each word between ASCII white space; pieces of a text end at white space."""
        found, at = [np.zeros(0, np.uint32)], 0
        while at < len(data):
            space = SPACE.search(data, at + self.size)
            end = space.start() if space else len(data)
            found.append(self.piece(np.frombuffer(data, np.uint8, end - at, at)))
            at = end
        return np.concatenate(found)


def repeated_words(texts: DataFrame, words: int) -> DataFrame:
    """key (MD5 of the text), start, end (not included): words of ``texts`` covered by repeated runs of ``words`` words.

    Each word (between ASCII white space) becomes a code of its hash, and the
    repeated strings of so many codes are found like those of bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCodes()
        for batch in batches:
            for at, n in slices(batch.column(0), 256):
                data = [t.encode("utf-8") for t in batch.column(0).slice(at, n).to_pylist()]
                codes = [coder.codes(d).tobytes() for d in data]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.md5(d).digest() for d in data], pa.binary()), pa.array(codes, pa.binary())], names=["whole", "text"]
                )
        tidy()

    length = CODE * words
    coded = texts.select("text").mapInArrow(run, "whole binary, text binary").where(F.octet_length("text") >= length)
    coded = materialize(coded, "word-codes")
    spans = repeated_spans(coded, length, CODE).select("key", *[F.expr(f"{c} DIV {CODE}").alias(c) for c in ("start", "end")])
    wholes = coded.select("whole", F.unhex(F.md5("text")).alias("key")).distinct()
    return spans.join(wholes, "key").select(F.col("whole").alias("key"), "start", "end")


def left_of(data: bytes, spans: list[tuple[int, int]], runs: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of ``data`` without ``spans`` (start, end) of bytes and ``runs`` of words, how many bytes went and from how many places."""
    if runs:
        places = [w.span() for w in WORD.finditer(data)]
        spans = spans + [(places[a][0], places[b - 1][1]) for a, b in runs]
    out, at, removed, count = [], 0, 0, 0
    for start, end in sorted(spans):
        if start > at or not count:
            out.append(data[at:start])
            count += 1
            removed += end - start
            at = end
        elif end > at:
            removed += end - at
            at = end
    out.append(data[at:])
    return b"".join(out), removed, count


def covered(spans: list[tuple[int, int]]) -> int:
    """How many places lie in one of ``spans`` (start, end) at least."""
    at, count = 0, 0
    for start, end in sorted(spans):
        count += max(end - max(start, at), 0)
        at = max(at, end)
    return count


#: What without_repeats adds, and what it adds for passages.
MADE = ("kept", "n_bytes", "n_removed", "n_spans")
COUNTED = "n_passage_words"


def _cut(df: DataFrame, text: str, length: int, words: int, decoded: bool, passages: int = 0) -> DataFrame:
    """row (the columns of ``df`` but ``text`` and those added), given (whether there is a text), data (its bytes), ``MADE`` and ``COUNTED``.

    With ``decoded``, kept is a string without the characters that were cut in half.
    """
    df = bounded_batches(df)
    texts = df.where(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"))
    spans = repeated_spans(texts, length).withColumn("kind", F.lit("bytes"))
    if words:
        spans = spans.unionAll(repeated_words(texts, words).withColumn("kind", F.lit("words")))
    if passages:
        spans = spans.unionAll(repeated_words(texts, passages).withColumn("kind", F.lit("passages")))
    per_text = spans.groupBy("key").agg(
        *[
            F.collect_set(F.when(F.col("kind") == kind, F.struct("start", "end"))).alias(name)
            for kind, name in (("bytes", "spans"), ("words", "runs"), ("passages", "passages"))
        ]
    )
    keep = [F.col(c) for c in df.columns if c not in _made(passages) and c != text]
    data = F.coalesce(F.col(text).cast("string").cast("binary"), F.lit("").cast("binary"))
    row = df.select(
        F.struct(*keep or [F.lit(True)]).alias("row"), F.col(text).isNotNull().alias("given"), data.alias("data"), F.unhex(F.md5(data)).alias("key")
    )
    per_text = materialize(per_text, "repeated-spans")
    some = bitmap(per_text.select(key_number(F.col("key")).alias("n")))
    row = row.select("*", F.explode(F.array(maybe(F.col("key"), some))).alias("some"))

    def cut(pieces: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        kept_type = pa.string() if decoded else pa.binary()
        kind = pa.struct([("kept", kept_type), *[(c, pa.int64()) for c in ("n_removed", "n_spans", COUNTED)]])
        for columns in pieces:
            parts = []
            for at, n in slices(columns[0], 256):
                out = []
                for d, *found in zip(*(c.slice(at, n).to_pylist() for c in columns)):
                    a, b, x, y, p, q = (f or [] for f in found)
                    kept, removed, count = left_of(d, list(zip(a, b)), list(zip(x, y)))
                    out.append((kept.decode("utf-8", "ignore") if decoded else kept, removed, count, covered(list(zip(p, q)))))
                parts.append(pa.array(out, kind))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)
        tidy()

    # all that is done to a text is one UDF, as each takes a worker per task; texts without a repeat stay in the JVM
    cutter = F.arrow_udf(cut, f"struct<kept:{'string' if decoded else 'binary'},n_removed:bigint,n_spans:bigint,{COUNTED}:bigint>")
    asked = [F.col(f"{name}.{end}") for name in ("spans", "runs", "passages") for end in ("start", "end")]
    n_bytes = F.octet_length("data").cast("long").alias("n_bytes")
    found = (
        row.where("some")
        .join(per_text, "key", "left")
        .select("row", "given", "data", n_bytes, F.inline(F.array(cutter("data", *asked))))
    )
    none = F.lit(0).cast("long")
    whole = row.where("NOT some").select(
        "row",
        "given",
        "data",
        n_bytes,
        F.col("data").cast("string" if decoded else "binary").alias("kept"),
        none.alias("n_removed"),
        none.alias("n_spans"),
        none.alias(COUNTED),
    )
    return found.unionAll(whole)


def _made(passages: int) -> tuple[str, ...]:
    return (*MADE, COUNTED) if passages else MADE


def without_repeats(df: DataFrame, text: str = "text", length: int = LENGTH, words: int = 0, passages: int = 0) -> DataFrame:
    """``df`` plus kept (the bytes left, binary), n_bytes, n_removed and n_spans, a row per row.

    Every byte covered by a string of ``length`` bytes that starts at another
    place too, in any row, is removed; strings are judged on the input, and a
    row that is repeated counts as two places.  Null counts as the empty text.
    With ``words``, so do runs of so many words, from the first byte of the first
    word to the last byte of the last, whatever white space is between them.
    With ``passages``, n_passage_words is added: how many words of the input lie
    in repeated runs of so many words, which are counted and not removed.
    Columns of ``df`` with the added names are replaced.
    """
    made = _made(passages)
    found = _cut(df, text, length, words, decoded=False, passages=passages)
    own = F.when(F.col("given"), F.col("data").cast("string")).cast(df.schema[text].dataType).alias(text)
    return found.select(*[own if c == text else F.col("row").getField(c).alias(c) for c in df.columns if c not in made], *made)


def drop_repeats(df: DataFrame, text: str = "text", length: int = LENGTH, words: int = 0) -> DataFrame:
    """``df`` with the repeated strings (and runs of ``words`` words) cut out of ``text``; a character cut in half goes whole.

    Rows stay, with an empty text if nothing is left; null stays null.
    """
    found = _cut(df, text, length, words, decoded=True)
    left = F.when(F.col("given"), F.col("kept")).alias(text)
    return found.select(
        *[left if c == text else F.col(c) if c in MADE else F.col("row").getField(c).alias(c) for c in df.columns]
    )
