"""Centroid clustering (operator 11) by progressive search over Walsh-Hadamard coefficients.

Vectors become integers, and these their exact integer Walsh-Hadamard
coefficients, coarse to fine: the first is the sum of all components, the first
two give the sums of the halves, and so on.  The squared difference of all
coefficients is ``size`` times the squared distance, and that of the first few
never exceeds it.  So the search adds up squared differences coarse to fine,
finishes the closest centroid after a few of them for a bound, and drops a
centroid as soon as its part is strictly above the bound of its vector.  The
survivors are finished, so distances and ties are exact.

The coefficients are written once.  A round reads them, each task sends one row
of sums per centroid, and Spark adds these up: nothing is shuffled by cluster
but those rows, so a centroid that holds most vectors costs no more than others.
The driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize

SIZE = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
#: Largest scaled component: 64 squared differences of 64 coefficients then stay within 63 bits.
LARGEST = 1 << 24
#: Coefficients after which a centroid is finished to have a bound.
FIRST = 4
#: Vectors that a task compares at a time.
BATCH = 4096


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of rows of integers, coarse to fine; twice gives ``size`` times x."""
    n, size = x.shape
    y = x.reshape(n, 1, size)
    while y.shape[2] > 1:
        even, odd = y[:, :, 0::2], y[:, :, 1::2]
        y = np.stack([even + odd, even - odd], axis=2).reshape(n, 2 * y.shape[1], y.shape[2] // 2)
    return y.reshape(n, size)


def invert(coefficients: np.ndarray) -> np.ndarray:
    """The vectors that coefficients belong to."""
    n, size = coefficients.shape
    y = coefficients.reshape(n, size, 1)
    while y.shape[1] > 1:
        pairs = y.reshape(n, y.shape[1] // 2, 2, y.shape[2])
        total, gap = pairs[:, :, 0], pairs[:, :, 1]
        y = np.stack([(total + gap) >> 1, (total - gap) >> 1], axis=3).reshape(n, pairs.shape[1], 2 * y.shape[2])
    return y.reshape(n, size)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid, the smaller number among equals.

    Both are coefficients; rows of ``vectors`` and of ``centroids`` must be there.
    """
    n, k = len(vectors), len(centroids)
    size = vectors.shape[1]
    row, number = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    part = np.zeros(n * k, np.int64)
    bound = np.full(n, np.iinfo(np.int64).max)
    low, high = 0, 1
    while low < size:
        gap = vectors[row, low:high] - centroids[number, low:high]
        part += np.einsum("ij,ij->i", gap, gap)
        if high == min(FIRST, size):
            lead = _least(row, part, n)
            rest = vectors[:, high:] - centroids[number[lead], high:]
            bound = part[lead] + np.einsum("ij,ij->i", rest, rest)
        alive = part <= bound[row]
        row, number, part = row[alive], number[alive], part[alive]
        low, high = high, 2 * high
    lead = _least(row, part, n)
    return number[lead], part[lead] // size


def _least(row: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
    """Where the first of the smallest parts of each row stands; rows ascend and none is missing."""
    starts = np.searchsorted(row, np.arange(n))
    least = np.flatnonzero(part == np.minimum.reduceat(part, starts)[row])
    return least[np.searchsorted(row[least], np.arange(n))]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def coefficients(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """id and c (array<int>): the coefficients of floor(scale * x) of every usable vector.

    Left out are null vectors, those of another length, with a null or
    non-finite component, or with one that scales beyond 2^24, whose sums 64
    bits would not hold.
    """
    small = lambda x: x.isNotNull() & (F.abs(x) * scale <= LARGEST)  # noqa: E731  (NaN is larger than any number)
    kept = df.select(df[vec_id].alias("id"), df[vector].cast("array<double>").alias("x")).where(
        F.coalesce((F.size("x") == size) & F.forall("x", small), F.lit(False))
    )
    whole = kept.select("id", F.transform("x", lambda x: F.floor(F.when(small(x), x * scale)).cast("int")).alias("x"))
    kind = whole.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                flat = transform(_matrix(part.column(1))).astype(np.int32).ravel()
                ends = np.arange(0, len(flat) + 1, size, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, flat)], names=["id", "c"])

    return whole.mapInArrow(run, f"id {kind}, c array<int>")


def first_centroids(vectors: DataFrame, count: int = CENTROIDS, seed: int = 1) -> np.ndarray:
    """Coefficients of the ``count`` vectors with the smallest SHA-256 of ``seed:id``, in that order.

    Rows of one id are ordered by their coefficients; without an id they come last.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    top = vectors.select(key.alias("h"), "c").orderBy(F.col("h").asc_nulls_last(), "c").limit(count)
    return np.array([r["c"] for r in top.collect()], np.int64)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of the vectors of each centroid that has any."""
    size = centroids.shape[1]
    names = [f"s{i}" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                c = _matrix(batch.column(0).slice(at, BATCH))
                number, _ = nearest(c, centroids)
                x = invert(c)
                counts += np.bincount(number, minlength=len(centroids))
                np.add.at(totals, number, x)
        used = np.flatnonzero(counts)
        if len(used):
            columns = [used, counts[used], *totals[used].T]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "n", *names])

    made = ", ".join(f"{c} long" for c in ("cluster", "n", *names))
    parts = vectors.select("c").mapInArrow(run, made)
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    return {r["cluster"]: (r["n"], [r[c] for c in names]) for r in total.collect()}


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor of the mean of their vectors; those without any stay."""
    out = centroids.copy()
    for number, (n, sums) in _sums(vectors, centroids).items():
        out[number] = transform(np.array([[s // n for s in sums]], np.int64))[0]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster and squared distance of every vector."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                number, distance = nearest(_matrix(part.column(1)), centroids)
                columns = [part.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"id {kind}, cluster int, distance long")


def cluster(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    size: int = SIZE,
    count: int = CENTROIDS,
    rounds: int = ROUNDS,
    seed: int = 1,
) -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): id, cluster and distance of every usable vector, and the final centroids' components.

    A repeated row is a vector of its own.  With fewer vectors than ``count``
    there are that many centroids; an empty table has no rows and no centroids.
    ``size`` is a power of two.
    """
    vectors = materialize(coefficients(df, vec_id, vector, size), "coefficients")
    centroids = first_centroids(vectors, count, seed).reshape(-1, size)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    return materialize(assigned(vectors, centroids), "clusters"), invert(centroids)


def clustering(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256, a row per usable vector.

    The hash is of the centroid's components in decimal, joined by commas.
    """
    rows, centroids = cluster(df, vec_id, vector)
    spark = df.sparkSession
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(sums.values())
    facts = [
        (i, sums[i], total, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
        for i, c in enumerate(centroids)
        if i in sums
    ]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    return rows.withColumnRenamed("id", vec_id).join(F.broadcast(spark.createDataFrame(facts, schema)), "cluster")
