"""Exact nearest-neighbour search and pairwise similarity of vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.vectors import cosine

DECIMALS = 6
_MAX_QUERIES = 1024
_SLICE_ROWS = 50_000
_HITS = "query_id long, vec_id long, score double"


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of equal length, from an Arrow list column, as unit rows."""
    rows = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(rows.reshape(len(lists), -1))


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> dict:
    """The k best hits of each query among these vectors, as columns."""
    scores = np.round(queries @ vectors.T, DECIMALS) + 0.0
    keep = min(k, len(ids))
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :keep]
    return {
        "query_id": np.repeat(query_ids, keep),
        "vec_id": ids[order].ravel(),
        "score": np.take_along_axis(scores, order, axis=1).ravel(),
    }


def dimension(queries: DataFrame) -> int:
    """The length of most query vectors, the smaller of equally frequent ones; 0 without any."""
    sizes = queries.where("query_vec is not null").groupBy(F.size("query_vec").alias("n")).agg(F.count("*").alias("times"))
    most = sizes.orderBy(F.col("times").desc(), "n").first()
    return most["n"] if most else 0


def _fits(vector: str, dim: int):
    return F.col(vector).isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull())


def unfit_vectors(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(side, id) of rows a search leaves out: no vector, a null in it, or another length than most queries."""
    dim = dimension(queries)
    left = queries.where(~F.coalesce(_fits("query_vec", dim), F.lit(False))).select(F.lit("query").alias("side"), F.col("query_id").alias("id"))
    right = vectors.where(~F.coalesce(_fits("embedding", dim), F.lit(False))).select(F.lit("vector").alias("side"), F.col("vec_id").alias("id"))
    return left.unionAll(right)


def semantic_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    *,
    max_queries: int = _MAX_QUERIES,
    slice_rows: int = _SLICE_ROWS,
) -> DataFrame:
    """The ``k`` vectors closest to each query by cosine, ties by smaller id.

    ``vectors`` has (vec_id, embedding), ``queries`` (query_id, query_vec).  A
    query set of at most ``max_queries`` travels to every task, where one matrix
    product per Arrow batch keeps the batch's best ``k`` per query; only those
    reach the shuffle.  A larger set is cut into blocks and the vectors into
    slices, and each (block, slice) is one bounded co-group.  Vectors that do not
    have the length of most queries, or hold a null, take no part; see
    :func:`unfit_vectors`.
    """
    dim = dimension(queries)
    known = vectors.where(_fits("embedding", dim)).select("vec_id", "embedding")
    asked = queries.where(_fits("query_vec", dim)).select("query_id", "query_vec")
    head = asked.limit(max_queries + 1).toArrow().combine_chunks()
    if head.num_rows == 0:
        return vectors.sparkSession.createDataFrame([], _HITS + ", rank int")
    if head.num_rows <= max_queries:
        query_ids = head["query_id"].to_numpy()
        matrix = np.concatenate([_matrix(chunk) for chunk in head["query_vec"].chunks])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
                    hits = _best(query_ids, matrix, ids, _matrix(batch.column("embedding")), k)
                    yield pa.RecordBatch.from_pydict(hits)

        hits = known.mapInArrow(scan, _HITS)
    else:
        hits = _blocked_hits(known, asked, k, max_queries, slice_rows)
    ranking = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)


def _blocked_hits(vectors, queries, k, max_queries, slice_rows) -> DataFrame:
    # Half-full on average, so that hashing does not overfill a cell.
    blocks = max(1, math.ceil(2 * queries.count() / max_queries))
    slices = max(1, math.ceil(2 * vectors.count() / slice_rows))

    def cell(own, other_count, own_count, name):
        """Own side hashed into its cells, copied to each cell of the other side."""
        place = F.pmod(F.xxhash64(own), F.lit(own_count)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(other_count - 1)))
        block, part = (place, every) if name == "query" else (every, place)
        return block.alias("block"), part.alias("part")

    left = queries.select("query_id", "query_vec", *cell("query_id", slices, blocks, "query"))
    right = vectors.select("vec_id", "embedding", *cell("vec_id", blocks, slices, "vector"))

    def match(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return pa.table({"query_id": np.empty(0, int), "vec_id": np.empty(0, int), "score": np.empty(0)})
        sides = [np.concatenate([_matrix(c) for c in t[name].chunks]) for t, name in ((q, "query_vec"), (v, "embedding"))]
        return pa.table(_best(q["query_id"].to_numpy(), sides[0], v["vec_id"].to_numpy(), sides[1], k))

    grouped = left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
    return grouped.applyInArrow(match, _HITS)


def pair_cosine(pairs: DataFrame, vectors: DataFrame, decimals: int = 4) -> DataFrame:
    """Cosine of given (left_id, right_id) pairs."""

    def side(name):
        return vectors.select(F.col("vec_id").alias(f"{name}_id"), F.col("embedding").alias(f"_{name}"))

    both = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    return both.select(
        "left_id", "right_id", F.round(cosine(F.col("_left"), F.col("_right")), decimals).alias("cosine")
    )


def label_centroids(vectors: DataFrame, label_col: str = "label") -> DataFrame:
    """Mean vector per label as a query set (query_id, query_vec)."""
    mean = Summarizer.mean(array_to_vector("embedding"))
    return vectors.groupBy(F.col(label_col).cast("long").alias("query_id")).agg(
        vector_to_array(mean).alias("query_vec")
    )
