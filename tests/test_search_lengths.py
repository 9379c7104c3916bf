"""Vectors that do not fit the queries are left out of a search and listed."""

from postlens.operators import search


def test_ragged_vectors_are_rejects(spark):
    vectors = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [9.0]), (3, [0.0, 1.0, 0.0]), (4, [0.6, None]), (5, None), (6, [0.0, 2.0])], "vec_id long, embedding array<double>"
    )
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0]), (9, [1.0])], "query_id long, query_vec array<double>")
    hits = {(r["query_id"], r["vec_id"]): r["score"] for r in search.semantic_topk(vectors, queries, k=5).collect()}
    assert hits == {(7, 1): 1.0, (7, 6): 0.0, (8, 1): 0.0, (8, 6): 1.0}
    left_out = {tuple(r) for r in search.unfit_vectors(vectors, queries).collect()}
    assert left_out == {("query", 9), ("vector", 2), ("vector", 3), ("vector", 4), ("vector", 5)}
    many = search.semantic_topk(vectors, queries, k=1, max_queries=1).collect()
    assert {(r["query_id"], r["vec_id"]) for r in many} == {(7, 1), (8, 6)}
