"""ROUGE-1, ROUGE-2 and ROUGE-L of text pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.stem import stem_tokens
from ..session import materialize

#: Pairs that a task holds as Python objects at a time.
_SLICE_ROWS = 500


def tokens(text: Column, stem: bool = True) -> Column:
    """Lower-case runs of ASCII letters and digits, as stems if wanted."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    return stem_tokens(words) if stem else words


def _f(hits: Column, said: Column, real: Column) -> Column:
    # 2PR/(P+R) with P = hits/said and R = hits/real.
    p, r = hits / said, hits / real
    return F.when((said > 0) & (real > 0) & (hits > 0), 2 * p * r / (p + r)).otherwise(0.0)


def pair_tokens(df: DataFrame, id_col: str, prediction: str, reference: str, stem: bool) -> DataFrame:
    """id and the token arrays _said and _real of each pair; null texts have no tokens."""
    made = [tokens(F.coalesce(F.col(c), F.lit("")), stem).alias(n) for c, n in ((prediction, "_said"), (reference, "_real"))]
    return df.select(id_col, *made)


def _gram_scores(words: DataFrame, id_col: str, sizes: Sequence[int]) -> DataFrame:
    """id and rouge<n> for each of ``sizes`` from token arrays, a row per id.

    The pairs are partitioned and sorted by id once, as texts of blank-joined
    tokens, and read in that order: the n-grams of one id are counted at a time
    (those of all its pairs together), so n-grams are never shuffled and a task
    keeps no table of them.
    """
    placed = words.select(id_col, *[F.array_join(c, " ").alias(c) for c in ("_said", "_real")])
    placed = placed.repartition(id_col).sortWithinPartitions(id_col)
    sizes, slice_rows = tuple(sizes), _SLICE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(bags):
            return [x for a, b in bags for x in (sum((a & b).values()), a.total(), b.total())]

        def table(ids, numbers):
            columns = [pa.array(c, pa.int64()) for c in zip(*numbers)]
            return pa.RecordBatch.from_arrays([ids, *columns], names=[str(i) for i in range(1 + len(columns))])

        held, bags = None, None  # the id whose pairs are being read, as an array of one, and its bags
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(at, slice_rows)
                keys = batch.column(0).to_pylist()
                ended, numbers = [], []  # rows where an id ends before the row, and what was counted
                for i, (key, said, real) in enumerate(zip(keys, batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    last = (keys[i - 1] if i else held[0].as_py()) if bags else None
                    if bags and not (key == last or (key != key and last != last)):
                        ended.append(i)
                        numbers.append(counted(bags))
                        bags = None
                    if bags is None:
                        bags = [(Counter(), Counter()) for _ in sizes]
                    for side, text in enumerate((said, real)):
                        tokens = text.split()
                        for n, pair in zip(sizes, bags):
                            pair[side].update(tokens if n == 1 else zip(*(tokens[k:] for k in range(n))))
                if ended:
                    before = [] if ended[0] else [held]
                    ids = pa.concat_arrays([*before, batch.column(0).take(pa.array([i - 1 for i in ended if i], pa.int64()))])
                    yield table(ids, numbers)
                held = batch.column(0).slice(batch.num_rows - 1)
        if bags:
            yield table(held, [counted(bags)])

    facts = [f"{name}{n}" for n in sizes for name in ("hits", "said", "real")]
    schema = StructType([StructField("0", words.schema[id_col].dataType), *(StructField(str(i + 1), LongType()) for i in range(len(facts)))])
    sums = placed.mapInArrow(run, schema).toDF(id_col, *facts)
    return sums.select(id_col, *[_f(F.col(f"hits{n}"), F.col(f"said{n}"), F.col(f"real{n}")).alias(f"rouge{n}") for n in sizes])


def rouge_n(
    df: DataFrame,
    n: int,
    *,
    id_col: str = "pair_id",
    prediction: str = "prediction",
    reference: str = "reference",
    stem: bool = True,
) -> DataFrame:
    """F-measure of n-gram overlap per pair (n = 1 or 2)."""
    return _gram_scores(pair_tokens(df, id_col, prediction, reference, stem), id_col, (n,))


@F.pandas_udf(DoubleType())
def _lcs_length(said: pd.Series, real: pd.Series) -> pd.Series:
    """Length of the longest common subsequence, one numpy row per token."""

    def one(a, b):
        if len(a) == 0 or len(b) == 0:
            return 0.0
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
        short, long = sorted(([vocabulary[w] for w in s] for s in (a, b)), key=len)
        long = np.array(long)
        best = np.zeros(len(long) + 1, dtype=np.int64)
        for token in short:
            grown = np.where(long == token, best[:-1] + 1, best[1:])
            best[1:] = np.maximum.accumulate(grown)
        return float(best[-1])

    return pd.Series([one(a, b) for a, b in zip(said, real)], dtype="float64")


def _lcs_scores(words: DataFrame, id_col: str) -> DataFrame:
    scored = words.withColumn("_hits", _lcs_length("_said", "_real"))
    return scored.select(id_col, _f(F.col("_hits"), F.size("_said"), F.size("_real")).alias("rougeL"))


def rouge_l(
    df: DataFrame,
    *,
    id_col: str = "pair_id",
    prediction: str = "prediction",
    reference: str = "reference",
    stem: bool = True,
) -> DataFrame:
    """F-measure of the longest common subsequence per pair."""
    return _lcs_scores(pair_tokens(df, id_col, prediction, reference, stem), id_col)


def rouge_summary(
    df: DataFrame,
    *,
    id_col: str = "pair_id",
    prediction: str = "prediction",
    reference: str = "reference",
    stem: bool = True,
) -> DataFrame:
    """Mean ROUGE-1/2/L times 100, two decimals, and the number of pairs.

    Texts are cut into tokens, and these stemmed, once; the arrays are written
    and serve all three.
    """
    words = materialize(pair_tokens(df, id_col, prediction, reference, stem), "rouge-tokens")
    parts = _gram_scores(words, id_col, (1, 2)).join(_lcs_scores(words, id_col), id_col)
    mean = {c: F.round(F.coalesce(F.avg(c), F.lit(0.0)) * 100, 2).alias(c) for c in ("rouge1", "rouge2", "rougeL")}
    return parts.agg(*mean.values(), F.count("*").alias("sample_count"))
