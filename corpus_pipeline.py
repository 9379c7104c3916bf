"""Documents to training rows: rules, near-dedup, repeats, decontamination, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from postlens.llm import decontaminate, pieces, quality, repeats, simhash
from postlens.llm.common import materialize, table

#: Words of a shingle and largest distance in bits of linked fingerprints.
WORDS, BITS = 3, 3
#: Fewest words of a passage that may not repeat.
PASSAGE = 51
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go, null and empty texts among them; repeated rows are judged alike."""
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose fingerprints (three-word shingles) are linked over at most three bits each, that with the smallest id stays.

    Ties go to the first row; rows without an id go before those with one.
    """
    return simhash.keep_one(docs, size=WORDS, radius=BITS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes and passages of over 50 words that stand at two places are cut out of the texts.

    Rows stay, with what is left of the text; null stays null.
    """
    cut = repeats.drop_repeats(docs, words=PASSAGE)
    return cut.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in cut.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go, row by row; an empty benchmark lets all pass."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids (end id last) and n_tokens; text is what the ids decode to, empty for null."""
    return pieces.encode_rows(docs, MODEL)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_ids", sentencepiece_ids),
]

#: Majority fingerprints, MD5-keyed spans and merges are not SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
