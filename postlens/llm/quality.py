"""Quality rules as a short-circuit cascade (operator 5), in DataFrame functions only.

A rule is a Boolean column that is true where a text is to be rejected.  Their
cost and selectivity are measured on a sample; the cascade is a ``CASE`` that
asks the rule with most rejections per second first, so a rejected text costs
only the rules up to the one that rejects it.  The order never changes which
texts are kept, only the time and the name of the first rule that rejects.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, materialize

#: About so many rows cost and selectivity are measured on; they decide the order only.
SAMPLE_ROWS = 2_000


@dataclass(frozen=True)
class Rule:
    name: str
    reject: Column


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / self.seconds


def words_of(text: Column) -> Column:
    """The words (runs without white space) of a text; none for null."""
    cut = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.filter(cut, lambda w: w != "")


def symbols_in(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")).cast("long")


def full_lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def trigram_hashes(words: Column) -> Column:
    """A 64-bit hash per window of three words."""
    n = F.size(words)
    return F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def with_repeats(df: DataFrame, words: str, name: str) -> DataFrame:
    """Add how many words stand in a three-word window found twice or more in the text.

    Windows are compared by a 64-bit hash inside one text.  Only texts with a
    repeated window are sorted; the sort is by (hash, position), so the work
    is n log n for any text.
    """
    keep = df.columns
    h = df.select(*keep, trigram_hashes(F.col(words)).alias("_h"))
    s = h.select(
        *keep,
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        )
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        .alias("_s"),
    )
    twice = F.filter(
        "_s",
        lambda e, i: F.coalesce(F.get("_s", i - 1)["h"] == e["h"], F.lit(False))
        | F.coalesce(F.get("_s", i + 1)["h"] == e["h"], F.lit(False)),
    )
    p = s.select(*keep, F.sort_array(F.transform(twice, lambda e: e["i"])).alias("_p"))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end"))
    covered = F.aggregate(
        "_p",
        start,
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i + 3 - a["end"])).alias("n"), (i + 3).alias("end")),
    )
    return p.select(*keep, covered["n"].cast("long").alias(name))


def measured_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """Add words (array), n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Columns of ``df`` with these names are replaced.  A null text has no words
    and no lines.
    """
    made = ("words", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    keep = [c for c in df.columns if c not in made]
    first = df.select(*keep, words_of(F.col(text)).alias("words"), full_lines(F.col(text)).alias("_lines"))
    second = first.select(
        *keep,
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        symbols_in(F.col(text)).alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    return with_repeats(second, "words", "n_repeat_words")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def standard_rules(text: Column, words: Column) -> list[Rule]:
    """Rules of common web-text practice beyond the base rule, over a text and its words."""
    n = F.size(words)
    lines = full_lines(text)
    return [
        Rule("too long", n > 100_000),
        Rule("word length", ~F.length(F.array_join(words, "")).between(3 * n, 10 * n)),
        Rule("symbols", 10 * symbols_in(text) > n),
        Rule("repeated lines", 2 * (F.size(lines) - F.size(F.array_distinct(lines))) > F.size(lines)),
        Rule("few different words", 10 * F.size(F.array_distinct(words)) < n),
        Rule("words without letters", 10 * F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))) < 7 * n),
    ]


def measure_rules(df: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS, repeat: int = 2) -> list[Measured]:
    """Cost and selectivity of each rule on a sample, best rejection per second first.

    The sample, a share of the rows that follows from their number, is written
    once and read for every rule, so only the rule itself differs between the
    timed runs; the time of an empty rule is taken off.  An
    empty table leaves the order as it is.
    """
    sample = materialize(df.sample(min(1.0, rows / max(1, df.count())), seed=1).repartition(8), "quality-sample")

    def timed(column: Column) -> tuple[float, float]:
        best, share = float("inf"), 0.0
        for _ in range(repeat):
            began = time.perf_counter()
            share = sample.agg(F.avg(F.coalesce(column, F.lit(False)).cast("double")).alias("x")).first()["x"] or 0.0
            best = min(best, time.perf_counter() - began)
        return best, share

    idle, _ = timed(F.lit(False) & F.col(df.columns[0]).isNull())
    found = []
    for rule in rules:
        seconds, share = timed(rule.reject)
        found.append(Measured(rule, max(seconds - idle, 1e-4), share))
    return sorted(found, key=lambda m: -m.rank)


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, null where all pass; later rules aren't asked."""
    column = None
    for rule in rules:
        column = (F if column is None else column).when(rule.reject, F.lit(rule.name))
    return column.otherwise(F.lit(None).cast("string")) if column is not None else F.lit(None).cast("string")


def quality_report(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measured columns, base_failed, rejected_by and kept.

    Null and empty texts have no words, fail the base rule and are not kept;
    repeated rows are judged row by row.
    """
    full = measured_columns(df, text)
    rules = standard_rules(F.col(text), F.col("words"))
    order = [m.rule for m in measure_rules(df.select(text, words_of(F.col(text)).alias("words")), rules)]
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    drop = ("base_failed", "rejected_by", "kept")
    return (
        full.select(*[c for c in full.columns if c not in drop], failed.alias("base_failed"))
        .withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(order)))
        .withColumn("kept", F.col("rejected_by").isNull())
        .drop("words")
    )


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that no rule rejects, with the columns of ``df``."""
    judged = quality_report(df.select(F.struct(*df.columns).alias("_row"), F.col(text).alias("_text")), "_text")
    # a filter is not pushed below a generator, so the rules are not worked out once more inside it
    return judged.select("_row", F.explode(F.array("kept")).alias("_kept")).where("_kept").select("_row.*")
