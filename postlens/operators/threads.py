"""Conversation threads: summaries and message pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import fixed
from ..functions import scoring
from ..functions.text import as_text, trim_space, truncate_chars

#: Stands for the rest of a turn that was cut.
_CUT = "x"


def thread_summaries(
    turns: DataFrame, *, thread_col: str = "conv_id", order_col: str = "turn", text_col: str = "text"
) -> DataFrame:
    """Extractive summary per thread, a thread being its non-blank turns in lines.

    Only the start of a thread reaches its summary.  Every turn adds at least
    two bytes (itself and the separator), so the first ``SUMMARY_MAX_BYTES``
    turns, and as many characters of each plus one, decide the result.  A turn
    that is cut ends in a mark that is not blank and lies beyond what a summary
    shows, so blanks before the cut are not trimmed and the thread counts as too
    long.  The turn limit is a window group limit that runs before the shuffle,
    so a thread of any length sends at most that many short rows per task.
    A thread of blank turns has the summary "".
    """
    need = fixed.SUMMARY_MAX_BYTES + 1
    whole = turns.select(
        thread_col, F.col(order_col).alias("_turn"), trim_space(as_text(F.col(text_col))).alias("_whole")
    )
    lines = whole.select(
        thread_col,
        "_turn",
        F.when(F.char_length("_whole") > need, F.concat(truncate_chars(F.col("_whole"), need), F.lit(_CUT)))
        .otherwise(F.col("_whole"))
        .alias("_line"),
    )
    by_turn = Window.partitionBy(thread_col).orderBy(F.col("_line") == "", "_turn")
    early = lines.withColumn("_rank", F.row_number().over(by_turn)).where(F.col("_rank") <= need)
    rows = F.array_sort(F.collect_list(F.when(F.col("_line") != "", F.struct("_turn", "_line"))))
    thread = F.array_join(F.transform(rows, lambda r: r["_line"]), "\n")
    grouped = early.groupBy(thread_col).agg(thread.alias("_thread"))
    return grouped.select(thread_col, scoring.summarize(F.col("_thread")).alias("summary"))


def message_pairs(
    turns: DataFrame,
    source: str,
    *,
    thread_col: str = "conv_id",
    order_col: str = "turn",
    text_col: str = "text",
    topic_col: str | None = "role",
) -> DataFrame:
    """(text, summary) pairs: each turn with the turn that answers it.

    An equi-join on (thread, turn + 1), so no thread has to fit in one task.
    """
    first = turns.select(
        thread_col,
        F.col(order_col).alias("turn"),
        F.col(text_col).alias("text"),
        (F.col(topic_col) if topic_col else F.lit("")).alias("topic"),
    )
    answer = turns.select(
        thread_col, (F.col(order_col) - 1).alias("turn"), F.col(text_col).alias("summary")
    )
    return first.join(answer, [thread_col, "turn"]).withColumn("source", F.lit(source))
