"""Benchmark decontamination as a prefix-filtered join (operator 8), in DataFrame functions only.

A benchmark item is a list of windows of ``window`` words.  A window is a set of
shingles at fixed offsets; all of them must stand in a document, at those
offsets, for the window to occur there.  So one shingle is a sufficient prefix:
the rarest of the window over all documents.  The join is on that shingle
alone; its position gives the only possible start (the positional bound), the
start must leave room for the window (the length bound), and the shingles that
cover the window, joined at their exact positions, verify it word by word.

The documents are read once: their shingles meet those of the benchmark, and
only matches go on.  Repeated rows are judged row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, broadcast_if_bounded, materialize

WINDOW = 10
SHINGLE = 5
#: What stands between words, once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-case words of ASCII letters, digits and other characters beyond ASCII; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def shingle(words: Column, start: Column, size: Column) -> Column:
    """``size`` words from ``start`` (from 1), joined by blanks; words hold none."""
    return F.array_join(F.slice(words, start, size), " ")


def windows_of(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Different windows: w (id), words, len; and which items hold them: (w, item)."""
    worded = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(
        F.size("words") > 0
    )
    length = F.least(F.lit(window), F.size("words"))
    return worded.select("item", length.alias("len"), "words").select(
        "item", "len", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("at"), "words"
    ).select("item", "len", F.slice("words", F.col("at"), F.col("len")).alias("words")).distinct()


def occurrences(
    docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, window: int, size: int
) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): row, doc_id and n_words of each document; row, start, len and item of each occurrence."""
    owned = materialize(windows_of(items, item_id, item_text, window), "bench-windows")
    unique = owned.select("words", "len").distinct()
    # the shingles of a window: offset from its start, the shingle's words
    short = F.least(F.lit(size), F.col("len"))
    tokens = materialize(
        unique.select(
            "words", "len", short.alias("size"), F.explode(F.sequence(F.lit(0), F.col("len") - short)).alias("offset")
        ).select("words", "len", "size", "offset", shingle(F.col("words"), F.col("offset") + 1, F.col("size")).alias("token")),
        "bench-tokens",
    )
    known = materialize(tokens.select("token", "size").distinct(), "bench-shingles")
    sizes = F.array(*[F.lit(r["size"]) for r in known.select("size").distinct().orderBy("size").collect()]).cast("array<int>")

    # one pass over the documents: a row each (place 0) and their shingles that the benchmark knows
    worded = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words")
    )
    placed = worded.select(
        "row", "doc_id", "words", F.explode(F.array_union(F.array(F.lit(0)), sizes)).alias("size")
    ).select(
        "row",
        "doc_id",
        F.size("words").alias("n_words"),
        "words",
        "size",
        F.explode(
            F.when(F.col("size") == 0, F.array(F.lit(0)))
            .when(F.size("words") >= F.col("size"), F.sequence(F.lit(1), F.size("words") - F.col("size") + 1))
            .otherwise(F.array().cast("array<int>"))
        ).alias("at"),
    )
    keyed = placed.select(
        "row",
        "doc_id",
        "n_words",
        "size",
        "at",
        F.when(F.col("at") > 0, shingle(F.col("words"), F.col("at"), F.col("size"))).alias("key"),
    )
    found = keyed.join(
        broadcast_if_bounded(known.select(F.col("token").alias("key"), F.lit(True).alias("hit"))), "key", "left"
    ).where((F.col("at") == 0) | F.col("hit"))
    matches = materialize(found.select("row", "doc_id", "n_words", "at", "key"), "shingle-matches")
    rows = matches.where("at = 0").select("row", "doc_id", "n_words")
    hits = matches.where("at > 0").select("row", "at", F.col("key").alias("token"), "n_words")

    # rarity over all documents; a window with a shingle that never occurs has rarity 0 and no candidate
    counts = materialize(hits.groupBy("token").agg(F.count("*").alias("n")), "shingle-counts")
    ranked = tokens.join(counts, "token", "left").groupBy("words", "len", "size").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("rarest")
    )
    prefix = materialize(
        ranked.where("rarest.n > 0").select(
            F.monotonically_increasing_id().alias("w"), "words", "len", "size", "rarest.token", "rarest.offset"
        ),
        "bench-prefixes",
    )
    start = F.col("at") - F.col("offset")
    candidates = (
        hits.join(broadcast_if_bounded(prefix.select("w", "len", "size", "token", "offset")), "token")
        .where((start >= 1) & (start + F.col("len") - 1 <= F.col("n_words")))
        .select("row", "w", "len", start.alias("start"))
    )
    # the shingles that cover a window: every size-th offset and the last
    cover = materialize(
        prefix.select(
            "w",
            F.explode(
                F.array_union(F.sequence(F.lit(0), F.col("len") - F.col("size"), F.col("size")), F.array(F.col("len") - F.col("size")))
            ).alias("offset"),
            "words",
            "size",
        ).select("w", "offset", shingle(F.col("words"), F.col("offset") + 1, F.col("size")).alias("token")),
        "bench-covers",
    )
    needed = cover.groupBy("w").agg(F.count("*").alias("parts"))
    asked = candidates.join(broadcast_if_bounded(cover), "w").select(
        "row", "w", "len", "start", (F.col("start") + F.col("offset")).alias("at"), "token"
    )
    verified = (
        asked.join(hits.select("row", "at", "token"), ["row", "at", "token"], "left_semi")
        .groupBy("row", "w", "len", "start")
        .agg(F.count("*").alias("parts"))
        .join(broadcast_if_bounded(materialize(needed, "bench-needed")), ["w", "parts"])
    )
    holders = materialize(prefix.select("w", "words", "len").join(owned, ["words", "len"]).select("w", "item"), "bench-holders")
    return rows, verified.join(broadcast_if_bounded(holders), "w").select("row", "start", "len", "item")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    size: int = SHINGLE,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids as sorted text) and contaminated, a row per row of ``docs``.

    A word inside any occurrence of a window is hit.  Null texts have no words;
    items without words have no window; an item without an id has windows that
    hit words but is not counted among the items.
    """
    rows, hits = occurrences(docs, items, doc_id, text, item_id, item_text, window, size)
    per_row = hits.groupBy("row").agg(
        F.size(
            F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1))))
        ).alias("n_hit"),
        F.sort_array(F.collect_set("item")).alias("items"),
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    found = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(per_row, "row", "left").select(
        F.col("doc_id").alias(doc_id),
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        found.alias("items"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, judged row by row whatever their ids.

    Null and empty texts stay, as do all rows where ``items`` has no words; the
    columns of ``docs`` come back as they are, whatever their names.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("r"), F.struct(*docs.columns).alias("doc")), "bench-rows")
    bad = contamination(rows.select("r", F.col(f"doc.`{text}`").alias("t")), items, "r", "t").where("contaminated").select("r")
    return rows.join(bad, "r", "left_anti").select("doc.*")
