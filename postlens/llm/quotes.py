"""Quotation linking of conversations (operator 7).

A line's quote level is the number of ``>`` signs in front of it.  Neighbouring
lines of one level are a passage, which blank lines cut into paragraphs.  A
quoted paragraph is normalised (lower case, white space as single blanks) and
hashed; the message of the same conversation that wrote the same paragraph, or
a whole text of it, first and earlier is its original.  A quote that was trimmed
has neither; its lines and sentences are looked up then, and the longest that a
message wrote earlier names the original.  A message replies to the original of
its outermost quote, the first that has one.

Threads follow from the replies: each message points to its parent, and the
pointers are doubled until they reach the first message.  Parents stand before
replies, so the order (thread, turn) is a reply order.

Only one original is kept per conversation and hash, so a phrase that every
message repeats makes one row and no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize

MARKS = r"^((?:[ \t]*>)+)"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def lines_of(messages: DataFrame) -> DataFrame:
    """row, conv_id, turn, at, level and body of each line."""
    split = messages.select("row", "conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n", -1)).alias("at", "line"))
    marks = F.regexp_extract("line", MARKS, 1)
    body = F.regexp_replace("line", MARKS, "")
    return split.select(
        "row", "conv_id", "turn", "at", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), body.alias("body")
    )


def in_paragraphs(lines: DataFrame) -> DataFrame:
    """``lines`` that are not blank, with run: the number of their paragraph, lines of one level without a blank line."""
    order = Window.partitionBy("row").orderBy("at")
    blank = ~F.col("body").rlike(r"\S")
    before = F.lag(F.struct(F.col("level").alias("level"), blank.alias("blank"))).over(order)
    starts = F.coalesce((before["level"] != F.col("level")) | before["blank"], F.lit(True))
    return lines.withColumn("_starts", starts).withColumn("run", F.sum(F.col("_starts").cast("int")).over(order)).where(~blank).drop("_starts")


def paragraphs(numbered: DataFrame) -> DataFrame:
    """row, conv_id, turn, level, run, at (first line) and hash of each paragraph."""
    joined = numbered.groupBy("row", "conv_id", "turn", "level", "run").agg(
        F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "body"))).alias("parts")
    )
    text = normalised(F.array_join(F.transform("parts", lambda p: p["body"]), " "))
    return joined.select("row", "conv_id", "turn", "level", "run", "at", F.sha2(text, 256).alias("hash"))


def units(numbered: DataFrame) -> DataFrame:
    """row, conv_id, turn, level, run, at, size and hash of every line and every sentence of a line."""
    sentences = F.split("body", r"(?<=[.!?])\s+")
    each = numbered.select("row", "conv_id", "turn", "level", "run", "at", F.explode(F.array_distinct(F.concat(F.array("body"), sentences))).alias("unit"))
    text = each.withColumn("unit", normalised(F.col("unit"))).where("unit <> ''")
    return text.select("row", "conv_id", "turn", "level", "run", "at", F.length("unit").alias("size"), F.sha2("unit", 256).alias("hash"))


def trimmed_originals(numbered: DataFrame, open_: DataFrame) -> DataFrame:
    """row, run and original of the quoted paragraphs ``open_`` (row, run) of which an earlier message wrote a line or sentence.

    The longest unit decides, of equally long ones the first.
    """
    known = units(numbered.where("level = 0")).groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    asked = units(numbered.where("level > 0").join(open_, ["row", "run"], "left_semi"))
    found = asked.join(known, ["conv_id", "hash"]).where("original < turn")
    best = F.max_by("original", F.struct(F.col("size"), (-F.col("at")).alias("first"), (-F.col("original")).alias("early")))
    return found.groupBy("row", "run").agg(best.alias("trimmed"))


def link_quotes(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quoted, n_linked, reply_to, thread and depth, a row per row.

    ``n_quoted`` counts quoted paragraphs and ``n_linked`` those with an
    original, whole or trimmed.  ``reply_to`` is the turn of the message replied to, null for none;
    ``thread`` the turn of the first message of the chain of replies and
    ``depth`` the number of replies on the way.  Null texts have no lines and
    stay null; messages without conv_id or turn are neither linked nor linked
    to; rows that repeat conv_id and turn are one message in links and keep a
    row each.
    """
    rows = materialize(
        conversations.select(F.monotonically_increasing_id().alias("row"), "conv_id", "turn", "role", F.col("text").cast("string").alias("text")),
        "messages",
    )
    quoting = rows.where(F.col("text").rlike("(?m)" + MARKS))
    known = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    # conversations with a quote; the others have nothing to link
    talked = materialize(quoting.select("conv_id").where(F.col("conv_id").isNotNull()).distinct(), "quoting")
    lines = materialize(lines_of(known.join(talked, "conv_id", "left_semi")), "message-lines")
    numbered = materialize(in_paragraphs(lines), "paragraph-lines")
    parts = materialize(paragraphs(numbered), "paragraphs")
    own = lines.where("level = 0").groupBy("row", "conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("at", "body"))).alias("parts"))
    whole = own.select("conv_id", "turn", F.sha2(normalised(F.array_join(F.transform("parts", lambda p: p["body"]), " ")), 256).alias("hash"))
    first = (
        parts.where("level = 0").select("conv_id", "turn", "hash").unionAll(whole).groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    )
    quoted = parts.where("level > 0")
    exact = materialize(
        quoted.join(first, ["conv_id", "hash"], "left").select(
            "row", "run", "level", "at", F.when(F.col("original") < F.col("turn"), F.col("original")).alias("original")
        ),
        "quoted-paragraphs",
    )
    trimmed = trimmed_originals(numbered, exact.where("original IS NULL").select("row", "run"))
    linked = exact.join(trimmed, ["row", "run"], "left").withColumn("original", F.coalesce("original", "trimmed"))
    per_row = linked.groupBy("row").agg(
        F.count("*").alias("n_quoted"),
        F.count("original").alias("n_linked"),
        F.min(F.when(F.col("original").isNotNull(), F.struct("level", "at", "original")))["original"].alias("reply_to"),
    )
    per_row = materialize(per_row, "replies")
    replies = known.join(per_row.where("reply_to IS NOT NULL"), "row").groupBy("conv_id", "turn").agg(F.min("reply_to").alias("up"))
    chain = materialize(replies.select("conv_id", "turn", "up", F.lit(1).alias("hops")), "chains")
    while True:
        above = chain.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("hops").alias("more"))
        longer = chain.join(above, ["conv_id", "up"], "left")
        if not longer.where("next IS NOT NULL").limit(1).count():
            break
        chain = materialize(
            longer.select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")),
            "chains",
        )
    kept = F.filter(F.split("text", "\r?\n", -1), lambda line: ~line.rlike(MARKS))
    return (
        rows.join(per_row, "row", "left")
        .join(chain, ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            "role",
            F.array_join(kept, "\n").alias("text"),
            F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            "reply_to",
            F.coalesce("up", "turn").alias("thread"),
            F.coalesce("hops", F.lit(0)).cast("long").alias("depth"),
        )
    )
