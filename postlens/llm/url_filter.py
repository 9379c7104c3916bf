"""URL filters (operator 12), in DataFrame functions only.

Listed keys (rules and canonical URLs) go into a blocked Bloom filter: a row per
block of 256 bits, in which a key sets eight bits of one block.  A url's keys
probe it with one broadcast join on the block number; what passes meets the
list itself in an exact hash join, which removes false positives.  The filter
is sized from the list up to a fixed number of blocks, so it may always be
broadcast; beyond that more keys pass, and the exact join decides as before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower, broadcast_if_bounded, materialize

#: Keys per block of 256 bits: 16 bits a key.
KEYS_PER_BLOCK = 16
#: 8 MB of bits.
MAX_BLOCKS = 1 << 18
WORDS = 4
#: Parts that the rows of one key are dealt to where the list is too large to broadcast.
SALTS = 32
ALLOW, BLOCK = "allow", "block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and for text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.``, path without slashes at its end; scheme, query and fragment are gone."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def _places(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and the bits it sets in the block's words."""
    bits = F.xxhash64(key, F.lit(1))
    six = lambda i: F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), six(i))
    return F.xxhash64(key).bitwiseAND(F.lit(blocks - 1)), [one(i).bitwiseOR(one(WORDS + i)) for i in range(WORDS)]


def bloom_filter(listed: DataFrame, key: str = "key") -> tuple[DataFrame, int]:
    """(filter, blocks): block and words w0 to w3 of the blocks that hold a key of ``listed``, a written table."""
    wanted = listed.count() // KEYS_PER_BLOCK + 1
    blocks = min(MAX_BLOCKS, 1 << (wanted - 1).bit_length())
    block, masks = _places(F.col(key), blocks)
    placed = listed.select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
    return placed.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def possible(keys: DataFrame, listed: DataFrame, key: str = "key") -> DataFrame:
    """The rows of ``keys`` that the filter over ``listed`` lets pass: all listed ones and few others."""
    table, blocks = bloom_filter(listed, key)
    block, masks = _places(F.col(key), blocks)
    mine = F.struct(*[m.alias(f"m{i}") for i, m in enumerate(masks)])
    probed = keys.withColumns({"block": block, "_mine": mine}).join(F.broadcast(table), "block")
    hit = [F.col(f"w{i}").bitwiseAND(F.col(f"_mine.m{i}")) == F.col(f"_mine.m{i}") for i in range(WORDS)]
    return probed.where(hit[0] & hit[1] & hit[2] & hit[3]).select(*keys.columns)


def listed_hits(keys: DataFrame, listed: DataFrame, key: str = "key") -> DataFrame:
    """``keys`` joined with ``listed`` (a written table, one row a key): filter first, then the exact join.

    A list over the broadcast bound is dealt over the salts of its keys, so that
    a url which stands in very many rows is spread over tasks.
    """
    passed = possible(keys, listed, key)
    small = broadcast_if_bounded(listed)
    if small is not listed:
        return passed.join(small, key)
    salted = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mixed = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    return passed.withColumn("_salt", mixed).join(salted.hint("shuffle_merge"), [key, "_salt"]).drop("_salt")


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(host, path, verdict) of rules written like ``("block", "example.org/es/")``."""
    parts = [(r.split("/", 1)[0], "/" + r.split("/", 1)[1] if "/" in r else "", v) for v, r in rules]
    return spark.createDataFrame(parts, "host string, path string, verdict string")


def judge(
    pages: DataFrame,
    rules: DataFrame,
    listed: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    default: str = ALLOW,
) -> DataFrame:
    """page_id, host, path, rule, listed and verdict, a row per row of ``pages``.

    ``rules`` is (host, path, verdict): a rule fits its host and the hosts below
    it where the path starts with the rule's; the longest wins, of equally long
    ones that with the longer host, of repeated ones the one that blocks.
    ``listed`` has canonical URLs in a column ``url``; a url without a rule is
    blocked if its canonical form is listed, else gets ``default``.  Null urls
    and such without ``://`` have an empty host and path, no rule, and are not
    listed.  Rules have a bounded number of different shapes (labels of the
    host, length of the path); these alone pass through the driver.
    """
    host, path = host_and_path(pages[url].cast("string"))
    rows = materialize(
        pages.select(F.monotonically_increasing_id().alias("row"), pages[page_id].alias("id"), host.alias("host"), path.alias("path")),
        "urls",
    )
    named = rules.where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    ruled = named.select(
        F.concat(F.lit("r"), "host", "path").alias("key"),
        F.concat("host", "path").alias("rule"),
        F.length(F.concat("host", "path")).alias("size"),
        F.length("host").alias("host_size"),
        "verdict",
    )
    urls = listed.select(F.concat(F.lit("u"), F.col("url").cast("string")).alias("key")).where("key <> 'u'").distinct()
    absent = {"rule": "string", "size": "int", "host_size": "int", "verdict": "string"}
    keys = materialize(ruled.union(urls.select("key", *[F.lit(None).cast(t).alias(c) for c, t in absent.items()])), "listed-keys")

    found = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length")).distinct().collect()
    shapes = [F.struct(F.lit(s["labels"]).alias("labels"), F.lit(s["length"]).alias("length")) for s in found]
    fits = F.transform(
        F.array(*shapes) if shapes else F.array().cast("array<struct<labels:int,length:int>>"),
        lambda s: F.concat(F.lit("r"), _last_labels(F.col("host"), s["labels"]), F.substring("path", 1, s["length"])),
    )
    whole = F.array(F.concat(F.lit("u"), canonical(F.col("host"), F.col("path"))))
    asked = rows.where("host <> ''").select("row", F.explode(F.array_distinct(F.concat(fits, whole))).alias("key"))
    hits = listed_hits(asked, keys)
    per_row = hits.groupBy("row").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct("size", "host_size", "rule", "verdict"))).alias("best"),
        F.max(F.col("rule").isNull()).alias("listed"),
    )
    is_listed = F.coalesce("listed", F.lit(False))
    return rows.join(per_row, "row", "left").select(
        F.col("id").alias(page_id),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        is_listed.alias("listed"),
        F.coalesce("best.verdict", F.when(is_listed, BLOCK).otherwise(default)).alias("verdict"),
    )


def _last_labels(host: Column, labels: Column) -> Column:
    """The last ``labels`` labels of a host, all of it where it has fewer."""
    return F.call_function("substring_index", host, F.lit("."), -labels)


def drop_blocked(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """The rows of ``pages``, with all their columns, whose url is not blocked."""
    rows = materialize(pages.select(F.monotonically_increasing_id().alias("r"), F.struct(*pages.columns).alias("page")), "url-rows")
    verdicts = judge(rows.select("r", F.col(f"page.`{url}`").alias("u")), rules, listed, "r", "u")
    return rows.join(verdicts.where(F.col("verdict") == BLOCK).select("r"), "r", "left_anti").select("page.*")
