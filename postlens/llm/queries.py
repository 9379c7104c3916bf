"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import align, bytebpe, centroids, decontaminate, language, pieces, quality, quotes, repeats, simhash, toxicity, url_filter, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: Words per row, three-word windows found twice, lines with a word; the rules as plain predicates.
QUALITY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(list_distinct(w)) AS n_distinct,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_lettered
  FROM d LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_words > 100000
            OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words
            OR 2 * n_dup_lines > n_lines OR 10 * n_distinct < n_words OR 10 * n_lettered < 7 * n_words) AS kept
FROM m
"""


@query("op5_quality_rules", QUALITY_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: Windows of ten words of an item (fewer words: one window), found at any place of a document.
CONTAMINATION_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
hits AS (SELECT r, p.i, p.n, item FROM places p JOIN windows USING (n, t)),
covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""


@query("op8_decontamination", CONTAMINATION_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_suffix_array_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passages=51)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


#: The table with quotes added: of each message, by turn, all of the one before, its first line, or that and the one before it nested.
QUOTING_SQL = r"""
WITH RECURSIVE c AS (SELECT row_number() OVER () AS r, * FROM conversations),
b AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn),
q AS (SELECT c.r, c.conv_id, c.turn, c.role, CASE
    WHEN p.text IS NULL THEN c.text
    WHEN c.turn % 3 = 1 THEN '> ' || replace(p.text, chr(10), chr(10) || '> ') || chr(10) || chr(10) || c.text
    WHEN c.turn % 3 = 2 OR pp.text IS NULL THEN '> ' || string_split(p.text, chr(10))[1] || chr(10) || c.text
    ELSE '>> ' || string_split(pp.text, chr(10))[1] || chr(10) || '> ' || replace(p.text, chr(10), chr(10) || '> ') || chr(10) || c.text END AS text
  FROM c LEFT JOIN b AS p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 LEFT JOIN b AS pp ON pp.conv_id = c.conv_id AND pp.turn = c.turn - 2),
l0 AS (SELECT r, conv_id, turn, unnest(regexp_split_to_array(coalesce(text, ''), '\r?\n')) AS line, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\r?\n'), 1) AS pos FROM q),
l AS (SELECT *, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '^((?:[ \t]*>)+)', '') AS body FROM l0),
s AS (SELECT *, NOT regexp_matches(body, '\S') AS blank FROM l),
n0 AS (SELECT *, coalesce(lag(level) OVER w <> level OR lag(blank) OVER w, true) AS starts FROM s WINDOW w AS (PARTITION BY r ORDER BY pos)),
n AS (SELECT *, sum(starts::INT) OVER (PARTITION BY r ORDER BY pos) AS run FROM n0),
para AS (SELECT r, conv_id, turn, level, run, min(pos) AS pos, trim(regexp_replace(lower(string_agg(body, ' ' ORDER BY pos)), '\s+', ' ', 'g')) AS t
  FROM n WHERE NOT blank GROUP BY r, conv_id, turn, level, run),
whole AS (SELECT conv_id, turn, trim(regexp_replace(lower(string_agg(body, ' ' ORDER BY pos)), '\s+', ' ', 'g')) AS t FROM l WHERE level = 0 GROUP BY r, conv_id, turn),
orig AS (SELECT conv_id, t, min(turn) AS o FROM (SELECT conv_id, turn, t FROM para WHERE level = 0 UNION ALL SELECT * FROM whole) GROUP BY conv_id, t),
u0 AS (SELECT r, conv_id, turn, level, run, pos, unnest(list_distinct(list_concat([body], regexp_split_to_array(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))))) AS x FROM n WHERE NOT blank),
u AS (SELECT *, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) AS t FROM u0),
ku AS (SELECT conv_id, t, min(turn) AS o FROM u WHERE level = 0 AND t <> '' GROUP BY conv_id, t),
ex AS (SELECT p.*, CASE WHEN o.o < p.turn THEN o.o END AS o FROM para p LEFT JOIN orig o ON o.conv_id = p.conv_id AND o.t = p.t WHERE level > 0),
tr AS (SELECT u.r, u.run, arg_max(ku.o, (length(u.t), -u.pos, -ku.o)) AS o FROM u JOIN ku ON ku.conv_id = u.conv_id AND ku.t = u.t WHERE u.level > 0 AND ku.o < u.turn GROUP BY u.r, u.run),
li AS (SELECT ex.r, level, pos, coalesce(ex.o, tr.o) AS o FROM ex LEFT JOIN tr USING (r, run)),
per AS (SELECT r, count(*) AS n_quoted, count(o) AS n_linked, arg_min(o, (level, pos, o)) FILTER (o IS NOT NULL) AS reply_to FROM li GROUP BY r),
up AS (SELECT conv_id, turn, min(reply_to) AS up FROM q JOIN per USING (r) WHERE reply_to IS NOT NULL GROUP BY conv_id, turn),
chain AS (SELECT conv_id, turn, up, 1 AS hops FROM up UNION ALL SELECT chain.conv_id, chain.turn, up.up, hops + 1 FROM chain JOIN up ON up.conv_id = chain.conv_id AND up.turn = chain.up),
top AS (SELECT conv_id, turn, arg_max(up, hops) AS thread, max(hops) AS depth FROM chain GROUP BY conv_id, turn),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY pos) AS text FROM l WHERE level = 0 GROUP BY r)
SELECT q.conv_id, q.turn, q.role, CASE WHEN q.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, coalesce(n_quoted, 0)::BIGINT AS n_quoted, coalesce(n_linked, 0)::BIGINT AS n_linked,
  reply_to, coalesce(thread, q.turn) AS thread, coalesce(depth, 0)::BIGINT AS depth
FROM q LEFT JOIN per USING (r) LEFT JOIN kept USING (r) LEFT JOIN top ON top.conv_id = q.conv_id AND top.turn = q.turn
"""


def quoting(talk: DataFrame) -> DataFrame:
    """The messages of ``talk``, quoting those before them: whole, trimmed to a line, or nested."""
    by_turn = talk.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    before = [by_turn.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("text").alias(f"p{k}")) for k in (1, 2)]
    joined = talk.join(before[0], ["conv_id", "turn"], "left").join(before[1], ["conv_id", "turn"], "left")
    first_line = lambda c: F.get(F.split(c, "\n", -1), F.lit(0))
    whole = F.concat(F.lit("> "), F.replace("p1", F.lit("\n"), F.lit("\n> ")), F.lit("\n"))
    text = (
        F.when(F.col("p1").isNull(), F.col("text"))
        .when(F.col("turn") % 3 == 1, F.concat(whole, F.lit("\n"), "text"))
        .when((F.col("turn") % 3 == 2) | F.col("p2").isNull(), F.concat(F.lit("> "), first_line("p1"), F.lit("\n"), "text"))
        .otherwise(F.concat(F.lit(">> "), first_line("p2"), F.lit("\n"), whole, "text"))
    )
    return joined.select("conv_id", "turn", "role", text.alias("text"))


@query("op7_quotation_links", QUOTING_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table itself holds no quotes; its messages are given quotes of earlier ones first."""
    return quotes.link_quotes(quoting(table(spark, sf_dir, "conversations")))


#: SHA-1 in base32: the digits of the hexadecimal form as bits, five at a time.
CAPTURE_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
hashes AS (SELECT h, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || h[i])::INTEGER), 4, '0')), '') AS bits FROM (SELECT DISTINCT h FROM p)),
digests AS (SELECT h, array_to_string(list_transform(range(0, 32), lambda i:
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(1, 6), lambda k: bits[5 * i + k]::INTEGER * (2 ** (5 - k))::INTEGER))::INTEGER]), '') AS digest FROM hashes),
c AS (SELECT page_id, n, digest, max(page_id) OVER (PARTITION BY digest) AS last FROM p JOIN digests USING (h))
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM c
"""


@query("op10_warc_index", CAPTURE_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.captures(pages.select("url", "page_id"), warc.archive_pages(pages))


def _rounds_sql(rounds: int) -> str:
    """Assignments a0, a1, ... and centroids c1, c2, ... of the rounds."""
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
              SELECT v.r, c.k, list_sum(list_transform(range(1, 65), lambda j: (v.x[j] - c.x[j]) * (v.x[j] - c.x[j])))::BIGINT AS d
              FROM v, c{i} AS c) GROUP BY r)"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} AS c LEFT JOIN (
                  SELECT k, list(q ORDER BY j) AS x FROM (
                    SELECT k, j, ((sum(x[j]) - ((sum(x[j]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS q
                    FROM (SELECT a.k, v.x, unnest(range(1, 65)) AS j FROM a{i} AS a JOIN v USING (r)) GROUP BY k, j) GROUP BY k) AS m USING (k))"""
            )
    return ",\n".join(steps)


#: Whole distances to all centroids, three rounds of floored means.
CLUSTER_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, x FROM (
  SELECT sha256('1:' || vec_id::VARCHAR) AS h, x FROM v ORDER BY h LIMIT 16)),
{_rounds_sql(centroids.ROUNDS)}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} JOIN v USING (r) JOIN c{centroids.ROUNDS} AS c USING (k)
"""


@query("op11_centroid_clustering", CLUSTER_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustering(table(spark, sf_dir, "embeddings"))


URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Labels of hosts whose pages make up the list of blocked URLs.
LISTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
_LISTED_HOST = rf"(^|\.)({'|'.join(LISTED_LABELS)})(\.|$)"

#: Rules by comparison of whole hosts and paths, the list by an IN.
URL_SQL = rf"""
WITH u AS (
  SELECT row_number() OVER () AS r, page_id,
    coalesce(translate(regexp_extract(url, '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
canon AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS c FROM u),
rules(verdict, rule) AS (VALUES {", ".join(f"('{v}', '{r}')" for v, r in URL_RULES)}),
parts AS (SELECT *, regexp_extract(rule, '^[^/]*') AS rhost, regexp_extract(rule, '/.*$') AS rpath FROM rules),
best AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM u JOIN parts ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY r),
list AS (SELECT DISTINCT c FROM canon WHERE regexp_matches(host, '{_LISTED_HOST}') AND c <> '')
SELECT page_id, host, path, rule, host <> '' AND c IN (SELECT c FROM list) AS listed,
  coalesce(verdict, CASE WHEN host <> '' AND c IN (SELECT c FROM list) THEN 'block' ELSE 'allow' END) AS verdict
FROM canon LEFT JOIN best USING (r)
"""


@query("op12_url_filters", URL_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules first, then the canonical URLs of all pages on hosts with a listed label."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.host_and_path(pages["url"])
    listed = pages.where(host.rlike(_LISTED_HOST)).select(url_filter.canonical(host, path).alias("url"))
    return url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES), listed)


@query("op13_cross_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align.alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
