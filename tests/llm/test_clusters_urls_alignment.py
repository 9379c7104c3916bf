"""Centroids, URL filters and token alignment against brute force on small rows."""

import collections
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postlens.llm import align, centroids, url_filter

BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

# ---- centroids ---------------------------------------------------------------------------------


def signs(size):
    """Rows of +1 and -1 in coarse-to-fine order, from their definition."""
    bits = size.bit_length() - 1
    reverse = lambda i: int(format(i, f"0{bits}b")[::-1], 2)
    return np.array([[(-1) ** (reverse(p) & j).bit_count() for j in range(size)] for p in range(size)])


def test_transform_is_that_of_its_definition():
    x = np.random.default_rng(1).integers(-centroids.LARGEST, centroids.LARGEST + 1, (50, 64))
    c = centroids.transform(x)
    assert (c == x @ signs(64).T).all() and (centroids.invert(c) == x).all() and (centroids.transform(c) == 64 * x).all()
    assert (c[:, 0] == x.sum(1)).all() and (c[:, 1] == x[:, :32].sum(1) - x[:, 32:].sum(1)).all()


@pytest.mark.parametrize("high", [2, 60, centroids.LARGEST])
def test_search_finds_the_nearest_and_the_smaller_number_of_equals(high):
    rng = np.random.default_rng(2)
    x, c = rng.integers(-high, high + 1, (300, 64)), rng.integers(-high, high + 1, (16, 64))
    c[5], c[9], x[:40] = c[2], c[2], c[2] + rng.integers(-1, 2, (40, 64))
    x = np.clip(x, -high, high)
    whole = ((x[:, None] - c[None]) ** 2).sum(2)
    number, distance = centroids.nearest(centroids.transform(x), centroids.transform(c))
    assert (number == whole.argmin(1)).all() and (distance == whole.min(1)).all()


def plain_clusters(rows, count=16, rounds=3):
    x = {i: [math.floor(64 * v) for v in vector] for i, vector in rows}
    near = lambda p, cs: min(range(len(cs)), key=lambda k: (sum((a - b) ** 2 for a, b in zip(p, cs[k])), k))
    cs = [x[i] for i in sorted(x, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:count]]
    for _ in range(rounds):
        mine = collections.defaultdict(list)
        for p in x.values():
            mine[near(p, cs)].append(p)
        cs = [[sum(v) // len(v) for v in zip(*mine[k])] if mine[k] else c for k, c in enumerate(cs)]
    of = {i: near(p, cs) for i, p in x.items()}
    far = {i: sum((a - b) ** 2 for a, b in zip(p, cs[of[i]])) for i, p in x.items()}
    per = collections.Counter()
    for i, d in far.items():
        per[of[i]] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return {(i, of[i], far[i], per[of[i]], sum(far.values()), sha[of[i]]) for i in x}


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("n", [0, 1, 9, 200])
def test_clustering(spark, n):
    rng = random.Random(n)
    rows = [(i, [rng.uniform(-3, 3) if i % 3 else float(i % 2) for _ in range(64)]) for i in range(n)]
    bad = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None] + [0.5] * 63), (905, [float("nan")] * 64), (906, [float("-inf")] * 64)]
    frame = spark.createDataFrame([(i, v, -1, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, cluster int, id string")
    got = centroids.clustering(frame.repartition(5)).select(*COLUMNS).collect()
    assert {tuple(r) for r in got} == plain_clusters(rows) and len(got) == n


def test_a_centroid_of_most_vectors_is_summed_in_the_tasks(spark):
    vectors = centroids.coefficients(spark.range(3000).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(0.25), 64).alias("embedding")))
    start = centroids.first_centroids(vectors)
    assert len(start) == 16 and (centroids.invert(start) == 16).all()
    rows, final = centroids.cluster(spark.range(3000).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(0.25), 64).alias("embedding")))
    assert rows.groupBy("cluster").count().collect() == [(0, 3000)] and (final == 16).all()
    plan = rows.groupBy("cluster").count()._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan  # reads the written table


# ---- urls --------------------------------------------------------------------------------------

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
URLS = [
    None, "", "no url", "http://", "http://a.org", "http://a.org/", "HTTP://A.ORG/x?y#z", "http://ORG/", "http://example.org/es", "http://x.y.example.org/es/",
    "http://notexample.org/es/1", "https://example.org/en/1", "https://m.example.org/en/12?q", "https://example.org/en/2", "ftp://a.com/fr/", "x://com/de/#f", "http://com/de",
    "http://bad.net/p/", "http://www.bad.net/p?x=1", "http://www.bad.net/p#top", "http://bad.net/P", "http://BAD.net", "http://bad.net/", "http://bad.net//", "http://É.org/é",
    "a://b://c.org/", "http://a.org./x", "http://a.com/fr/" + "z" * 100_000, "http://" + "a." * 5000 + "com/de/x", "http://u\n.org/\n", "http://a.org?x/y", "http://[::1]:80/x",
]


def plain_verdict(url, listed):
    if url is None or "://" not in url:
        return "", "", None, False, "allow"
    rest = url.split("://", 1)[1]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fit = [(len(r), r, v) for v, r in RULES if f".{host}".endswith("." + r.split("/")[0]) and path.startswith(r[r.index("/"):])]
    rule = max(fit, default=(0, None, None))
    found = host != "" and (host.removeprefix("www.") + path.rstrip("/")) in listed
    return host, path, rule[1], found, rule[2] or ("block" if found else "allow")


def url_rows(spark, copies=1):
    rows = [(i, u, "h", "k", None) for i, u in enumerate(URLS * copies)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, key string, row long")


@pytest.mark.parametrize("bound", [None, 0])
def test_urls_by_rules_and_list(spark, monkeypatch, bound):
    if bound is not None:  # the join by shuffled salts
        monkeypatch.setattr(url_filter, "broadcast_if_bounded", lambda d: d)
    listed = {"bad.net/p", "bad.net", "a.org/x"} | {f"other{i}.net/{i}" for i in range(2000)}
    rows = url_rows(spark, 3)
    frame = spark.createDataFrame([(u,) for u in listed] + [("bad.net/p",), (None,), ("",)], "url string")
    got = url_filter.judge(rows.repartition(4), url_filter.rule_table(spark, RULES), frame).collect()
    want = collections.Counter((i, *plain_verdict(u, listed)) for i, u in enumerate(URLS * 3))
    assert collections.Counter(tuple(r[c] for c in ("page_id", "host", "path", "rule", "listed", "verdict")) for r in got) == want
    kept = url_filter.drop_blocked(rows, url_filter.rule_table(spark, RULES), frame)
    assert kept.columns == rows.columns and {r["page_id"] for r in kept.collect()} == {w[0] for w in want if w[5] == "allow"}
    assert kept.where("host <> 'h' OR key <> 'k' OR row IS NOT NULL").count() == 0


def test_urls_without_rows_rules_or_list(spark):
    none, rules = spark.createDataFrame([], "url string"), url_filter.rule_table(spark, RULES)
    assert url_filter.judge(url_rows(spark).limit(0), rules, none).count() == 0
    got = url_filter.judge(url_rows(spark), rules.limit(0), none).collect()
    assert len(got) == len(URLS) and {(r["rule"], r["listed"], r["verdict"]) for r in got} == {(None, False, "allow")}
    tied = [("allow", "b.org/x"), ("block", "b.org/x"), ("allow", "a.b.org/"), ("block", "b.org/yz")]
    page = spark.createDataFrame([(1, "http://a.b.org/x"), (2, "http://a.b.org/yz"), (3, "http://a.b.org/q")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(page, url_filter.rule_table(spark, tied), none).collect()}
    assert got == {1: ("a.b.org/", "allow"), 2: ("a.b.org/", "allow"), 3: ("a.b.org/", "allow")}


def test_the_filter_passes_all_listed_and_few_others(spark):
    listed = spark.range(20_000).select(F.concat(F.lit("u"), F.col("id")).alias("key"))
    blocks, count = url_filter.bloom_filter(listed)
    assert count == 2048 and blocks.count() <= count
    asked = spark.range(60_000).select(F.concat(F.lit("u"), F.col("id")).alias("key"))
    passed = {r["key"] for r in url_filter.possible(asked, listed).collect()}
    assert {f"u{i}" for i in range(20_000)} <= passed and len(passed) < 20_400


def test_a_full_filter_changes_no_verdict(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 1)
    listed = spark.range(500).select(F.concat(F.lit("u"), F.col("id")).alias("key"))
    asked = spark.range(1500).select(F.concat(F.lit("u"), F.col("id")).alias("key"))
    assert url_filter.possible(asked, listed).count() == 1500 and url_filter.listed_hits(asked, listed).count() == 500


def test_url_plan_is_native(spark):
    rules, none = url_filter.rule_table(spark, RULES), spark.createDataFrame([("a.b/c",)], "url string")
    plan = url_filter.judge(url_rows(spark), rules, none)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# ---- alignment ---------------------------------------------------------------------------------

ODD = [
    None, "", " ", "  ", "one", " one", "one ", "a  b", "a b", "a\nb c\n\n d", "x\t y z", "Überzähligkeiten sind 12345 unverhältnismäßig!", "日本語 のテキスト  🧿🧿 é",
    "a ▁b", "▁", "<|endoftext|> x <s> </s> <0x41> <unk>", "\x00 \x01", "a\x1c b \x1cc", "a\x85 b\x85c d", "a　 b　c d", "can't won't 'tis ' s",
    "unbelievable " * 3000, "x" * 9000, "ab " * 2 + "word" * 40 + " tail", "one", "one", "e\u0301 \u200b z", "\ufeffbom \u2028line",
]


def plain_alignment(texts):
    a, b = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    back = {c: i for i, c in enumerate(align.byte_letters())}
    rows, holders = [], collections.Counter()
    for text in texts:
        found = ([], [])
        if text:
            x = a.encode(" " + text, add_special_tokens=False).ids
            y = b.encode(text)
            xs = [bytes(back[c] for c in a.id_to_token(i)) for i in x]
            ys = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
            if b"".join(xs) == b"".join(ys) == (" " + text).encode():
                found = (list(zip(x, np.cumsum([len(t) for t in xs]), [len(t) for t in xs])), list(zip(y, np.cumsum([len(t) for t in ys]), [len(t) for t in ys])))
        ends = sorted({e for _, e, _ in found[0]} & {e for _, e, _ in found[1]})
        groups, low = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, e, _ in side if low < e <= end) for side in found))
            low = end
        links, start = [], 0
        for i, e, n in found[0]:
            while found[1][start][1] <= e - n:
                start += 1
            k = start
            while k < len(found[1]) and found[1][k][1] - found[1][k][2] < e:
                links.append((i, found[1][k][0]))
                k += 1
        rows.append((len(found[0]), len(found[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        holders.update(set(links))
    best = collections.Counter()
    for (i, _), n in holders.items():
        best[i] = max(best[i], n)
    return [(na, nb, ng, len(ls), sum(holders[p] == best[p[0]] for p in ls), sum(holders[p] for p in ls), sha) for na, nb, ng, ls, sha in rows]


def test_gallop():
    rng = random.Random(4)
    for _ in range(300):
        long = sorted(rng.sample(range(400), rng.randint(1, 200)))
        short = sorted(rng.sample(range(400), rng.randint(0, 60)))
        assert align.gallop(np.array(short, np.int64), np.array(long)).tolist() == [sum(x < s for x in long) for s in short]


@pytest.mark.parametrize("part, frequent", [(align.PART, align.FREQUENT), (40, 3)])
def test_alignment(spark, monkeypatch, part, frequent):
    monkeypatch.setattr(align, "parts_of", lambda words, limit=part, real=align.parts_of: real(words, limit))
    monkeypatch.setattr(align, "PART", part)
    rng = random.Random(5)
    bits = ["the", "Ver", "ä", " ", "  ", "\n", "ing", "7", "日", "'s", "--", "of", " un", "believ", "able", ".", "é"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = [(i if i % 7 else None, t, "p", 1, 2) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, pair string, row int, n long").repartition(3)
    got = align.alignment(frame, BPE, MODEL, frequent=frequent).collect()
    want = collections.Counter((r[0], *w) for r, w in zip(rows, plain_alignment(texts)))
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert collections.Counter(tuple(r[c] for c in columns) for r in got) == want


def test_alignment_of_no_rows(spark):
    assert align.alignment(spark.createDataFrame([], "doc_id long, text string"), BPE, MODEL).count() == 0


def test_frequent_pairs_are_broadcast_and_the_others_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "the common start " + " ".join(f"w{i}x{k}" for k in range(30))) for i in range(60)], "doc_id long, text string")
    plan = align.alignment(docs, BPE, MODEL, frequent=10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftAnti") == 1 and "BroadcastHashJoin" in plan and "Cartesian" not in plan


def test_words_are_remembered_within_a_bound(monkeypatch):
    monkeypatch.setattr(align, "MEMO_BYTES", 2000)
    with open(BPE, encoding="utf-8") as a, open(MODEL, "rb") as b:
        pair = align.Pair(a.read(), b.read())
    for k in range(40):
        texts = [f"alpha{k} beta{k} {'long' * 50}", f"alpha{k}"]
        encoded = pair.encode([align.words_of(t) for t in texts])
        assert [len(e) for e in encoded] == [3, 1] and encoded[0][0] == encoded[1][0]
    assert len(pair.words) < 20 and "long" * 50 not in pair.words
