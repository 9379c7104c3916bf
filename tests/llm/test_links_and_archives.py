"""Near copies, repeats, contamination, quotes and archives against brute force on small rows."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from postlens.llm import decontaminate, quotes, repeats, simhash, suffixes, warc

SCHEMA = "doc_id long, text string, fp string, key string, row string, n_words long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "f", "k", None, -1) for i, t in rows], SCHEMA)


def plain_components(values):
    owner = list(range(len(values)))

    def root(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                owner[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(values))]


def test_tree_links_what_brute_force_links():
    rng = random.Random(1)
    for _ in range(30):
        values, seeds = [], [rng.getrandbits(64) for _ in range(4)]
        for _ in range(120):
            v = rng.choice(seeds)
            for _ in range(rng.randint(0, 5)):
                v ^= 1 << rng.randrange(64)
            values.append(v)
        values = list(dict.fromkeys(values))
        tree = simhash.Tree(3)
        for v in values:
            tree.add(v)
        assert [tree.root(i) for i in range(len(values))] == plain_components(values)


def test_components_of_a_long_chain(spark):
    chain = [(i + 1, i) for i in range(60)] + [(100, 101), (5, 5)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = ["w%d" % rng.randrange(500) for _ in range(400)]
    rows = [(i, None if i == 3 else "" if i == 4 else " \t ") for i in range(3, 6)] + [(9, "Alpha beta"), (8, "alpha\nBETA"), (None, "alpha beta")]
    for i in range(20, 60):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "new%d" % rng.randrange(99)
        rows.append((i, " ".join(words)))
    rows += [(20, rows[6][1]), (70, "solo " * 40_000)]
    df = frame(spark, rows)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=repr)

    def plain(text):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    values = [plain(t) for _, t in rows]
    roots = plain_components(values)
    least = {r: min((rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None), default=None) for r in set(roots)}
    assert got == sorted(((i, f"{v:016x}", least[r]) for (i, _), v, r in zip(rows, values, roots)), key=repr)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {3, 4, 5, None, *(v for k, v in least.items() if v not in (None, 3))}
    assert simhash.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_suffix_order_and_prefixes(monkeypatch):
    rng = random.Random(5)
    for _ in range(150):
        monkeypatch.setattr(suffixes, "FEW", rng.choice([1, 2, 24]))
        monkeypatch.setattr(suffixes, "BATCH", rng.choice([7, 64, 1 << 18]))
        base = [rng.randint(1, rng.choice([1, 2, 3, 30])) for _ in range(rng.randint(1, 120))]
        if rng.random() < 0.5:
            base = base + base[: rng.randint(0, len(base))] + base
        text, cap = [*base, 0], rng.choice([3, 7, 400])
        with suffixes.Folder() as folder:
            order, prefix = (np.array(x).tolist() for x in suffixes.suffix_order(np.array(text), folder, cap))
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order == want
        for k in range(1, len(want)):
            a, b, n = want[k - 1], want[k], 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert prefix[k] == min(n, cap)


def plain_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(d), sum(gone), runs, bytes(b for b, g in zip(d, gone) if not g)))
    return out


@pytest.mark.parametrize("length", [40, 57, 400])
def test_repeats(spark, length):
    rng = random.Random(length)
    stock = ["".join(rng.choice("abé ") for _ in range(rng.randint(length // 2, 2 * length))) for _ in range(8)]
    texts = [None, "", "short", "ab" * 900, "x" * (length + 3), "y" * length, "q" * (length - 1)]
    for _ in range(40):
        texts.append("".join(rng.choice(stock) if rng.random() < 0.5 else "".join(rng.choice("xyzü") for _ in range(60)) for _ in range(5)))
    texts += [texts[8], texts[8], texts[9][:-5] + "zzzzz", "abc" * 7000]
    df = frame(spark, list(enumerate(texts)))
    got = [
        (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
        for r in repeats.without_repeats(df, length=length).orderBy("doc_id").collect()
    ]
    assert got == plain_repeats(texts, length)


def test_dropped_repeats_are_text(spark):
    text = "é" * 500
    df = frame(spark, [(1, text), (2, "a" + text), (3, None)])
    got = {r["doc_id"]: r["text"] for r in repeats.drop_repeats(df).collect()}
    assert got == {1: "", 2: "a", 3: None} and repeats.drop_repeats(df).columns == df.columns
    assert repeats.without_repeats(frame(spark, []).limit(0)).count() == 0


def test_passages_are_counted_and_stay(spark):
    rng = random.Random(51)
    stock = [[rng.choice(["a", "bé", "w%d" % rng.randrange(300)]) for _ in range(rng.randint(40, 70))] for _ in range(6)]
    texts = [None, "", "one two", " ".join(stock[0]), "ab " * 200, "x y\tz " * 40]
    for i in range(30):
        words = ["u%d_%d" % (i, k) for k in range(60)]
        for _ in range(2):
            at, passage = rng.randrange(60), rng.choice(stock)
            words[at:at] = passage[: rng.randint(45, 70)]
        texts.append(rng.choice([" ", "\n", " \t"]).join(words))
    texts.append(texts[7])
    windows = collections.Counter(tuple(w[k : k + 51]) for w in ((t or "").encode().split() for t in texts) for k in range(len(w) - 50))
    want = []
    for w in ((t or "").encode().split() for t in texts):
        want.append(len({k + j for k in range(len(w) - 50) if windows[tuple(w[k : k + 51])] > 1 for j in range(51)}))
    got = repeats.without_repeats(frame(spark, enumerate(texts)), passages=51).orderBy("doc_id").collect()
    assert [r["n_passage_words"] for r in got] == want
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got] == plain_repeats(texts, 400)
    assert any(r["n_passage_words"] and not r["n_removed"] for r in got)


@pytest.mark.parametrize("unit", [1, repeats.CODE])
def test_segments_hold_each_start_once(monkeypatch, unit):
    monkeypatch.setattr(repeats, "PLACE", 6)
    rng = random.Random(unit)
    data = b"".join(rng.choice([b"abcd", b"bcda", b"zzzz", b"%04d" % rng.randrange(9999)]) for _ in range(400)) + b"abcdbcda" * 60
    hashes = {}
    m, first, last, at, moves = (x.tolist() for x in repeats.segments(data, 80, unit))
    assert [a for a, b in zip(first, last) for a in range(a, b + unit, unit)] == list(range(0, len(data) - 79, unit))
    for x, a, b, place in zip(m, first, last, at):
        assert a <= place <= a + 80 - repeats.GRAM
        for start in range(a, b + unit, unit):
            assert hashes.setdefault(data[start : start + 80], x) == x
    assert any(moves) and not all(moves)


def test_words_have_codes_of_their_own():
    rng = random.Random(8)
    for size in (1, 7, 1 << 16):
        coder, codes = repeats.WordCodes(size), {}
        for _ in range(40):
            data = "".join(rng.choice(["a", "b", "é", "\x00", " ", "\n", "\t ", "\x0b", "\x0c", "\r", "\xa0", "long" * 9]) for _ in range(rng.randint(0, 90))).encode()
            got = coder.codes(data).tolist()
            assert len(got) == len(data.split()) and all(codes.setdefault(w, c) == c > 0 for w, c in zip(data.split(), got))
        assert len(set(codes.values())) == len(codes) > 50


def test_a_text_is_cut_by_one_worker_and_shuffled_once(spark):
    text = " ".join(f"w{i}" for i in range(300))
    df = frame(spark, [(1, text), (2, "é" + text), (3, None), (4, "alone")])
    df = df.select("doc_id", "text", F.lit("mine").alias("n_spans"), F.col("doc_id").alias("a b"))
    found = repeats.drop_repeats(df, words=51)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 3  # the bitmap in front of the shuffle and beside it, the cut behind
    assert found.columns == df.columns
    assert {tuple(r) for r in found.collect()} == {(1, "", 1, 1), (2, "é", 1, 2), (3, None, 0, 3), (4, "alone", 0, 4)}


def test_what_is_left_of_a_text():
    data = b"  ab  cd ef gh"
    assert repeats.left_of(data, [], []) == (data, 0, 0)
    assert repeats.left_of(data, [(0, 2), (2, 4), (1, 3)], []) == (b"  cd ef gh", 4, 1)
    assert repeats.left_of(data, [(12, 14)], [(0, 2), (1, 2)]) == (b"   ef ", 8, 2)


def plain_contamination(docs, items, window=10):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    windows = [
        (str(i), w[k : k + min(window, len(w))]) for i, t in items for w in [cut(t)] if w for k in range(max(1, len(w) - window + 1))
    ]
    out = []
    for doc_id, text in docs:
        words, hit, found = cut(text), set(), set()
        for item, win in windows:
            for k in range(len(words) - len(win) + 1):
                if words[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(item)
        out.append((doc_id, len(words), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def test_contamination(spark):
    rng = random.Random(7)
    vocab = ["a", "b", "c", "Dé", "é", "7"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 4, 5, 9, 10, 11, 25])))) for i in range(25)]
    items = [(i, t if len(t.split()) > 3 else "z" + t) for i, t in items] + [(99, None), (100, ""), (5, "Unique one item here")]
    docs = [(1, None), (2, ""), (3, "...")]
    for i in range(10, 60):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            words[5:5] = (rng.choice(items)[1] or "").split()
        docs.append((i, rng.choice([" ", "-", "  \n"]).join(words)))
    docs += [docs[-1], (None, items[0][1]), (70, "a b " * 20_000)]
    items = [(i, t) for i, t in items]
    got = decontaminate.contamination(
        frame(spark, docs[:-1]), spark.createDataFrame(items, "item_id long, text string")
    ).select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_contamination(docs[:-1], items)
    clean = decontaminate.drop_contaminated(frame(spark, docs[:9]), spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == frame(spark, docs[:1]).columns
    none = decontaminate.contamination(frame(spark, docs[-1:]), spark.createDataFrame([], "item_id long, text string")).collect()
    assert [(r["n_words"], r["contaminated"]) for r in none] == [(40_000, False)]
    assert decontaminate.contamination(frame(spark, []).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_quotation_links(spark):
    talk = [
        (1, 0, "user", "Hello there.\n\nSecond  paragraph\nover two lines"),
        (1, 1, "assistant", "> hello   THERE.\nAnswer one"),
        (1, 2, "user", "> > Hello there.\n> Answer one\n\nThanks"),
        (1, 3, "user", "> Second paragraph\n> over two lines\n> unknown words\nhm"),
        (1, 4, "user", "> not said by anyone\nfine"),
        (2, 0, "user", "> Hello there.\nother talk"),
        (2, 1, "user", None),
        (None, 1, "user", "> Hello there."),
        (2, None, "user", "> other talk"),
        (1, 4, "user", "> not said by anyone\nfine"),
    ]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in quotes.link_quotes(df).collect()), key=repr)
    want = [
        (1, 0, "user", talk[0][3], 0, 0, None, 0, 0),
        (1, 1, "assistant", "Answer one", 1, 1, 0, 0, 1),
        (1, 2, "user", "\nThanks", 2, 2, 1, 0, 2),
        (1, 3, "user", "hm", 1, 1, 0, 0, 1),  # a trimmed quote: two of its lines are known
        (1, 4, "user", "fine", 1, 0, None, 4, 0),
        (1, 4, "user", "fine", 1, 0, None, 4, 0),
        (2, 0, "user", "other talk", 1, 0, None, 0, 0),
        (2, 1, "user", None, 0, 0, None, 1, 0),
        (None, 1, "user", "", 0, 0, None, 1, 0),
        (2, None, "user", "", 0, 0, None, None, 0),
    ]
    assert got == sorted(want, key=repr)
    trimmed = [
        (1, 0, "a", "One thing. Another thing here!\nA longer line of its own"),
        (1, 1, "b", "One thing. Yes?\nmore"),
        (1, 2, "a", "> one  THING.\n\n> Another thing here!\nok"),
        (1, 3, "a", "> Yes? and what not\n> a longer line of its own\nok"),
        (2, 1, "a", "> A longer line of its own\nno"),
    ]
    found = quotes.link_quotes(spark.createDataFrame(trimmed, df.schema)).collect()
    assert {(r["conv_id"], r["turn"]): (r["n_quoted"], r["n_linked"], r["reply_to"]) for r in found} == {
        (1, 0): (0, 0, None), (1, 1): (0, 0, None), (1, 2): (2, 2, 0), (1, 3): (1, 1, 0), (2, 1): (1, 0, None),
    }
    long = [(1, i, "user", f"message number {i}\n> message number {i - 1}") for i in range(40)]
    deep = {r["turn"]: (r["thread"], r["depth"]) for r in quotes.link_quotes(spark.createDataFrame(long, df.schema)).collect()}
    assert deep == {i: (0, i) for i in range(40)}
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_archives(spark):
    pages = [(1, "http://b.example.com/x?q=1", "<p>é</p>"), (2, "http://a.example.com:81/ y", "same"), (3, "not a url", "same"), (4, None, None)]
    pages += [(5, "http://[bad", ""), (6, "http://a.example.com/", "same"), (6, "http://a.example.com/", "same"), (None, "http://n.example/", "same")]
    pages += [(7, "http://a.example.com/long", "z\r\n\r\n" * 90_000)] + [(i, "http://hot.example/", f"page {i % 7}") for i in range(10, 60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    archive = warc.archive_pages(df)
    got = sorted((tuple(r) for r in warc.captures(df, archive).collect()), key=repr)
    most = collections.defaultdict(int)
    for i, _, h in pages:
        most[h or ""] = max(most[h or ""], i or 0)
    want = []
    for i, _, h in pages:
        data, target = (h or "").encode(), most[h or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), digest, *(("response", None) if i == target else ("revisit", target))))
    assert got == sorted(want, key=repr)
    one = warc.lookup(spark, archive, "http://HOT.example/", 12).collect()
    assert [(r["page_id"], r["record_type"]) for r in one] == [(12, "revisit")]
    assert warc.lookup(spark, archive, "http://none.example/", 12).count() == 0
    assert warc.url_key("https://www.Example.com/a?b#c") == "com,example,www)/a?b"
    nothing = df.limit(0)
    assert warc.captures(df, warc.archive_pages(nothing)).count() == 0
    lone = warc.with_record_type(df, least_bytes=5).where(F.col("refers_to").isNotNull() & (F.octet_length("payload") < 5))
    assert lone.count() == 0


def test_long_periodic_texts_are_shortened_and_found_whole(spark):
    rng = random.Random(21)
    texts = ["a" * 1_000_000, "q" * 450 + "".join(rng.choice("bcd") for _ in range(300)), "ab" * 60_000 + "tail" + "ab" * 900, "so it goes " * 30_000 + "x", "z" * 400, "z" * 399]
    rows = {r["doc_id"]: r for r in repeats.without_repeats(frame(spark, enumerate(texts))).collect()}
    assert [rows[i]["n_removed"] for i in range(6)] == [1_000_000, 450, 121_800, 330_000, 0, 0]
    assert [bytes(rows[i]["kept"]).decode() for i in (0, 2, 3)] == ["", "tail", "x"]


def test_shortened_data_repeats_where_the_whole_does():
    rng = random.Random(22)
    for _ in range(200):
        length = rng.choice([32, 40, 70])
        data = b"".join(
            bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))) * rng.randint(1, 60) + bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 20)))
            for _ in range(rng.randint(1, 4))
        )

        def spans(x):
            held = collections.Counter(x[i : i + length] for i in range(len(x) - length + 1))
            hit = np.array([False, *(held[x[i : i + length]] > 1 for i in range(len(x) - length + 1)), False])
            edge = np.flatnonzero(hit[1:] != hit[:-1])
            return edge[::2], edge[1::2] - 1 + length

        short, cuts = repeats.shortened(np.frombuffer(data, np.uint8), length)
        start, end = spans(short.tobytes())
        got = zip(repeats.unshortened(start, cuts, "right").tolist(), repeats.unshortened(end, cuts, "left").tolist())
        assert list(got) == list(zip(*(x.tolist() for x in spans(data))))
