"""Tokens, rules, language and toxicity against the libraries, brute force and held-out rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postlens.llm import bytebpe, language, pieces, quality, toxicity

MODEL, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, words string, kept string"

ODD = [
    (1, None, "en", "w", "k"),
    (2, "", None, "w", "k"),
    (3, "   ", "en", None, "k"),
    (4, "one", "en", "w", None),
    (4, "one", "en", "w", "k"),
    (None, "a\tb\n\nc  d ", "de", "w", "k"),
    (6, "é ß 日本 \U0001f9ff   \x00", None, "w", "k"),
    (7, "word " * 30_000, "en", "w", "k"),
    (8, "x" * 60_000, "en", "w", "k"),
    (9, "▁▁a ▁ <s></s><|endoftext|> <0x41>", "en", "w", "k"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(df, rows, *columns):
    """Collected rows next to the inputs they belong to, both in a fixed order."""
    got = sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=repr)
    return got, rows


def test_long_runs_are_summed_over_all_segmentations():
    rng, names = random.Random(8), vocabulary_sample()
    model = language.Languages(["a", "b"], names, np.array([[rng.randint(0, 9), rng.randint(0, 9)] for _ in names], float))
    scorer = language.Scorer(model)
    for n in (40, 64, 65, 130, 700):
        part = "▁" + "".join(rng.choice(["abc", "de", "a", "b", "ü"]) for _ in range(n))
        for k in range(2):  # exact, with logarithms at each place
            logs = [0.0]
            for e in range(1, len(part) + 1):
                ways = [logs[e - len(p)] + math.log(model.share[i, k]) for i, p in enumerate(names) if part.endswith(p, 0, e)]
                most = max(ways, default=logs[-1] + math.log(language.NO_PIECE))
                logs.append(most + math.log(sum(math.exp(w - most) for w in ways)) if ways else most)
            assert scorer.forward([part, "▁a"])[0, k] == pytest.approx(logs[-1], rel=1e-9)


def vocabulary_sample():
    return ["▁", "▁a", "▁abc", "a", "b", "c", "ab", "abc", "bc", "d", "de", "e", "cde", "abcde", "deab"]


def test_only_letters_make_a_language(spark):
    rows = [(i, t, lang, None, None) for i, (t, lang) in enumerate([("½ ② ①", "en"), ("12 ²", None), ("one two three", "en"), ("eins zwei drei", "de")] * 6)]
    got = language.language_id(spark.createDataFrame(rows, SCHEMA), MODEL).collect()
    assert all((r["lang_pred"] == "und") == (r["doc_id"] % 4 < 2) and (r["lang_pred"] != "und" or r["score"] == 0) for r in got)
    assert all(r["lang_pred"] == ("en" if r["doc_id"] % 4 == 2 else "de") for r in got if r["doc_id"] % 4 > 1)


def test_pieces_equal_the_library_on_random_strings():
    encoder = pieces.Encoder(pieces.PieceModel(MODEL))
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "the", "ing", "é", "日", "1", "</s>", "\xa0", "　", "A", "==", "\x00", "▁", "pre", "sent"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 3000, " " * 300 + "x", "#" * 77, "".join(rng.choice("abcdetionr") for _ in range(9000))]
    for text, want in zip(texts, sp.encode(texts, num_threads=1)):
        got = encoder.encode(text)
        assert [int(i) for i in got.split()] == want
        assert encoder.decode(" ".join(map(str, [*want, 2]))) == sp.decode([*want, 2])
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), 0, 1, 2]) for _ in range(9)]
        assert encoder.decode(" ".join(map(str, ids))) == sp.decode(ids)


def test_letters_are_encoded_once_whatever_stands_behind_them(monkeypatch):
    model = pieces.PieceModel(MODEL)
    encoder, letters = pieces.Encoder(model), re.compile(f"[{model.letters}]")
    inside = [piece.lstrip("▁") for piece in model.scores]
    assert not any(bool(letters.match(a)) != bool(letters.match(b)) for p in inside for a, b in zip(p, p[1:]))
    seen, chunk = [], encoder.chunk
    monkeypatch.setattr(encoder, "chunk", lambda text: seen.append(text) or chunk(text))
    words = ["trelleaux", "thoneawh", "Enungen"]
    text = " ".join(f"{w}{end}" for w in words for end in ["", ".", ",", "!!", ".\nthe", "\n" + w])
    want = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text)
    assert encoder.encode(text) == " ".join(map(str, want))
    assert sorted(t for t in seen if t.lstrip("▁") in words) == sorted(["▁" + w for w in words] + words)
    assert len(seen) == len(set(seen)) == 12


def test_round_trip_of_odd_rows(odd, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for doc_id, text, *_ in ODD:
        ids = sp.encode(text or "", add_eos=True)
        want.append(
            (
                doc_id,
                len(ids),
                hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(sp.decode(ids).encode()).hexdigest(),
            )
        )
    got = [tuple(r)[:4] for r in pieces.round_trip(odd, MODEL).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert pieces.round_trip(empty, MODEL).count() == 0
    coded = pieces.encode(odd.where("doc_id = 6"), MODEL)
    assert pieces.decode(coded, MODEL).first()["text"] == ODD[6][1]


def test_encode_rows_keeps_the_other_columns(odd):
    rows = {r["doc_id"]: r for r in pieces.encode_rows(odd.where("doc_id in (4, 6, 1)"), MODEL).collect()}
    assert rows[6]["text"] == ODD[6][1] and rows[6]["ids"][-1] == 2 and rows[6]["n_tokens"] == len(rows[6]["ids"])
    assert rows[1]["ids"] == [2] and rows[4]["lang"] == "en"


def test_token_counts_equal_the_library(odd, empty):
    library = Tokenizer.from_file(BPE)
    want = [
        (i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, *_ in ODD
    ]
    assert sorted(map(tuple, bytebpe.token_counts(odd, BPE).collect()), key=repr) == sorted(want, key=repr)
    assert bytebpe.token_counts(empty, BPE).count() == 0


def test_token_counts_of_random_strings():
    count = bytebpe.ByteVocabulary(open(BPE, encoding="utf-8").read()).counter()
    library, rng = Tokenizer.from_file(BPE), random.Random(4)
    parts = [" ", "  ", "\n", "the", "é", "日", "23", "'s", "'ll", "!!", "<|endoftext|>", "\xa0", "　", "xyz", "\x1c", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["ab" * 4000, "." * 500]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert count(text) == len(want.ids), text


def plain_quality(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(hit),
        len(words) < 50 or 100 * len(hit) > 50 * len(words),
    )


def test_quality_measures_and_order(spark, odd, empty):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 60))) + rng.choice(["", "\n\n a\n a\nb#"]) for _ in range(60)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [r for r in ODD if len(r[1] or "") < 1000]
    df = spark.createDataFrame(rows, SCHEMA)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = sorted((tuple(r[c] for c in ("doc_id", *names)) for r in quality.quality_report(df).collect()), key=repr)
    assert got == sorted(((i, *plain_quality(t)) for i, t, *_ in rows), key=repr)
    assert quality.quality_report(empty).count() == 0
    long = quality.quality_report(odd.where("doc_id in (7, 8)")).orderBy("doc_id").collect()
    assert [r["n_words"] for r in long] == [30_000, 1] and not any(r["kept"] for r in long)
    # the order changes neither the verdicts nor the rows
    rules = quality.standard_rules(F.col("text"), quality.words_of(F.col("text")))
    there = df.select(quality.cascade(rules).isNull().alias("k"))
    back = df.select(quality.cascade(rules[::-1]).isNull().alias("k"))
    assert there.collect() == back.collect()
    ranks = [m.rank for m in quality.measure_rules(df, rules, repeat=1)]
    assert ranks == sorted(ranks, reverse=True)
    assert quality.keep_good(df).columns == df.columns


def test_forward_sums_all_segmentations():
    model = language.Languages(["a", "b"], ["▁", "▁x", "x", "y", "xy"], __import__("numpy").array([[1, 9], [2, 8], [3, 7], [4, 6], [5, 5]]))
    p = {k: v for k, v in zip(model.pieces, model.share)}

    def brute(text):
        if not text:
            return 1.0
        return sum(p[k] * brute(text[len(k) :]) for k in p if text.startswith(k))

    got = language.Scorer(model).forward(["▁xyx", "▁", "▁yxyxxy"])
    for row, text in zip(got, ["▁xyx", "▁", "▁yxyxxy"]):
        want = brute(text)
        assert all(abs(g - __import__("math").log(w)) < 1e-12 for g, w in zip(row, want))


def test_language_on_held_out_rows(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language.language_id(docs, MODEL).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    found = {r["doc_id"]: r for r in language.language_id(docs.select("doc_id", "text", "lang").unionAll(odd.select("doc_id", "text", "lang").where("doc_id < 4")), MODEL).where("doc_id < 4").collect()}
    assert found  # null, empty and blank texts do not break the run
    model = language.learn(docs, MODEL)
    odd_rows = language.identify(odd, model).collect()
    assert {(r["lang_pred"], r["score"]) for r in odd_rows if r["doc_id"] in (1, 2, 3)} == {("und", 0.0)}
    assert all(0 <= r["score"] <= 1 for r in odd_rows) and len(odd_rows) == len(ODD)
    assert language.language_id(empty, MODEL).count() == 0
    nothing = language.learn(empty, MODEL)
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}


def test_toxicity_finds_rare_expressions(spark, odd, empty):
    rng = random.Random(6)
    stock = ["".join(rng.choice("aeioudrtlns") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice(stock) for _ in range(rng.randint(20, 120))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(2 + len(words) // 40):
                words[rng.randrange(len(words))] = rng.choice(["nasturd", "idiatos", "rudolens"]) + rng.choice(["", "s", "en"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    truth = {i: t for i, _, t in labels}
    found = toxicity.toxicity(docs, marks).where("held_out").collect()
    caught = [r["predicted"] for r in found if truth[r["doc_id"]]]
    wrong = [r["predicted"] for r in found if not truth[r["doc_id"]]]
    assert sum(caught) / len(caught) > 0.9 and sum(wrong) / len(wrong) < 0.02
    assert all(0 <= r["score"] <= 1 for r in found)
    both = toxicity.toxicity(docs.unionAll(odd.select("doc_id", "text")), marks)
    assert both.count() == len(rows) + len(ODD)
    assert toxicity.toxicity(empty, marks).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(odd, marks.limit(0)).collect()} == {0}
