"""Cleaning against a plain-Python model, on edge rows and random texts."""

import html
import re
import sys
import unicodedata

import pytest
from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from postlens.functions import text as tx

EDGE = [
    None, "", "   ", "   ", "a\r\nb", "a\rb", "a\t\t b", "a\n\n\n\n\nb", "x\x00y\x07z­​!",
    "ＦＲＥＥ ﬁne ①", "&amp;lt;b&gt; &lt;i&gt;x&lt;/i&gt; AT&amp;T &copy &unknown; &#65;&#x42;", "http://u@h.com/x",
    "tel +1 (555) 123-4567 or 5551234", "é5551234", "a" * 4096, "b" * 4097, "<b>Bold</b> <", "<<>> < >",
    "a@b.com_x@y.org", "x.@y.co z@w.c", "Mail A.B+c@Ex-ample.co.uk, www.x.y/z?a=1 FTP://q HTTPS://r",
    "＜b＞kept＜/b＞", " line sep ", "\x1c\x1dtrim\x1e\x1f", "Straße ΣΑΣ İstanbul", "é́é", "が",
    "가각ᆨ", "1-800-555-1234 1.800.555.1234 18005551234 555 1234", "<a\nhref='#'>link</a>", "%@%.aa", "..@..ab@@cd.ef",
]


def model(text, lowercase=True, emails=True, urls=True, phones=True, tags=True, max_chars=4096):
    s = html.unescape("" if text is None else text)
    if tags:
        s = re.sub("<[^>]+>", " ", s)
    s = unicodedata.normalize("NFKC", s)
    s = "".join(c for c in s if c in "\n\t" or unicodedata.category(c)[0] != "C")
    for on, pattern, mask in (
        (emails, r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "<EMAIL>"),
        (urls, r"(?i)(https?://|www\.|ftp://)[^\s<>\"']+", "<URL>"),
        (phones, r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b", "<PHONE>"),
        (True, r"[ \t]+", " "),
        (True, r"\n{3,}", "\n\n"),
    ):
        s = re.sub(pattern, mask, s) if on else s
    s = s.strip()
    return (s.lower() if lowercase else s)[:max_chars]


def run(spark, texts, expr):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r["x"] for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "ours, theirs",
    [
        ({}, {}),
        ({"lowercase": False}, {"lowercase": False}),
        ({"strip_html": False}, {"tags": False}),
        ({"replace_urls": False, "replace_emails": False, "replace_phones": False}, {"urls": False, "emails": False, "phones": False}),
        ({"max_chars": 7}, {"max_chars": 7}),
    ],
)
def test_clean_text_on_edge_rows(spark, ours, theirs):
    got = run(spark, EDGE, lambda c: tx.clean_text(c, **ours))
    assert got == [model(t, **theirs) for t in EDGE]


# Marks are word characters for Java but not for Python; digits of other scripts
# and assigned characters newer than Java's tables differ too.
ALPHABET = st.sampled_from(
    list("abzAZ019 .@-_+()<>&;:/'\"\n\t\r?%") + ["é", "ß", "ﬁ", "Ａ", "①", " ", "​", "­", "€", "漢", "…", "http://", "www.",
     "&amp;", "&lt;", "&nbsp;", "555-1234", "@x.com", "\n\n", "<b>", "か", "゙"]
)


@settings(
    max_examples=4, deadline=None, derandomize=True, phases=[Phase.generate], suppress_health_check=list(HealthCheck)
)
@given(st.lists(st.lists(ALPHABET, max_size=40).map("".join), min_size=250, max_size=250))
def test_clean_text_on_random_texts(spark, texts):
    got = run(spark, texts, tx.clean_text)
    for text, value in zip(texts, got):
        assert value == model(text), repr(text)


def test_nfkc_skips_only_stable_characters():
    for group in tx.STABLE_RANGES:
        for low, high in group:
            for code in range(low, high + 1):
                c = chr(code)
                assert unicodedata.normalize("NFKC", c) == c and unicodedata.combining(c) == 0
                if c >= "\u0080":
                    assert unicodedata.normalize("NFKC", "e" + c) == "e" + c
                    assert unicodedata.normalize("NFKC", "가" + c) == "가" + c


def test_nfkc_hint_covers_every_changing_character(spark):
    changing = [
        chr(c) for c in range(sys.maxunicode + 1)
        if not 0xD800 <= c <= 0xDFFF and unicodedata.normalize("NFKC", chr(c)) != chr(c)
    ]
    assert run(spark, changing, tx.normalize_nfkc) == [unicodedata.normalize("NFKC", c) for c in changing]


def test_long_unbroken_run_is_linear(spark):
    # Quadratic matching would take minutes here.
    [got] = run(spark, ["a" * 400_000 + "@" + "b" * 10], tx.mask_emails)
    assert len(got) == 400_011


def test_truncate_bytes_at_a_split_character(spark):
    texts = ["a" * 7999 + "€x", "a" * 7997 + "𝄞", "a" * 8000, "a" * 8001, "é" * 4001]
    got = run(spark, texts, lambda c: tx.truncate_bytes(c, 8000))
    want = [t if len(t.encode()) <= 8000 else t.encode()[:8000].decode("utf-8", "replace") for t in texts]
    assert got == want


def test_assemble_text(spark):
    rows = [("s", "b", "t", "th", "q"), ("", None, "", "th", "q"), (" ", "", None, None, "q"), (None,) * 5]
    df = spark.createDataFrame(rows, "subject string, body string, text string, thread string, query string")
    got = [r[0] for r in df.select(tx.assemble_text(*[F.col(c) for c in df.columns])).collect()]
    assert got == ["s b t", "th", "q", ""]


def test_non_strings_are_cast(spark):
    df = spark.createDataFrame([(12345678901,)], "n long")
    assert df.select(tx.clean_text(F.col("n"), replace_phones=False)).first()[0] == "12345678901"


def test_decoder_holds_few_texts_at_a_time():
    """A batch's texts stay in Arrow's buffers; only a slice of them are Python strings (all were before)."""
    import tracemalloc

    import pyarrow as pa

    work = tx._decoder(False, True, False).func
    batch = pa.array(["&lt;" + "x" * 2_000 + "é", None, ""] * 4_000)
    tracemalloc.start()
    done = work(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done[:4].to_pylist() == ["<" + "x" * 2_000 + "é", None, "", "<" + "x" * 2_000 + "é"] and len(done) == len(batch)
    assert peak < 2 << 20
    assert work(batch[:0]).to_pylist() == []
