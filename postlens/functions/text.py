"""Text cleaning, masking and cutting as Spark column expressions.

All functions take and return a ``Column``.  Only entity decoding and NFKC
have no built-in in Spark; both live in one Arrow UDF that receives a payload
only for rows that can change (see :func:`decode_entities_and_normalize`).
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache, reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .. import fixed

# Whitespace that Python's str.strip removes / that Go's TrimSpace removes.
_UNICODE_SPACES = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
_STRIP_CHARS = _UNICODE_SPACES + "\x1c\x1d\x1e\x1f"

TAG_PATTERN = r"<[^>]+>"
CONTROL_PATTERN = r"[\p{C}&&[^\n\t]]"
# Leading look-aheads name the characters a match can start with; most positions
# then fail on one character test.
#
# An address can only start where a run of local-part characters starts or right
# after the previous match; saying so keeps long unbroken runs linear.
EMAIL_PATTERN = (
    r"(?:(?<![a-zA-Z0-9._%+\-])|\G)[a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
)
URL_PATTERN = r"""(?=[hwfHWF])(?iU)(?:https?://|www\.|ftp://)[^\s\x1c-\x1f<>"']+"""
# Word boundaries are spelled out over letters, numbers and the underscore: Java
# counts combining marks as word characters, the published rule does not.
_WORD = r"[\p{L}\p{N}_]"
_GAP = r"[-.\s\x1c-\x1f]?"
PHONE_PATTERN = (
    rf"(?U)(?=[(+\d])(?:(?=\d)(?<!{_WORD})|(?<={_WORD})(?=[(+]))"
    rf"(?:\+?1{_GAP})?(?:\(?\d{{3}}\)?{_GAP})?\d{{3}}{_GAP}\d{{4}}(?!{_WORD})"
)

#: Texts that the decoder holds as Python strings at a time; the rest of a batch stays in Arrow's buffers.
_SLICE_ROWS = 64
# An ampersand that could open an entity.
_ENTITY_HINT = r"&[^\t\n\f <&;]"
# Characters NFKC leaves alone and that never combine with a neighbour, so a
# text made only of them is already normalised.  In groups: the pattern tests
# a group only if the character is in none before it.
STABLE_RANGES = (
    ((0x0000, 0x009F),),
    (
        (0x00A1, 0x00A7), (0x00A9, 0x00A9), (0x00AB, 0x00AE), (0x00B0, 0x00B1),
        (0x00B6, 0x00B7), (0x00BB, 0x00BB), (0x00BF, 0x0131), (0x0134, 0x013E),
        (0x0141, 0x0148), (0x014A, 0x017E),
    ),
    (
        (0x0391, 0x03A1), (0x03A3, 0x03CE), (0x0400, 0x0482), (0x048A, 0x052F),
        (0x05D0, 0x05EA), (0x2012, 0x2016), (0x2018, 0x2023), (0x2030, 0x2032),
        (0x20AC, 0x20AC), (0x3001, 0x3002), (0x3041, 0x3096), (0x30A1, 0x30FA),
        (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
    ),
)
_NFKC_HINT = (
    "["
    + "&&".join(
        "[^" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in group) + "]" for group in STABLE_RANGES
    )
    + "]"
)


def as_text(c: Column) -> Column:
    """Any value as a string; a missing value is the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip_space(c: Column) -> Column:
    """Trim Unicode whitespace and the four ASCII separators (Python's rule)."""
    return F.btrim(c, F.lit(_STRIP_CHARS))


def trim_space(c: Column) -> Column:
    """Trim Unicode whitespace only (Go's rule)."""
    return F.btrim(c, F.lit(_UNICODE_SPACES))


def bind(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``c`` where ``c`` is evaluated once, however often it is used.

    A one-element ``transform`` gives the value a name; nested expressions
    would otherwise be repeated at every mention.
    """
    return F.element_at(F.transform(F.array(c), use), 1)


def _replace_if(c: Column, needles: Sequence[str], pattern: str, by: str) -> Column:
    """``regexp_replace``, skipped for texts that contain none of ``needles``.

    A plain substring search is many times cheaper than a regular expression.
    """

    def step(x):
        wanted = reduce(or_, [F.contains(x, F.lit(n)) for n in needles])
        return F.when(wanted, F.regexp_replace(x, pattern, by)).otherwise(x)

    return bind(c, step)


def is_blank(c: Column) -> Column:
    return trim_space(c) == ""


@lru_cache(maxsize=None)
def _decoder(strip_tags: bool, unescape: bool, nfkc: bool):
    tag = re.compile(TAG_PATTERN)

    def one(text):
        if text is None:
            return None
        if unescape:
            text = html.unescape(text)
        if strip_tags:
            text = tag.sub(" ", text)
        return unicodedata.normalize("NFKC", text) if nfkc else text

    @F.arrow_udf(StringType())
    def decode(texts: pa.Array) -> pa.Array:
        done = [
            pa.array([one(t) for t in texts.slice(at, _SLICE_ROWS).to_pylist()], pa.string())
            for at in range(0, len(texts), _SLICE_ROWS)
        ]
        out = pa.concat_arrays(done) if done else pa.array([], pa.string())
        del done
        pa.default_memory_pool().release_unused()  # the worker lives on
        return out

    return decode


def _decode_where(c: Column, hint: Column, plain: Column, **steps) -> Column:
    # The UDF runs for every row, so rows without need send it a null.
    return F.coalesce(_decoder(**steps)(F.when(hint, c)), plain)


def _has_entity(c: Column) -> Column:
    return F.contains(c, F.lit("&")) & c.rlike(_ENTITY_HINT)


def unescape_html(c: Column) -> Column:
    """Decode HTML entities once."""
    return _decode_where(c, _has_entity(c), c, strip_tags=False, unescape=True, nfkc=False)


def normalize_nfkc(c: Column) -> Column:
    return _decode_where(c, c.rlike(_NFKC_HINT), c, strip_tags=False, unescape=False, nfkc=True)


def decode_entities_and_normalize(c: Column, strip_html: bool = True) -> Column:
    """Entities, then tags, then NFKC, in that order.

    Rows with no entity and only NFKC-stable characters stay in the JVM.
    """
    hint = _has_entity(c) | c.rlike(_NFKC_HINT)
    plain = strip_tags(c) if strip_html else c
    return _decode_where(c, hint, plain, strip_tags=strip_html, unescape=True, nfkc=True)


def strip_tags(c: Column) -> Column:
    return _replace_if(c, ["<"], TAG_PATTERN, " ")


def strip_control(c: Column) -> Column:
    """Delete Unicode category C except newline and tab."""
    return F.regexp_replace(c, CONTROL_PATTERN, "")


def mask_emails(c: Column) -> Column:
    return _replace_if(c, ["@"], EMAIL_PATTERN, fixed.EMAIL_MASK)


def mask_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL_PATTERN, fixed.URL_MASK)


def mask_phones(c: Column) -> Column:
    return F.regexp_replace(c, PHONE_PATTERN, fixed.PHONE_MASK)


def mask_pii(c: Column, emails: bool = True, urls: bool = True, phones: bool = True) -> Column:
    """E-mail addresses, then URLs, then phone numbers."""
    for wanted, mask in ((emails, mask_emails), (urls, mask_urls), (phones, mask_phones)):
        if wanted:
            c = mask(c)
    return c


def normalize_whitespace(c: Column) -> Column:
    c = _replace_if(c, ["  ", "\t"], r"[ \t]+", " ")
    c = _replace_if(c, ["\n\n\n"], r"\n{3,}", "\n\n")
    return strip_space(c)


def truncate_chars(c: Column, n: int) -> Column:
    """First ``n`` code points."""
    return F.substring(c, 1, n)


def truncate_bytes(c: Column, n: int) -> Column:
    """First ``n`` bytes; a split code point at the end reads as U+FFFD."""
    cut = F.make_valid_utf8(F.substring(c.cast("binary"), 1, n).cast("string"))
    return F.when(F.octet_length(c) > n, cut).otherwise(c)


def clean_text(
    c: Column,
    *,
    lowercase: bool = True,
    replace_urls: bool = True,
    replace_emails: bool = True,
    replace_phones: bool = True,
    strip_html: bool = True,
    max_chars: int = fixed.CLEAN_MAX_CHARS,
) -> Column:
    """The whole cleaning sequence as one expression."""
    c = decode_entities_and_normalize(as_text(c), strip_html)
    c = strip_control(c)
    c = mask_pii(c, emails=replace_emails, urls=replace_urls, phones=replace_phones)
    c = normalize_whitespace(c)
    if lowercase:
        c = F.lower(c)
    return truncate_chars(c, max_chars)


def request_text(subject: Column, body: Column) -> Column:
    """Lower-cased subject and body joined by a space, trimmed."""
    return trim_space(F.concat(F.lower(as_text(subject)), F.lit(" "), F.lower(as_text(body))))


def assemble_text(subject: Column, body: Column, text: Column, thread: Column, query: Column) -> Column:
    """Non-empty subject, body and text joined; else the thread; else the query.

    The result is the empty string when nothing is given.
    """
    parts = [F.nullif(as_text(p), F.lit("")) for p in (subject, body, text)]
    joined = F.nullif(strip_space(F.concat_ws(" ", *parts)), F.lit(""))
    return F.coalesce(joined, F.nullif(as_text(thread), F.lit("")), as_text(query))
