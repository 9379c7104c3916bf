"""Token counts of a byte-level BPE (operator 9): whole tokens first, merges for the rest.

Offline, each vocabulary string is encoded alone; those that come out as one
token, and that the pre-tokenizer leaves whole, form a table.  A pre-token in
the table counts one without a merge; only the others are merged, once per
worker and distinct string.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, map_rows, share

#: Splits text before the merges; fixed, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKEN_LIMIT = 512
#: Stands for a pair without a merge.
NONE = 1 << 60
#: Pre-tokens that one worker remembers, about 150 MB.
MEMO_TOKENS = 1_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, extra = [], 0x100
    for b in range(256):
        letters.append(chr(b) if b in printable else chr(extra))
        extra += b not in printable
    return letters


class ByteVocabulary:
    """The merges, special strings and whole tokens of a tokenizer file.

    Inside, a byte is its own number and a merged token is 256 + the rank of the
    first merge that makes its string.
    """

    def __init__(self, text: str):
        spec = json.loads(text)
        model, numbers = spec["model"], {c: i for i, c in enumerate(byte_letters())}
        self.pairs: dict[int, int] = {}  # left << 32 | right to rank
        self.made: list[int] = []  # rank to token number
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[numbers[left] << 32 | numbers[right]] = rank
            self.made.append(numbers.setdefault(left + right, 256 + rank))
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.words = self._whole(model["vocab"])

    def merge(self, token: str) -> int:
        """The number of tokens of one pre-token, by applying the merges in order of rank."""
        parts, pairs, made = list(token.encode("utf-8")), self.pairs, self.made
        if len(parts) > 64:
            return self._merge_long(parts)
        costs = [pairs.get(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while costs:
            best = min(costs)
            if best == NONE:
                break
            i = costs.index(best)
            parts[i] = made[best]
            del parts[i + 1], costs[i]
            if i:
                costs[i - 1] = pairs.get(parts[i - 1] << 32 | parts[i], NONE)
            if i < len(costs):
                costs[i] = pairs.get(parts[i] << 32 | parts[i + 1], NONE)
        return len(parts)

    def _merge_long(self, parts: list[int]) -> int:
        """The same with a heap, n log n for strings without a break."""
        n, pairs = len(parts), self.pairs
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, key) for i in range(n - 1) if (r := pairs.get(key := parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i, key = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or parts[i] << 32 | parts[j] != key:
                continue
            parts[i], parts[j] = self.made[rank], -1
            left -= 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
            for p, q in ((before[i], i), (i, k)):
                if p >= 0 and q >= 0 and (r := pairs.get(key := parts[p] << 32 | parts[q])) is not None:
                    heapq.heappush(heap, (r, p, key))
        return left

    def _whole(self, vocab: dict[str, int]) -> list[str]:
        """The vocabulary strings that are one pre-token and encode alone as one token."""
        split, whole = regex.compile(PATTERN), []
        numbers = {c: i for i, c in enumerate(byte_letters())}
        for token in vocab:
            try:
                text = bytes(numbers[c] for c in token).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if split.findall(text) == [text] and self.merge(text) == 1:
                whole.append(text)
        return whole

    def counter(self) -> Callable[[str | None], int]:
        """A function from a text to its number of tokens, with bounded memos.

        A single blank between two characters that are not white space always
        starts a pre-token, so texts are cut there and each different word is
        split and counted once; texts with other white space around a blank are
        split whole.
        """
        whole, find = frozenset(self.words), regex.compile(PATTERN).findall
        tokens = Memo(lambda t: 1 if t in whole else self.merge(t), MEMO_TOKENS // 2)
        words = Memo(lambda w: sum(map(tokens.__getitem__, find(" " + w))), MEMO_TOKENS)
        special, uneven = self.special, re.compile(r" \s|\s ").search
        cut = regex.compile("|".join(map(regex.escape, special))) if special else None

        def plain(text: str) -> int:
            if uneven(text) or text.endswith(" "):
                return sum(map(tokens.__getitem__, find(text)))
            first, *rest = text.split(" ")
            return sum(map(tokens.__getitem__, find(first))) + sum(map(words.__getitem__, rest))

        def count(text: str | None) -> int:
            if not text:
                return 0
            if cut is None or not any(s in text for s in special):
                return plain(text)
            parts = cut.split(text)
            return len(parts) - 1 + sum(map(plain, parts))

        return count


def token_counts(
    df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", limit: int = TOKEN_LIMIT
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit, a row per row of ``df``.

    ``vocabulary`` is the path of a tokenizers file on the driver; its tables are
    fixed in size and broadcast.  Null counts as the empty text, 0 tokens.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shared = share(df.sparkSession, ByteVocabulary(file.read()))

    def work():
        count = shared().counter()

        def rows(texts):
            out = []
            for t in texts:
                n = count(t)
                out.append((len(t.encode("utf-8")) if t else 0, n, n > limit))
            return out

        return rows

    return map_rows(df, [doc_id], text, [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())], work)
