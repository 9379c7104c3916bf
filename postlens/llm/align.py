"""Cross-tokenizer alignment (operator 13) by galloping intersection of token ends.

Two tokenizers cut the same bytes into tokens A and B.  The shorter list of
token ends drives a search into the longer one: steps of 1, 2, 4, ... ends from where
the last was found bracket the next, and a binary search finds its rank.  Ends that both lists hold cut the tokens into groups;
the ranks of two neighbouring ends are the range of the longer list's tokens
that overlap the token between them, which gives all links.

How often an id pair is linked is a count over all documents.  Pairs that a
share of 2^-18 or more of all (document, pair) rows hold are at most 2^18, so
they may be broadcast; the others are joined by a shuffle in which no pair has
more than that share.

Both tokenizers cut before a single blank between characters that are no white
space, so texts are encoded in words there, each different word once, and long
texts are aligned in parts that end at such a cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .bytebpe import byte_letters
from .common import materialize

#: Characters of a text that are aligned at a time, if there is a cut.
PART = 1 << 16
#: Longest word that is remembered, and the bytes of all that are.
WORD, MEMO_BYTES = 64, 96 << 20
#: Texts whose words are encoded together.
ROWS = 64
#: One in so many (document, pair) rows makes a pair a frequent one.
FREQUENT = 1 << 18

BLANK = "▁"
_UNEVEN = re.compile(r" \s|\s |^ | $").search
_CUT = re.compile(r"(?<=\S) (?=\S)").split
_BYTE = re.compile(r"<0x[0-9A-F]{2}>").fullmatch

#: A and B ids as int32 bytes; None where the tokens' bytes differ from the text's.
Word = tuple[bytes, bytes] | None


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of ``short`` how many of ``long`` are smaller; both ascend.

    All ends search at once: each starts from where its place in the shorter
    list would be in the longer, steps 1, 2, 4, ... to the side where its rank
    lies until it is bracketed, and then halves the bracket.
    """
    n, m = len(long), len(short)
    if not m or not n:
        return np.zeros(m, np.int64)
    high = np.minimum(np.arange(m) * n // m, n - 1)
    smaller = long[high] < short  # the rank lies above
    low = np.where(smaller, high + 1, 0)
    high = np.where(smaller, n, high)  # low <= rank <= high
    step, up, down = 1, np.flatnonzero(smaller), np.flatnonzero(~smaller)
    while len(up):
        probe = low[up] + step - 1
        inside = probe < n
        up, probe = up[inside], probe[inside]
        above = long[probe] < short[up]
        high[up[~above]] = probe[~above]
        up = up[above]
        low[up] = probe[above] + 1
        step *= 2
    step = 1
    while len(down):
        probe = high[down] - step
        inside = probe >= 0
        down, probe = down[inside], probe[inside]
        below = long[probe] < short[down]
        low[down[below]] = probe[below] + 1
        down = down[~below]
        high[down] = probe[~below]
        step *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        above = long[middle] < short[open_]
        low[open_[above]] = middle[above] + 1
        high[open_[~above]] = middle[~above]
        open_ = open_[low[open_] < high[open_]]
    return low


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a_cuts, b_cuts, a, b) of two lists of token ends over the same bytes, neither empty.

    The cuts say, for each common end, how many A and B tokens end up to it;
    ``a`` and ``b`` are the numbers of the tokens of each link.  No token is empty.
    """
    swapped = len(b_ends) < len(a_ends)
    short, long = (b_ends, a_ends) if swapped else (a_ends, b_ends)
    ranks = gallop(short, long)
    common = long[ranks] == short
    mine_cuts = np.flatnonzero(common) + 1
    their_cuts = ranks[common] + 1
    # a token starts where the one before ended: in the token of that rank, or behind it if the end is common
    first = np.concatenate(([0], (ranks + common)[:-1]))
    overlaps = ranks - first + 1
    mine = np.repeat(np.arange(len(short)), overlaps)
    theirs = np.arange(len(mine)) + np.repeat(first - np.cumsum(overlaps) + overlaps, overlaps)
    return (their_cuts, mine_cuts, theirs, mine) if swapped else (mine_cuts, their_cuts, mine, theirs)


class Pair:
    """Both tokenizers, and the words one worker remembers."""

    def __init__(self, a_json: str, b_model: bytes):
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        numbers = {c: i for i, c in enumerate(byte_letters())}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(numbers[c] for c in token) if all(c in numbers for c in token) else token.encode("utf-8")
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if _BYTE(p) else p.replace(BLANK, " ").encode("utf-8") for p in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # what a token adds to the groups' text: twice its number, and one more if it ends its side of the group
        self.told = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"]
        self.told += [f"{i}{end}" for i in range(len(self.b_bytes)) for end in ",;"]
        self.words: dict[str, Word] = {}
        self.held = 0

    def _fits(self, a_ids: list[int], b_ids: list[int], want: bytes) -> bool:
        return b"".join([self.a_bytes[i] for i in a_ids]) == want and b"".join([self.b_bytes[i] for i in b_ids]) == want

    def _alone(self, word: str) -> Word:
        a_ids, b_ids = self.a.encode(" " + word, add_special_tokens=False).ids, self.b.encode(word)
        if not self._fits(a_ids, b_ids, b" " + word.encode("utf-8")):
            return None
        return np.array(a_ids, np.int32).tobytes(), np.array(b_ids, np.int32).tobytes()

    def _together(self, words: list[str]) -> list[Word]:
        """The tokens of each of ``words``, encoded as one text; none has white space at its ends."""
        text = " ".join(words)
        a_ids, b_ids = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if not self._fits(a_ids, b_ids, b" " + text.encode("utf-8")):
            return list(map(self._alone, words))
        ends = np.cumsum([len(w.encode("utf-8")) + 1 for w in words])
        sides = []
        for ids, sizes in ((a_ids, self.a_sizes), (b_ids, self.b_sizes)):
            ids = np.array(ids, np.int32)
            data = ids.tobytes()
            cuts = (4 * (np.searchsorted(np.cumsum(sizes[ids]), ends) + 1)).tolist()
            sides.append([data[i:j] for i, j in zip([0, *cuts], cuts)])
        return list(zip(*sides))

    def encode(self, texts: list[list[str]]) -> list[list[Word]]:
        """The words of several texts, each different one encoded once."""
        known = self.words
        if self.held > MEMO_BYTES:
            known.clear()
            self.held = 0
        new = list({w for words in texts for w in words if w not in known})
        plain = [w for w in new if w and BLANK not in w and not w[0].isspace() and not w[-1].isspace()]
        fresh = dict(zip(plain, self._together(plain))) if plain else {}
        for word in new:
            if word not in fresh:
                fresh[word] = self._alone(word)
        out = [[fresh[w] if w in fresh else known[w] for w in words] for words in texts]
        for word, value in fresh.items():
            if len(word) <= WORD:
                known[word] = value
                self.held += 250 + 4 * len(word) + (0 if value is None else len(value[0]) + len(value[1]))
        return out


def words_of(text: str) -> list[str]:
    """A text cut at every single blank between characters that are no white space."""
    return _CUT(text) if _UNEVEN(text) else text.split(" ")


def parts_of(words: list[str], limit: int = PART) -> Iterator[list[str]]:
    """The words of a text in runs of about ``limit`` characters."""
    start = size = 0
    for i, word in enumerate(words):
        size += len(word) + 1
        if size >= limit:
            yield words[start : i + 1]
            start, size = i + 1, 0
    if start < len(words):
        yield words[start:]


class Aligned:
    """What is gathered about one text, part by part."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.digest, self.keys, self.times, self.fits = hashlib.sha256(), [], [], True

    def add(self, words: list[Word]) -> None:
        if None in words:
            self.fits = False
            return
        pair = self.pair
        a, b = (np.frombuffer(b"".join([w[side] for w in words]), np.int32).astype(np.int64) for side in (0, 1))
        a_cuts, b_cuts, left, right = align(np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b]))
        # the groups' text: each group's A tokens and then its B tokens
        told_a, told_b = 2 * a, 2 * (b + len(pair.a_bytes))
        told_a[a_cuts - 1] += 1
        told_b[b_cuts - 1] += 1
        a_before, b_before = np.concatenate(([0], a_cuts[:-1])), np.concatenate(([0], b_cuts[:-1]))
        told = np.empty(len(a) + len(b), np.int64)
        told[np.arange(len(a)) + np.repeat(b_before, a_cuts - a_before)] = told_a
        told[np.arange(len(b)) + np.repeat(a_cuts, b_cuts - b_before)] = told_b
        names = pair.told
        text = "".join([names[i] for i in told.tolist()])
        if self.n_groups:
            self.digest.update(b";")
        self.digest.update(text[:-1].encode())
        self.n_a += len(a)
        self.n_b += len(b)
        self.n_groups += len(a_cuts)
        self.n_links += len(left)
        keys, times = np.unique(a[left] << 32 | b[right], return_counts=True)
        self.keys.append(keys)
        self.times.append(times)

    def row(self) -> tuple:
        """n_a, n_b, n_groups, n_links, groups_sha256, pairs and times; zeros where the tokens don't fit the text."""
        if not self.fits or not self.n_a:
            return 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int32)
        keys, times = self.keys[0], self.times[0]
        if len(self.keys) > 1:
            keys, place = np.unique(np.concatenate(self.keys), return_inverse=True)
            times = np.bincount(place, np.concatenate(self.times)).astype(np.int64)
        return self.n_a, self.n_b, self.n_groups, self.n_links, self.digest.hexdigest(), keys, times.astype(np.int32)


def align_texts(pair: Pair, texts: list[str | None]) -> list[tuple]:
    """One row of :meth:`Aligned.row` per text; texts of more than a part go part by part."""
    rows: list[tuple | None] = [None] * len(texts)
    short: list[int] = []
    for i, text in enumerate(texts):
        if text and len(text) <= PART:
            short.append(i)
            continue
        found = Aligned(pair)
        for part in parts_of(words_of(text)) if text else ():
            if found.fits:
                found.add(pair.encode([part])[0])
        rows[i] = found.row()
    for i, words in zip(short, pair.encode([words_of(texts[i]) for i in short])):
        found = Aligned(pair)
        found.add(words)
        rows[i] = found.row()
    return rows


def load(df: DataFrame, a_json: str, b_model: str) -> Callable[[], Pair]:
    """A function for tasks that gives both tokenizers; their files' bytes, fixed in size, are broadcast."""
    with open(a_json, encoding="utf-8") as a, open(b_model, "rb") as b:
        shared = df.sparkSession.sparkContext.broadcast((a.read(), b.read()))
    return lambda: Pair(*shared.value)


def alignments(df: DataFrame, a_json: str, b_model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (a << 32 | b, ascending) and times, a row per row.

    Null and empty texts, and texts whose tokens of either side don't join to
    them, have zeros, an empty hash and no pairs.
    """
    pair = load(df, a_json, b_model)
    narrow = df.select(F.monotonically_increasing_id().alias("row"), df[doc_id].alias("id"), df[text].cast("string").alias("t"))
    kind = narrow.schema["id"].dataType.simpleString()
    longs = ("n_a", "n_b", "n_groups", "n_links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                columns = list(zip(*align_texts(both, batch.column(2).to_pylist())))
                ends = np.cumsum([0, *map(len, columns[5])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, np.concatenate(columns[i])) for i in (5, 6)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string()), *lists],
                    names=["row", "id", *longs, "groups_sha256", "pairs", "times"],
                )

    made = f"row long, id {kind}, {', '.join(f'{c} long' for c in longs)}, groups_sha256 string, pairs array<long>, times array<int>"
    return narrow.mapInArrow(run, made)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (rows that hold it linked) and best (no pair of its A id has more)."""
    counts = materialize(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    a_id = F.shiftright("pair", 32).alias("a")
    most = counts.groupBy(a_id).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a_id).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(
    df: DataFrame, a_json: str, b_model: str, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, a row per row of ``df``.

    n_best counts the links whose pair is in as many rows as any pair of its A
    id; count_sum adds up, over links, the rows that hold the link's pair.
    Repeated rows count each.
    """
    aligned = materialize(alignments(df, a_json, b_model, doc_id, text), "alignments")
    counts = materialize(pair_counts(aligned), "pair-facts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    often = F.col("n") * frequent >= total  # so at most ``frequent`` pairs
    known = F.broadcast(counts.where(often))
    links = aligned.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("t"))))
    rare = links.join(known, "pair", "left_anti").join(counts.where(~often), "pair")
    sums = None
    for found in (links.join(known, "pair"), rare):
        part = found.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("t")).alias("count_sum")
        )
        sums = part if sums is None else sums.union(part)
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(
        F.col("id").alias(doc_id), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
