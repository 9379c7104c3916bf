"""Language identification by segmentation-marginalised unigrams (operator 3).

A language is a distribution over the pieces of a fixed public vocabulary.  The
probability of a word is the sum over all its segmentations into pieces, by the
forward algorithm: at each place the ways to get there, times the piece that
ends there.  Words are independent, so a text's log-likelihood is the sum over
its words, and each different word is worked out once per task for all languages.

The piece counts cover every word of every learning document: words are counted
per language by Spark, then each word adds its count to all pieces that occur
in it.  What reaches the driver is one number per piece and language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .common import in_fold, map_rows, share

BLANK = "▁"
UNKNOWN = "und"
#: Longer runs of letters are summed one by one, with the values scaled against underflow.
LONG = 32
#: Longest piece of a vocabulary, and after so many letters values are scaled.
REACH, SCALED = 64, 16
#: Share of a letter that no piece covers, the same for all languages.
NO_PIECE = 1e-6
#: Words that one worker remembers, about 150 MB with four languages.
MEMO_WORDS = 800_000
#: Texts are scored in blocks of about so many characters.
BLOCK = 1 << 21
#: Characters of words that are kept; beyond it they are worked out again.
MEMO_CHARS = 32 << 20
LETTERS = regex.compile(r"\p{L}+")


def vocabulary(path: str) -> list[str]:
    """The pieces of a model file that stand for text."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        sp.id_to_piece(i)
        for i in range(sp.get_piece_size())
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
    ]


def matcher(pieces: list[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for i, piece in enumerate(pieces):
        automaton.add_word(piece, (i, len(piece)))
    automaton.make_automaton()
    return automaton


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, word, n: how often each lower-case run of letters stands in the texts of a language."""
    return (
        docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
        .select(F.col(lang).cast("string").alias("lang"), F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("word"))
        .where("word <> ''")
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
    )


class Languages:
    """Names and, per piece, the probability in each language."""

    def __init__(self, names: list[str], pieces: list[str], counts: np.ndarray):
        self.names, self.pieces = names, pieces
        smooth = counts + 0.5
        self.share = smooth / smooth.sum(axis=0)


def learn(docs: DataFrame, vocabulary_path: str, text: str = "text", lang: str = "lang") -> Languages:
    """Piece probabilities from all texts with a language; no more than pieces x languages reach the driver."""
    pieces = vocabulary(vocabulary_path)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = matcher(shared.value)
        total: dict[str, Counter] = {}
        for batch in batches:
            for name, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                count = total.setdefault(name, Counter())
                for _, (i, _) in found.iter(BLANK + word):
                    count[i] += n
        for name, count in total.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(count), pa.string()),
                    pa.array(list(count), pa.int64()),
                    pa.array(list(count.values()), pa.int64()),
                ],
                names=["lang", "piece", "n"],
            )

    rows = (
        word_counts(docs, text, lang)
        .mapInArrow(run, "lang string, piece long, n long")
        .groupBy("lang", "piece")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    names = sorted(rows["lang"].unique())
    counts = np.zeros((len(pieces), len(names)))
    if names:
        counts[rows["piece"], rows["lang"].map({x: i for i, x in enumerate(names)})] = rows["n"]
    return Languages(names, pieces, counts)


class Scorer:
    """Scores texts with learned languages; one per task.

    The log-likelihoods of the words seen so far are rows of a matrix; row 0 is
    for words without a letter.  New words of a block of texts are worked out
    together.
    """

    def __init__(self, model: Languages, limit: int = MEMO_WORDS):
        self.names, self.share, self.limit = model.names, model.share, limit
        self.found = ahocorasick.Automaton()
        for i, piece in enumerate(model.pieces):
            self.found.add_word(piece, i << 6 | len(piece))
        self.found.make_automaton()
        self.rows: dict[str, int] = {}
        self.chars = 0
        self.logs = np.zeros((1 << 16, len(self.names)))
        self.used = 1

    def forward(self, parts: list[str]) -> np.ndarray:
        """Per part and language, the logarithm of the summed probability of all segmentations."""
        long = [i for i, p in enumerate(parts) if len(p) > LONG + 1]
        if long:
            logs = np.zeros((len(parts), len(self.names)))
            short = [i for i, p in enumerate(parts) if len(p) <= LONG + 1]
            if short:
                logs[short] = self.forward([parts[i] for i in short])
            for i in long:
                logs[i] = self._forward_long(parts[i])
            return logs
        flat: list[int] = []
        counts = []
        for part in parts:
            codes = [last << 24 | value for last, value in self.found.iter(part)]
            flat += codes
            counts.append(len(codes))
        code = np.array(flat, np.int64)
        owner = np.repeat(np.arange(len(parts)), counts)
        end, size, piece = (code >> 24) + 1, code & 63, (code >> 6) & 0x3FFFF
        order = np.argsort(end, kind="stable")
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        longest = int(lengths.max())
        bound = np.searchsorted(end[order], np.arange(longest + 2))
        ways = np.zeros((longest + 1, len(parts), len(self.names)))
        ways[0] = 1
        for e in range(1, longest + 1):
            at = order[bound[e] : bound[e + 1]]
            if len(at):
                own = owner[at]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                ways[e, own[first]] = np.add.reduceat(ways[e - size[at], own] * self.share[piece[at]], first)
            missed = np.flatnonzero((ways[e, :, 0] == 0) & (lengths >= e))
            ways[e, missed] = ways[e - 1, missed] * NO_PIECE  # no piece ends here
        return np.log(ways[lengths, np.arange(len(parts))])

    def _forward_long(self, part: str) -> np.ndarray:
        """The same for one part of any length; only the values a piece can reach back to are held."""
        ways = np.zeros((REACH, len(self.names)))
        ways[0] = 1
        scale = np.zeros(len(self.names))
        ends: dict[int, list[int]] = {}
        at = 0
        for last, value in chain(self.found.iter(part), [(len(part), 0)]):
            while at < min(last, len(part)):  # all pieces that end at this letter are there
                e, found = at + 1, ends.pop(at, None)
                new = sum(ways[(e - (v & 63)) % REACH] * self.share[v >> 6] for v in found) if found else None
                ways[e % REACH] = ways[at % REACH] * NO_PIECE if new is None or not new[0] else new
                if e % SCALED == 0:
                    most = ways.max(axis=0)
                    ways /= most
                    scale += np.log(most)
                at = e
            ends.setdefault(last, []).append(value)
        return np.log(ways[len(part) % REACH]) + scale

    def _learn(self, words: set[str]) -> None:
        if self.used + len(words) > self.limit or self.chars > MEMO_CHARS:
            self.rows.clear()
            self.used, self.chars = 1, 0
        new = list(words - self.rows.keys())
        for at in range(0, len(new), 10_000):
            block = new[at : at + 10_000]
            parts = [[BLANK + run for run in LETTERS.findall(w)] for w in block]
            owner = np.repeat(np.arange(len(block)), list(map(len, parts)))
            total = np.zeros((len(block), len(self.names)))
            if len(owner):
                logs = self.forward([p for ps in parts for p in ps])
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                total[owner[first]] = np.add.reduceat(logs, first)
            end = self.used + len(block)
            while end > len(self.logs):
                self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
            self.logs[self.used : end] = total
            self.rows.update((w, self.used + i if ps else 0) for i, (w, ps) in enumerate(zip(block, parts)))
            self.used = end
            self.chars += sum(map(len, block))

    def _predict(self, words: list[str]) -> tuple[str, float]:
        at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        if not at.any():
            return UNKNOWN, 0.0
        total = np.zeros(len(self.names))
        for k in range(0, len(at), 1 << 16):
            total += self.logs[at[k : k + (1 << 16)]].sum(axis=0)
        best = int(total.argmax())
        return self.names[best], float(1 / np.exp(total - total[best]).sum())

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """Name and posterior of each text."""
        if not self.names:
            yield from ((UNKNOWN, 0.0) for _ in texts)
            return
        block: list[list[str]] = []
        size = 0
        for i, t in enumerate(texts):
            block.append((t or "").lower().split())
            size += len(t or "")
            if size > BLOCK or i == len(texts) - 1:
                self._learn(set(chain.from_iterable(block)))
                yield from map(self._predict, block)
                block, size = [], 0


def identify(df: DataFrame, model: Languages, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the posterior under equal priors), a row per row of ``df``.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned; equal likelihoods go to the first name.
    """
    shared = share(df.sparkSession, model)

    def work():
        scorer = Scorer(shared())
        return lambda texts: list(scorer.predict(texts))

    return map_rows(df, [doc_id], text, [("lang_pred", pa.string()), ("score", pa.float64())], work)


def language_id(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learned from the documents outside the held-out fold."""
    held_out = in_fold(F.col("doc_id"), 4, 2)
    model = learn(docs.where(~held_out), vocabulary_path)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
