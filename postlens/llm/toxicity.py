"""Toxicity by class-conditional Kneser-Ney models (operator 6).

Both classes have a letter model of words: the next letter given the five before
it, started afresh at each word, so the model knows whole expressions and word
beginnings in any language.  A class takes its own counts less a discount; the
rest comes from a backoff that both classes share: the pooled counts of the
same context, below them the Kneser-Ney continuation counts (in how many
different contexts a letter follows two others), and below them the same for
single letters.  What is rare in both classes thus says next to nothing.

A word's ratio is its log-likelihood as toxic less that as ordinary, from the
second letter on (the first tells the language, not the tone).  It counts beyond
a margin and up to a ceiling, so that the drift of ordinary words between the
classes does not outweigh the few words that matter, and the sum is divided by
the number of words.  A logistic curve turns the logarithm of that mean into a
number from 0 to 1.  The curve is fitted on texts scored by the counts of the
other half of the learning documents, so no text is scored by its own counts.

Counts are gathered from all words of all learning documents.  They are kept in
a fixed number of cells by a 64-bit hash, so the model that is broadcast has
the same size whatever the corpus; the counts in it grow with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import broadcast_if_bounded, in_fold, map_rows, materialize, share

ORDER = 6
BACKOFF = 3
#: Cells per table; the broadcast model holds 13 tables of 4-byte numbers, 55 MB.
CELLS = 1 << 20
DISCOUNT = 0.75
LETTERS = re.compile(r"[^\W\d_]+")
#: Texts are scored in blocks of about so many characters.
BLOCK = 1 << 20
#: Nats from which and up to which a word's ratio counts.
MARGIN, CEILING = 1.0, 4.0
#: Letters' worth of shared backoff in every context, per root of the letters of the smaller class.
STRENGTH = 0.26
#: The curve is fitted on the logarithm of mean + FLOOR, in bins of this width.
FLOOR, BIN = 1e-3, 0.05
THRESHOLD = 0.7
#: A toxic text weighs so much more than an ordinary one when the curve is fitted.
MISSED = 2.0

_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def grams(words: list[str]) -> dict[str, np.ndarray]:
    """Hashes of the letter windows that end at each letter of each word, and the word's number.

    A word is led by blanks and ends with an end sign: order n sees n letters.
    """
    pad = "\0" * (ORDER - 1)
    codes = np.frombuffer("".join(f"{pad}{w}\1" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + ORDER for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    mixed = (codes + np.uint64(1)) * _B2
    window = {1: mixed}
    rolled = mixed
    for n in range(2, ORDER + 1):
        before = np.zeros_like(mixed)
        before[n - 1 :] = mixed[: len(mixed) - n + 1]
        rolled = rolled + before * _B1 ** np.uint64(n)
        window[n] = rolled
    last = codes != 0
    previous = np.roll(window[ORDER - 1], 1)  # the window without its last letter

    def cell(h, salt):
        h = h ^ (h >> np.uint64(31)) ^ np.uint64(salt)
        h = h * _B2
        return (h ^ (h >> np.uint64(29)))[last]

    two = np.roll(window[BACKOFF - 1], 1)
    return {
        "owner": owner[last],
        "gram": cell(window[ORDER], 1),
        "ctx": cell(previous, 2),
        "low": cell(window[BACKOFF], 3),
        "low_ctx": cell(two, 4),
        "letter": cell(window[1], 5),
    }


class Counts:
    """Tables of counts by cell; columns of the class tables: ordinary A, ordinary B, toxic A, toxic B."""

    def __init__(self, gram, total, types, low, low_total, low_types, letter):
        self.gram, self.total, self.types = gram, total, types
        self.low, self.low_total, self.low_types, self.letter = low, low_total, low_types, letter
        self.letters = gram.sum(axis=0, dtype=np.float64)

    def ratio(self, words: list[str], parts: tuple[int, ...] = (0, 1)) -> np.ndarray:
        """Per word: log-likelihood as toxic less that as ordinary, by the given halves of the counts."""
        if not words:
            return np.zeros(0)
        g = grams(words)
        at = {k: (v & np.uint64(CELLS - 1)).astype(np.int64) for k, v in g.items() if k != "owner"}
        letters = self.letter.sum()
        p0 = (self.letter[at["letter"]] + 1) / (letters + CELLS / 1024)
        n = np.maximum(self.low_total[at["low_ctx"]], 1e-9)
        back = (np.maximum(self.low[at["low"]] - DISCOUNT, 0) + DISCOUNT * self.low_types[at["low_ctx"]] * p0) / n
        back = np.where(self.low_total[at["low_ctx"]] > 0, np.maximum(back, 1e-12), p0)
        chosen = [2 * label + p for label in (0, 1) for p in parts]
        c, t, k = self.gram[at["gram"]], self.total[at["ctx"]], self.types[at["ctx"]]
        n = t[:, chosen].sum(axis=1)
        pooled = (np.maximum(c[:, chosen].sum(axis=1) - DISCOUNT, 0) + DISCOUNT * k[:, 4] * back) / np.maximum(n, 1e-9)
        pooled = np.where(n > 0, np.maximum(pooled, 1e-12), back)
        sizes = [self.letters[[2 * label + p for p in parts]].sum() for label in (0, 1)]
        strength = 1 + STRENGTH * min(sizes) ** 0.5
        logs = []
        for label in (0, 1):
            own = [2 * label + p for p in parts]
            kinds = k[:, own].max(axis=1)
            p = np.maximum(c[:, own].sum(axis=1) - DISCOUNT, 0) + (DISCOUNT * kinds + strength) * pooled
            logs.append(np.log(p / (t[:, own].sum(axis=1) + strength)))
        inner = np.r_[False, g["owner"][1:] == g["owner"][:-1]]
        return np.bincount(g["owner"], weights=(logs[1] - logs[0]) * inner, minlength=len(words))


def learning_words(docs: DataFrame) -> DataFrame:
    """word and its counts c0..c3 (ordinary and toxic, each in two halves) over ``docs``: half, toxic, text."""
    words = docs.select("half", "toxic", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    which = F.col("toxic") * 2 + F.col("half")
    return words.groupBy("word").agg(*[F.sum((which == i).cast("long")).alias(f"c{i}") for i in range(4)])


def learn(docs: DataFrame) -> Counts:
    """Count tables from labelled texts (half 0 or 1, toxic 0 or 1, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "ctx", "low", "low_ctx", "letter"]
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                g = grams(part.column(0).to_pylist())
                c = np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5)], axis=1)
                _, first, where = np.unique(g["gram"], return_index=True, return_inverse=True)
                sums = [np.bincount(where, weights=c[g["owner"], i]).astype(np.int64) for i in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[k][first].view(np.int64)) for k in names] + [pa.array(s) for s in sums],
                    names=names + [f"c{i}" for i in range(4)],
                )

    keys = ", ".join(f"{k} long" for k in ("gram", "ctx", "low", "low_ctx", "letter"))
    sums = [F.sum(f"c{i}").alias(f"c{i}") for i in range(4)]
    found = (
        learning_words(docs)
        .mapInArrow(run, keys + ", " + ", ".join(f"c{i} long" for i in range(4)))
        .groupBy("gram")
        .agg(*[F.first(k).alias(k) for k in ("ctx", "low", "low_ctx", "letter")], *sums)
    )
    found = materialize(found, "toxic-grams")

    def cells(df: DataFrame, key: str, *values) -> np.ndarray:
        rows = df.groupBy((F.col(key).bitwiseAND(CELLS - 1)).cast("int").alias("cell")).agg(*values).toPandas()
        out = np.zeros((CELLS, len(values)), np.float32)
        if len(rows):
            out[rows["cell"].to_numpy()] = rows.iloc[:, 1:].to_numpy(np.float32)
        return out

    kinds = [F.sum((F.col(f"c{i}") > 0).cast("long")).alias(f"t{i}") for i in range(4)]
    both = cells(found, "ctx", *sums, *kinds, F.count("*").alias("k"))
    low = materialize(
        found.groupBy("low").agg(F.first("low_ctx").alias("low_ctx"), F.first("letter").alias("letter"), F.count("*").alias("n")),
        "toxic-backoff",
    )
    low_ctx = cells(low, "low_ctx", F.sum("n").alias("n"), F.count("*").alias("k"))
    return Counts(
        cells(found, "gram", *sums),
        both[:, :4],
        both[:, 4:],
        cells(low, "low", F.sum("n").alias("n"))[:, 0],
        low_ctx[:, 0],
        low_ctx[:, 1],
        cells(low, "letter", F.count("*").alias("n"))[:, 0],
    )


class Scorer:
    """Mean ratios of texts; one per task."""

    def __init__(self, counts: Counts, parts: tuple[int, ...], limit: int = 400_000):
        self.counts, self.parts, self.limit = counts, parts, limit
        self.memo: dict[str, float] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.memo) + len(words) > self.limit:
            self.memo.clear()
        new = list(words - self.memo.keys())
        runs = [LETTERS.findall(w) for w in new]
        sums = np.clip(self.counts.ratio([r for rs in runs for r in rs], self.parts) - MARGIN, 0, CEILING - MARGIN)
        owner = np.repeat(np.arange(len(new)), [len(rs) for rs in runs])
        total = np.bincount(owner, weights=sums, minlength=len(new)) if len(new) else []
        self.memo.update(zip(new, np.asarray(total).tolist()))

    def ratios(self, texts: list[str | None]) -> Iterator[float]:
        """The mean of what the words of each text count; 0 without words."""
        block: list[list[str]] = []
        size = 0

        def flush():
            self._learn(set(chain.from_iterable(block)))
            get = self.memo.__getitem__
            return [sum(map(get, words)) / len(words) if words else 0.0 for words in block]

        for t in texts:
            words = (t or "").lower().split()
            block.append(words)
            size += len(t or "")
            if size > BLOCK:
                yield from flush()
                block, size = [], 0
        yield from flush()


def ratios(df: DataFrame, counts, parts: tuple[int, ...], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the ratio x of each text; ``counts`` gives a task the shared Counts."""

    def work():
        scorer = Scorer(counts(), parts)
        return lambda texts: [(x,) for x in scorer.ratios(texts)]

    return map_rows(df, keep, text, [("x", pa.float64())], work)


def fit_curve(binned: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a x + b))) from rows (x, ordinary, toxic), by damped Newton steps; a >= 0."""
    x, no, yes = binned.T
    if no.sum() == 0 or yes.sum() == 0:
        return 0.0, -3.0
    yes = MISSED * yes
    total = no.sum() + yes.sum()
    no, yes = no / total, yes / total
    middle = ((no + yes) * x).sum()
    x = x - middle

    def loss(a, b):
        z = a * x + b
        return (yes * np.logaddexp(0, -z) + no * np.logaddexp(0, z)).sum() + 5e-6 * a * a

    a, b = 0.0, float(np.log(yes.sum() / no.sum()))
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = (no + yes) * p * (1 - p)
        grad = np.array([((yes - (no + yes) * p) * x).sum() - 1e-5 * a, (yes - (no + yes) * p).sum()])
        hess = np.array([[(w * x * x).sum() + 1e-5, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(a + size * step[0], b + size * step[1]) > loss(a, b):
            size /= 2
        a, b = a + size * step[0], b + size * step[1]
        if np.abs(size * step).max() < 1e-7:
            break
    if a < 0:  # the ratio tells nothing
        return 0.0, float(np.log(yes.sum() / no.sum()))
    return float(a), float(b - a * middle)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``, learned from ``labels`` (doc_id, toxic).

    Labels of held-out ids are never read.  A document with contradicting labels
    counts as toxic.  Null and empty texts have the ratio 0; without labels of
    both classes every score is that of an ordinary text.
    """
    held_out = in_fold(F.col("doc_id"), 3, 1)
    known = materialize(
        labels.where(~held_out & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")),
        "toxic-labels",
    )
    half = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(2)).cast("int")
    learning = materialize(
        docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(broadcast_if_bounded(known), "doc_id").select(half.alias("half"), "toxic", "text"),
        "toxic-texts",
    )
    counts = share(docs.sparkSession, learn(learning))
    other = ratios(learning.where("half = 0"), counts, (1,), ["toxic"]).unionAll(
        ratios(learning.where("half = 1"), counts, (0,), ["toxic"])
    )
    level = F.log(F.col("x") + FLOOR)
    cell = F.round(level / BIN).cast("int")
    binned = (
        other.groupBy(cell.alias("bin"))
        .agg(F.sum(1 - F.col("toxic")).alias("no"), F.sum("toxic").alias("yes"))
        .toPandas()
        .to_numpy(np.float64)
        .reshape(-1, 3)
    )
    binned[:, 0] *= BIN
    a, b = fit_curve(binned)
    score = 1 / (1 + F.exp(-(F.lit(a) * level + F.lit(b))))
    return ratios(docs.select("doc_id", "text"), counts, (0, 1), ["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted")
    )
