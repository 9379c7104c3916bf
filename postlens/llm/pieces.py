"""SentencePiece encoding and decoding of merge-type models (operator 1), by backtracking.

A merge-type encoding of a string is the one sequence of pieces in which every
piece, and every two neighbours, come out again when their letters are merged
anew.  So the encoder walks forward: at a position it takes the longest piece
that an Aho-Corasick automaton found there and checks it against the piece
before; if the pair does not survive re-merging it takes the next shorter one;
if none is left the position is marked as failed in a bitfield and the walk
steps back.  No position is tried twice, which keeps long strings linear.

Pieces hold the blank sign only in front, so a text is cut before each run of
blanks and the chunks are encoded by themselves, once per worker and chunk.  A
chunk is cut further where a letter (a character that pieces link to most
others) meets one that stands next to no such letter in any piece; no merge
crosses such a place.
Characters without a piece become the pieces of their UTF-8 bytes and separate
what stands around them.  Runs of several blanks are merged directly: their
pieces share one score, and neighbours do not decide between equal scores.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Callable, Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import MEMO_WORDS, Memo, bounded_batches, map_rows, share

BLANK = "▁"
#: What the unknown piece decodes to; fixed.
UNKNOWN = " \u2047 "
#: Stands for the unknown piece until a leading blank is off.
_UNKNOWN = "\ud800"
#: Stands for a piece without a text, which ends a run of bytes.
_NOTHING = "\ud801"
#: Below all scores.
NEVER = float("-inf")
#: Pairs of pieces that one worker remembers.
MEMO_PAIRS = 400_000

codecs.register_error("replace_each", lambda e: ("�" * (e.end - e.start), e.end))


def linked_letters(pieces: Iterable[str]) -> str:
    """The largest set of characters that stand next to each other in pieces, as a class of a regular expression.

    No piece holds one of them next to a character outside, leading blank signs aside.
    """
    owner: dict[str, str] = {}

    def root(c: str) -> str:
        while owner.setdefault(c, c) != c:
            owner[c] = c = owner[owner[c]]
        return c

    for piece in pieces:
        piece = piece.lstrip(BLANK)
        for a, b in zip(piece, piece[1:]):
            owner[root(a)] = root(b)
    sets: dict[str, list[str]] = {}
    for c in owner:
        sets.setdefault(root(c), []).append(c)
    return "".join(map(re.escape, sorted(max(sets.values(), key=len, default=["a"]))))


class PieceModel:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        odd = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.ids = {sp.id_to_piece(i): i for i in range(n) if i not in odd and not sp.is_byte(i)}
        self.scores = {piece: sp.get_score(i) for piece, i in self.ids.items()}
        self.control = {i: _UNKNOWN if sp.is_unknown(i) else _NOTHING for i in odd}
        self.end = sp.eos_id()
        if len(self.bytes) != 256 or any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a model with byte pieces and blanks only in front of pieces is needed")
        self.ids = {p: i for p, i in self.ids.items() if self.merge(p) == [p]}
        #: The next shorter piece that a piece begins with, or "".
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), "") for p in self.ids}
        self.letters = linked_letters(self.scores)

    def merge(self, text: str) -> list[str]:
        """Merge the best-scored neighbours, leftmost first among equals, until no piece comes of any two."""
        parts, scores = list(text), self.scores
        if len(parts) < 2:
            return parts
        if len(parts) <= 48:
            get = scores.get
            found = [get(a + b, NEVER) for a, b in zip(text, text[1:])]
            while found and (best := max(found)) != NEVER:
                i = found.index(best)
                parts[i] += parts.pop(i + 1)
                del found[i]
                if i:
                    found[i - 1] = get(parts[i - 1] + parts[i], NEVER)
                if i < len(found):
                    found[i] = get(parts[i] + parts[i + 1], NEVER)
            return parts
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-s, i, p) for i in range(n - 1) if (s := scores.get(p := parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j < 0 or len(parts[i]) + len(parts[j]) != len(piece) or parts[i] + parts[j] != piece:
                continue
            parts[i], parts[j] = piece, ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
            for p, q in ((before[i], i), (i, k)):
                if p >= 0 and q >= 0 and (s := scores.get(x := parts[p] + parts[q])) is not None:
                    heapq.heappush(heap, (-s, p, x))
        return [p for p in parts if p]


class Encoder:
    """Encodes and decodes with a model; one per task."""

    def __init__(self, model: PieceModel, words: int = MEMO_WORDS, pairs: int = MEMO_PAIRS):
        self.model = model
        self.automaton = ahocorasick.Automaton()
        for piece in model.ids:
            self.automaton.add_word(piece, (len(piece) - 1, piece))
        self.automaton.make_automaton()
        self.pairs = Memo(lambda ab: model.merge(ab[0] + ab[1]) == [*ab], pairs)
        self.words = Memo(self._word, words)
        self.runs = Memo(self._run, words)
        self.cut = re.compile(f"[{model.letters}]+|[^{model.letters}]+").findall
        self.number = {p: str(i) for p, i in model.ids.items()}
        table = {str(i): p.replace(BLANK, " ") for p, i in model.ids.items()}
        # bytes from 128 on wait as surrogates until the whole run is there
        table |= {str(i): chr(b) if b < 128 else chr(0xDC00 + b) for b, i in model.bytes.items()}
        self.table = table | {str(i): s for i, s in model.control.items()}

    def chunk(self, text: str) -> list[str]:
        """The pieces of a chunk; a character without a piece stands for itself."""
        n, pairs, shorter = len(text), self.pairs, self.model.shorter
        longest: list[str | None] = [None] * (n + 1)
        for last, (back, piece) in self.automaton.iter(text):
            longest[last - back] = piece  # longer ones come later
        failed = bytearray(n // 8 + 1)
        path: list[str] = []  # a piece, or "" for a character in bytes, which pairs with anything
        starts: list[int] = []
        pos, piece, before = 0, longest[0], ""
        while pos < n:
            if longest[pos] is None:  # no piece starts here
                path.append("")
                starts.append(pos)
                pos += 1
                piece, before = longest[pos], ""
                continue
            while piece:
                end = pos + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (not before or pairs[before, piece]):
                    break
                piece = shorter[piece]
            if piece:
                path.append(piece)
                starts.append(pos)
                pos, piece, before = end, longest[end], piece
                continue
            failed[pos >> 3] |= 1 << (pos & 7)
            while not piece:  # back to the last position that has a shorter piece
                piece, pos = path.pop(), starts.pop()
                piece = piece and shorter[piece]
            before = path[-1] if path else ""
        return [p or text[i] for p, i in zip(path, starts)]

    def _word(self, word: str) -> str:
        """The ids, joined by blanks, of ``word`` behind a blank sign."""
        first, *rest = self.cut(word) or [""]
        return " ".join([self.runs[BLANK + first], *map(self.runs.__getitem__, rest)])

    def _run(self, text: str) -> str:
        return " ".join(self._ids(self.chunk(text)))

    def _ids(self, parts: list[str]) -> list[str]:
        number, bytes_ = self.number, self.model.bytes
        out = []
        for p in parts:
            i = number.get(p)
            out += [i] if i is not None else [str(bytes_[b]) for b in p.encode("utf-8", "replace")]
        return out

    def encode(self, text: str | None) -> str:
        """The ids of a text in decimal, joined by blanks, without begin or end; "" for null or empty."""
        if not text:
            return ""
        text = text.replace(BLANK, " ")
        if "  " not in text and text[-1] != " " and text[0] != " ":
            return " ".join(map(self.words.__getitem__, text.split(" ")))
        out = []
        for blanks, word in re.findall(r"( *)([^ ]+|$)", " " + text):
            if len(blanks) == 1 and word:
                out.append(self.words[word])
            elif blanks or word:
                # several blanks: merged directly, as far as the word's own pieces reach
                out.append(" ".join(self._ids(self.model.merge(BLANK * len(blanks) + word))))
        return " ".join(out)

    def decode(self, ids: str) -> str:
        """The text of ids in decimal, joined by blanks; bytes that are no UTF-8 become U+FFFD each."""
        if not ids:
            return ""
        text = "".join(map(self.table.__getitem__, ids.split(" ")))
        text = _LEAD.sub("", text, count=1)
        if _WAITING.search(text):
            text = _WAITING.sub(lambda m: m[0].encode("utf-8", "surrogateescape").decode("utf-8", "replace_each"), text)
        return text.replace(_NOTHING, "").replace(_UNKNOWN, UNKNOWN)


#: The blank in front of the first piece that has a text.
_LEAD = re.compile("^\ud801* ")
_WAITING = re.compile("[\udc80-\udcff]+")


def load(spark_df: DataFrame, path: str, **memos: int) -> Callable[[], Encoder]:
    """A function for tasks that gives an encoder; the model's tables, fixed in size, are broadcast."""
    model = share(spark_df.sparkSession, PieceModel(path))
    return lambda: Encoder(model(), **memos)


def encode(df: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (decimal, joined by one blank, end id last), a row per row of ``df``."""
    encoder = load(df, model)

    def work():
        enc = encoder()
        end = str(enc.model.end)
        return lambda texts: [(f"{ids} {end}" if (ids := enc.encode(t)) else end,) for t in texts]

    return map_rows(df, [doc_id], text, [("ids", pa.string())], work)


def decode(df: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text, from ids as ``encode`` gives them; null for null."""
    encoder = load(df, model)

    def work():
        enc = encoder()
        return lambda rows: [(None if r is None else enc.decode(r),) for r in rows]

    return map_rows(df, [doc_id], ids, [("text", pa.string())], work)


def round_trip(df: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_bytes of the decoded text, a row per row.

    Encodes, adds the end id and decodes those ids in one pass, so neither ids
    nor texts leave the task.  Null is encoded as the empty text: the end id alone.
    """
    encoder = load(df, model)

    def work():
        enc = encoder()
        end = str(enc.model.end)

        def rows(texts):
            out = []
            for t in texts:
                ids = enc.encode(t)
                ids = f"{ids} {end}" if ids else end
                back = enc.decode(ids).encode("utf-8")
                out.append(
                    (
                        ids.count(" ") + 1,
                        hashlib.sha256(ids.encode()).hexdigest(),
                        hashlib.sha256(back).hexdigest(),
                        len(back),
                    )
                )
            return out

        return rows

    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("decoded_bytes", pa.int64())]
    return map_rows(df, [doc_id], text, fields, work)


def encode_rows(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``df`` with ``text`` as its ids decode, and ids (array of int, end id last) and n_tokens.

    A null or empty text has the end id alone and becomes the empty text; a
    repeated row is a row of its own.  Columns ids and n_tokens of ``df`` are replaced.
    """
    df = bounded_batches(df)
    encoder = load(df, model, words=MEMO_WORDS // 8, pairs=MEMO_PAIRS // 8)  # next to texts and ids
    keep = [c for c in df.columns if c not in (text, "ids", "n_tokens")]

    def work():
        enc = encoder()
        end = str(enc.model.end)

        def rows(texts):
            out = []
            for t in texts:
                ids = enc.encode(t)
                ids = f"{ids} {end}" if ids else end
                numbers = np.array(ids.split(" "), np.int32)  # a list of numbers would take nine times the memory
                out.append((enc.decode(ids), numbers, len(numbers)))
            return out

        return rows

    fields = [(text, pa.string()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64())]
    return map_rows(df, keep, text, fields, work)
