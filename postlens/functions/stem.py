"""English word stems (the published Porter algorithm with its usual extensions).

Only ROUGE uses it.  Stems depend on the word alone and words repeat, so each
Arrow batch makes the stem of a word once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# ---- fixed values: irregular forms and suffix tables (suffix, replacement) ---------
IRREGULAR = {
    "sky": "sky",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "news": "news",
    "innings": "inning",
    "inning": "inning",
    "outings": "outing",
    "outing": "outing",
    "cannings": "canning",
    "canning": "canning",
    "howe": "howe",
    "proceed": "proceed",
    "exceed": "exceed",
    "succeed": "succeed",
}
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
DERIVED = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
)
ENDINGS = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
REMOVED = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """The word as a string of v(owels) and c(onsonants); y is a vowel after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _ends_short(stem: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y; or just vowel, consonant."""
    shape = _shape(stem)
    return (shape.endswith("cvc") and stem[-1] not in "wxy") or shape == "vc"


def _swap(word: str, table, least: int) -> str:
    """Replace the first suffix of the table that fits, if enough stem is left."""
    for suffix, new in table:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + new if _measure(stem) >= least else word
    return word


def _past_and_progressive(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    stem = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
    if stem is None:
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _ends_short(stem) else stem


def _derivations(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _derivations(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _swap(word, DERIVED, 1)


def _last_suffix(word: str) -> str:
    suffix = next((s for s in REMOVED if word.endswith(s)), "")
    stem = word[: len(word) - len(suffix)]
    if not suffix or _measure(stem) < 2 or (suffix == "ion" and stem[-1] not in "st"):
        return word
    return stem


def stem_word(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = word[:-1] if word.endswith("ies") and len(word) == 4 else _swap(word, PLURALS, 0)
    word = _past_and_progressive(word)
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = _last_suffix(_swap(_derivations(word), ENDINGS, 1))
    if word.endswith("e"):
        size = _measure(word[:-1])
        if size > 1 or (size == 1 and not _ends_short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(ArrayType(StringType()))
def stem_tokens(tokens: pd.Series) -> pd.Series:
    """Stems of the tokens that have more than three characters."""
    words = {w for ws in tokens if ws is not None for w in ws}
    stems = {w: stem_word(w) if len(w) > 3 else w for w in words}
    return tokens.map(lambda ws: None if ws is None else [stems[w] for w in ws])
