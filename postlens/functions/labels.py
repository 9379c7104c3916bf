"""Raw label normalisation and column-name guessing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .. import fixed
from .text import strip_space

# Numbers as Python's float() reads them (underscores between digits allowed).
_NUMBER = r"^[+-]?(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:e[+-]?\d(?:_?\d)*)?$"
_INFINITY = r"^[+-]?inf(?:inity)?$"
_NAN = r"^[+-]?nan$"


def normalize_label(value: Column) -> Column:
    """1, 0 or null from a raw label; numbers are cut at one half."""
    s = F.lower(strip_space(value.cast("string")))
    number = F.regexp_replace(F.when(s.rlike(_NUMBER), s), "_", "").try_cast("double")
    return (
        F.when(s.isin(*fixed.POSITIVE_LABELS), 1)
        .when(s.isin(*fixed.NEGATIVE_LABELS), 0)
        .when(s.rlike(_NAN), 0)
        .when(s.rlike(_INFINITY), F.when(s.startswith("-"), 0).otherwise(1))
        .when(number.isNotNull(), (number >= 0.5).cast("int"))
    )


def guess_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """A column named like a candidate, else the first that contains one."""
    by_lower = {name.lower(): name for name in columns}
    exact = [by_lower[c.lower()] for c in candidates if c.lower() in by_lower]
    partial = [name for name in columns if any(c.lower() in name.lower() for c in candidates)]
    return next(iter(exact + partial), None)
