"""Prompt-safety flags and sanitising, for strings and for nested columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from .. import fixed
from .text import as_text, bind, trim_space, truncate_bytes

_CONTROL = r"[\x00-\x08\x0B-\x1F]"


def _no_flags() -> Column:
    return F.expr("cast(array() as array<string>)")


def drop_control(c: Column) -> Column:
    """Delete characters below 32 other than newline and tab."""
    return F.regexp_replace(c, _CONTROL, "")


def has_injection(c: Column, patterns: Sequence[str] = fixed.INJECTION_PATTERNS) -> Column:
    """Does any pattern occur, whatever the case?

    If all patterns start with a literal character, other positions are passed
    over after one character test.
    """
    starts = {p[0] for p in patterns}
    literal = all(s.isalnum() or s in "<@/:" for s in starts)
    ahead = f"(?=[{''.join(sorted(starts))}])" if literal else ""
    return c.rlike(f"(?iu){ahead}(?:{'|'.join(patterns)})")


def sanitize(c: Column, max_bytes: int = fixed.SAFETY_MAX_BYTES) -> Column:
    return bind(drop_control(c), lambda clean: truncate_bytes(clean, max_bytes))


def _flag_array(**flags: Column) -> Column:
    """Array of the names whose condition holds, in the given (sorted) order."""
    parts = [F.when(cond, F.array(F.lit(name))).otherwise(_no_flags()) for name, cond in flags.items()]
    return F.concat(*parts)


def string_flags(
    clean: Column,
    raw: Column,
    patterns: Sequence[str] = fixed.INJECTION_PATTERNS,
    max_bytes: int = fixed.SAFETY_MAX_BYTES,
) -> dict[str, Column]:
    """One condition per flag, by flag name in sorted order.

    ``clean`` is ``raw`` without control characters; injection is looked for
    before the text is cut.
    """
    size = F.octet_length(clean)
    return {
        fixed.FLAG_CONTROL: F.coalesce(size < F.octet_length(raw), F.lit(False)),
        fixed.FLAG_TRUNCATED: F.coalesce(size > max_bytes, F.lit(False)),
        fixed.FLAG_INJECTION: F.coalesce(has_injection(clean, patterns), F.lit(False)),
    }


def union_flags(*arrays: Column) -> Column:
    """Sorted union of flag arrays, without empty strings."""
    merged = F.concat(*[F.coalesce(a, _no_flags()) for a in arrays])
    return F.array_sort(F.array_distinct(F.filter(merged, lambda f: f != "")))


def sanitize_nested(c: Column, dtype: DataType) -> Column:
    """Sanitise every string inside arrays, maps and structs."""
    if isinstance(dtype, StringType):
        return sanitize(c)
    if isinstance(dtype, ArrayType):
        return F.transform(c, lambda x: sanitize_nested(x, dtype.elementType))
    if isinstance(dtype, MapType):
        return F.transform_values(c, lambda _, v: sanitize_nested(v, dtype.valueType))
    if isinstance(dtype, StructType):
        fields = [sanitize_nested(c[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def nested_flags(c: Column, dtype: DataType) -> Column:
    """Union of the flags of every string inside ``c``."""
    if isinstance(dtype, StringType):
        return bind(drop_control(c), lambda clean: _flag_array(**string_flags(clean, c)))
    if isinstance(dtype, ArrayType):
        return F.coalesce(F.flatten(F.transform(c, lambda x: nested_flags(x, dtype.elementType))), _no_flags())
    if isinstance(dtype, MapType):
        return nested_flags(F.map_values(c), ArrayType(dtype.valueType))
    if isinstance(dtype, StructType):
        return F.concat(*[nested_flags(c[f.name], f.dataType) for f in dtype.fields])
    return _no_flags()


def analyze_and_sanitize(df: DataFrame, fields: Sequence[str], flags_col: str = "safety_flags") -> DataFrame:
    """Replace ``fields`` by their sanitised values and add the sorted flags.

    Plain strings lose their control characters in a projection of their own,
    so flags and cut read that result instead of repeating the expression.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    plain = [f for f in fields if isinstance(types[f], StringType)]
    nested = [f for f in fields if f not in plain]
    staged = df.withColumns({f"_clean_{f}": drop_control(F.col(f)) for f in plain}) if plain else df

    merged: dict[str, Column] = {}
    for f in plain:
        for name, cond in string_flags(F.col(f"_clean_{f}"), F.col(f)).items():
            merged[name] = merged[name] | cond if name in merged else cond
    flags = _flag_array(**merged) if merged else _no_flags()
    if nested:
        flags = union_flags(flags, *[nested_flags(F.col(f), types[f]) for f in nested])
    clean = {f: truncate_bytes(F.col(f"_clean_{f}"), fixed.SAFETY_MAX_BYTES) for f in plain}
    clean.update({f: sanitize_nested(F.col(f), types[f]) for f in nested})
    # Flags first, on their own: a column named inside a lambda function resolves
    # to a new column of that name in the same projection, not to the old one.
    flagged = staged.withColumn(flags_col, flags)
    return flagged.withColumns(clean).drop(*[f"_clean_{f}" for f in plain])


def is_action_blocked(action: Column, flags: Column) -> Column:
    name = F.lower(trim_space(as_text(action)))
    return (name != "") & (F.array_contains(flags, fixed.FLAG_INJECTION) | (name == fixed.BLOCKED_ACTION))


def override_action(df: DataFrame, action_col: str = "recommended_action", flags_col: str = "safety_flags") -> DataFrame:
    """Turn a blocked action into ``review`` and record that in the flags."""
    blocked = is_action_blocked(F.col(action_col), F.col(flags_col))
    return df.withColumns(
        {
            action_col: F.when(blocked, F.lit(fixed.REVIEW_ACTION)).otherwise(F.col(action_col)),
            flags_col: F.when(
                blocked, union_flags(F.col(flags_col), F.array(F.lit(fixed.FLAG_OVERRIDDEN)))
            ).otherwise(F.col(flags_col)),
        }
    )
