"""Safe parsing and safe division, free of session settings: bad input is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a number, a plain number, a digit code, a four-digit year and a whole
# number. White space around is allowed where a cast allows it. Nothing here needs backtracking, and
# cells that do not match are not cast: a failing cast costs far more than a failing match.
NUMBER = r"^\s*+[+-]?(?:\d++\.?+\d*+|\.\d++)(?:[eE][+-]?\d++)?\s*+$"
PLAIN_NUMBER = r"^\s*+-?\d++(?:\.\d++)?\s*+$"
DIGITS = r"^\d+$"
YEAR = r"^\s*+\d{4}\s*+$"
WHOLE = r"^\s*+[+-]?\d++\s*+$"
EPSILON = 1e-9


def number_text(c: Column) -> Column:
    """Text of a number without thousands commas."""
    return F.replace(c, F.lit(","), F.lit(""))


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def safe_double(c: Column) -> Column:
    """Text to double, or null. ``12d``, ``NaN`` and ``inf`` are not numbers here."""
    text = number_text(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def safe_int(c: Column) -> Column:
    """Text to int, or null; a fraction is cut off, as a cast from double does."""
    return safe_double(c).try_cast("int")


def matched(c: Column, pattern: str, to: str) -> Column:
    """Text cast to ``to`` where it matches ``pattern``, else null."""
    return F.when(c.rlike(pattern), c.try_cast(to))


def typed(df: DataFrame, name: str, kind: str) -> Column:
    """Column ``name`` of ``df`` as ``kind``; columns that are numeric already are only cast.

    Kinds: ``string``, ``label`` (lower case, outer spaces cut), ``digits`` (digit code or null),
    ``year`` (four digits), ``number``, ``double``, ``int``. ``number`` accepts plain decimal text
    and text with thousands commas; it is ``double`` without exponents.
    """
    field = df.schema[name]
    c = F.col(f"`{name}`")
    numeric = isinstance(field.dataType, T.NumericType)
    if kind == "string":
        return c.cast("string")
    if kind == "label":
        return normal_text(c.cast("string"))
    if kind == "digits":
        text = c.cast("string")
        return F.when(text.rlike(DIGITS), text)
    if kind == "year":
        if numeric:
            return F.when(c.between(1000, 9999), c.try_cast("int"))
        return matched(number_text(c), YEAR, "int")
    if kind == "int":
        return c.try_cast("int") if numeric else safe_int(c)
    if kind == "number" and not numeric:
        return matched(number_text(c), PLAIN_NUMBER, "double")
    if kind in ("double", "number"):
        return no_nan(c.cast("double")) if numeric else safe_double(c)
    raise ValueError(f"unknown kind {kind!r}")


def normal_text(c: Column) -> Column:
    return F.lower(F.trim(c))


def guarded_ratio(num: Column, den: Column, guard: Column | None = None) -> Column:
    """``num / den`` where ``guard`` (default ``den``) is above zero, else null."""
    return F.when((den if guard is None else guard) > 0, F.try_divide(num, den))


def epsilon_ratio(num: Column, den: Column) -> Column:
    """``num / (den + 1e-9)``: the serving ratio, large but finite for a zero denominator."""
    return F.try_divide(num, den + F.lit(EPSILON))
