"""Numbers held as text, and rounding."""

from __future__ import annotations

import re
from math import isfinite

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import is_null_spelling, strip

# Fixed patterns: a number after clean-up, and the two locale shapes counted by inference.
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
COMMA_DECIMAL = r"^-?(R\$)?\s?[\d.]*,\d+%?$"
DOT_DECIMAL = r"^-?(R\$)?\s?[\d,]*\.\d+%?$"


def parse_number(c: Column, decimal_comma: bool = False) -> Column:
    """Double from text such as ``R$ 1.500,00`` or ``12%``; anything else is null.

    The guard keeps out what a cast would accept but is no number here:
    ``inf``, ``nan``, ``1.5d``.
    """
    s = F.regexp_replace(c, r"(?U)[R$%\s\x1c-\x1f]", "")
    if decimal_comma:
        s = F.translate(s, ",.", ".")
    # The extraction is the guard: no match gives '', which casts to null
    return F.regexp_extract(s, PLAIN_NUMBER, 0).try_cast("double")


def clean_value(c: Column) -> Column:
    """Stripped value, null for null spellings."""
    s = strip(c)
    return F.when(~is_null_spelling(s), s)


def comma_decimal_hit(c: Column) -> Column:
    return c.rlike(COMMA_DECIMAL)


def dot_decimal_hit(c: Column) -> Column:
    return c.rlike(DOT_DECIMAL)


def number_text(c: Column) -> Column:
    """A floating-point number as text: plain digits from 1e-4 to below 1e16, else like ``1e+16``."""
    s, size = c.cast("string"), F.abs(c)
    digits = F.regexp_replace(s.try_cast("decimal(38,21)").cast("string"), r"0+$", "")
    power = F.regexp_replace(s, r"(?:\.0)?E(\d)", "e+$1")
    power = F.regexp_replace(F.regexp_replace(power, r"(?:\.0)?E-(\d)$", "e-0$1"), r"(?:\.0)?E-", "e-")
    # Between these bounds the cast gives plain digits by itself.
    short = (size == 0) | (size >= 1e-3) & (size < 1e7)
    return F.when(short, s).when((size >= 1e-4) & (size < 1e16), F.regexp_replace(digits, r"\.$", ".0")).otherwise(power)


def as_text(c: Column, dtype: T.DataType) -> Column:
    """A column of any type as text."""
    return number_text(c) if isinstance(dtype, (T.FloatType, T.DoubleType)) else c.cast("string")


def round_half_even(c: Column) -> Column:
    return F.rint(c)


def number_or_none(text) -> float | None:
    """A number given as an argument, under the guard that text columns have too.

    Decimal comma or point; ``nan``, ``inf`` and ``1_000`` are no numbers here.
    """
    if isinstance(text, (int, float)) and not isinstance(text, bool):
        return float(text) if isfinite(text) else None
    found = re.match(PLAIN_NUMBER, f"{text}".replace(",", ".", 1).strip())
    return float(found[0]) if found else None
