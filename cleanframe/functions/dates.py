"""Dates held as text.

Every accepted shape is rewritten to ``year-month-day time`` and cast to
``timestamp_ntz``, so the session time zone never moves a value.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_TIME = r"([ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)?"
_YEAR_LAST = rf"^(\d{{1,2}})[/.\-](\d{{1,2}})[/.\-](\d{{4}}){_TIME}$"
_YEAR_FIRST = rf"^(\d{{4}})[/.\-](\d{{1,2}})[/.\-](\d{{1,2}}){_TIME}$"
# Two-digit years: 00 to 75 belong to this century, 76 to 99 to the last
_SHORT_DAY = r"^(?<day>\d{1,2}[/.\-]\d{1,2}[/.\-])"
_THIS_CENTURY = rf"{_SHORT_DAY}(?<year>[0-6]\d|7[0-5]){_TIME}$"
_LAST_CENTURY = rf"{_SHORT_DAY}(?<year>7[6-9]|[89]\d){_TIME}$"
_NORMAL = rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}{_TIME}$"

# Spellings that are rewritten first: a zone or half of the day after the time, a month by name.
_ZONED = r"^(.*:\d{2}(?:\.\d{1,9})?(?: ?[AaPp][Mm])?) ?(Z|UTC|GMT|[+-]\d{2}:?\d{2})$"
_HALF = r"^([^:]*[^\d:](\d{1,2}):\d{2}(?::\d{2}(?:\.\d{1,9})?)?) ?([AaPp])[Mm]$"
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH_WORD = r"(?i)\b(" + "|".join(f"{name}|{name[:3]}" for name in _MONTHS) + r")\b\.?"
_DAY_MONTH = r"^(\d{1,2})[ \-/]m(\d{2}),?[ \-/](\d{4})"
_MONTH_DAY = r"^m(\d{2}) (\d{1,2}),? (\d{4})"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?=$|[ T])"

# What a spelled date can be made of; any other text is not looked at further.
_SPELLED = r"^(?=.*\d)[\dA-Za-z ,./:+\-]{6,60}$"

# Fixed pattern: what a value must contain before a column is tested for dates.
DATE_LIKE = r"\d{1,4}[/\-.]\d{1,2}[/\-.]\d{1,4}"


def _normalised(s: Column, year_last: str) -> Column:
    """Timestamp of a value in one of the shapes, read with one day/month order."""
    s = F.regexp_replace(s, _YEAR_LAST, year_last)
    s = F.regexp_replace(s, _YEAR_FIRST, "$1-$2-$3$4")
    # The extraction keeps out what the cast alone would take, such as a bare year
    return F.regexp_extract(s, _NORMAL, 0).try_cast("timestamp_ntz")


def parse_date(c: Column, day_first: bool = True) -> Column:
    """Timestamp from mixed date formats; the other day/month order is the fallback.

    A time with a zone is moved to UTC.
    """
    s = strip(c)
    return F.coalesce(_numeric_date(s, day_first), F.when(s.rlike(_SPELLED), _spelled_date(s, day_first)))


def _spelled_date(s: Column, day_first: bool) -> Column:
    """Timestamp of a value with a zone, AM or PM, a month by name, or without separators."""
    zone = F.regexp_extract(s, _ZONED, 2)
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.right(zone, F.lit(2)).try_cast("int")
    minutes = F.coalesce(F.when(F.startswith(zone, F.lit("-")), -minutes).otherwise(minutes), F.lit(0))
    s = F.regexp_replace(s, _ZONED, "$1")
    half = F.lower(F.regexp_extract(s, _HALF, 3))
    hour = F.regexp_extract(s, _HALF, 2).try_cast("int")
    shift = F.when(half == "", 0).when(hour.between(1, 12), F.when(half == "a", F.when(hour == 12, -12).otherwise(0)).when(hour == 12, 0).otherwise(12))
    s = F.regexp_replace(s, _HALF, "$1")
    number = F.create_map(*[F.lit(v) for i, name in enumerate(_MONTHS, 1) for v in (name[:3], f"m{i:02d}")])
    month = F.element_at(number, F.lower(F.substring(F.regexp_extract(s, _MONTH_WORD, 1), 1, 3)))
    s = F.when(month.isNull(), s).otherwise(F.regexp_replace(s, F.lit(_MONTH_WORD), month))
    s = F.regexp_replace(F.regexp_replace(s, _DAY_MONTH, "$3-$2-$1"), _MONTH_DAY, "$3-$1-$2")
    s = F.regexp_replace(s, _COMPACT, "$1-$2-$3")
    return _numeric_date(s, day_first) + F.make_dt_interval(hours=shift, mins=-minutes)


def _numeric_date(s: Column, day_first: bool) -> Column:
    s = F.regexp_replace(s, _THIS_CENTURY, "${day}20${year}$3")
    s = F.regexp_replace(s, _LAST_CENTURY, "${day}19${year}$3")
    orders = ("$3-$2-$1$4", "$3-$1-$2$4")
    first, second = orders if day_first else orders[::-1]
    return F.coalesce(_normalised(s, first), _normalised(s, second))


def parse_date_format(c: Column, layout: str) -> Column:
    """Date in one explicit Spark datetime pattern; anything else is null."""
    return F.try_to_date(c, layout).cast("timestamp_ntz")


def date_or_none(text) -> datetime | None:
    """Date typed by a user, day first."""
    s = str(text).strip()
    found = re.fullmatch(r"(\d{1,4})[/.\-](\d{1,2})[/.\-](\d{1,4})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?)?", s)
    if not found:
        return None
    a, b, c = (int(v) for v in found.groups()[:3])
    clock = [int(v or 0) for v in found.groups()[3:]]
    tries = [(a, b, c)] if len(found.group(1)) == 4 else [(c, b, a), (c, a, b)]
    for year, month, day in tries:
        try:
            return datetime(year, month, day, *clock)
        except ValueError:
            continue
    return None
