"""Booleans held as text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip
from .vocabulary import FALSE_SPELLINGS, TRUE_SPELLINGS


def parse_boolean(c: Column) -> Column:
    s = F.lower(strip(c.cast("string")))
    return F.when(s.isin(*TRUE_SPELLINGS), True).when(s.isin(*FALSE_SPELLINGS), False)


def is_boolean_spelling(c: Column) -> Column:
    return F.lower(c).isin(*TRUE_SPELLINGS, *FALSE_SPELLINGS)
