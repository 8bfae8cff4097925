"""Text step over many columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.text import null_spellings_to_null, standardise
from ..schema import quoted

# Option names of the configuration and the arguments they set.
_OPTIONS = {
    "strip": "strip_ends", "collapse_spaces": "collapse", "case": "case", "accents": "accents",
    "special": "special", "empty_as_null": "empty_as_null", "single_accents_only": "single_accents_only",
}


def standardise_text(df: DataFrame, columns: list[str], **options) -> DataFrame:
    """Apply the text step to ``columns`` as projections, without a shuffle."""
    arguments = {_OPTIONS[k]: v for k, v in options.items()}
    if not columns:
        return df
    nulls = arguments.pop("empty_as_null", True)
    df = df.withColumns({n: standardise(quoted(n).cast("string"), **arguments, empty_as_null=False) for n in columns})
    # A second projection, so that the null test does not compute the text twice
    return df.withColumns({n: null_spellings_to_null(quoted(n)) for n in columns}) if nulls else df
