"""Manual value replacements.

A rule is ``{column or None, find, replace, mode, case}``; rules run in order, each on
the outcome of the one before. An empty replacement means null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import as_text, number_or_none
from ..functions.text import strip
from ..functions.vocabulary import RULE_MODES, label
from ..schema import dtype_of, is_numeric, quoted


@dataclass
class Replaced:
    """Outcome of a rule chain: the data, and how to count the hits of each rule."""

    df: DataFrame
    rules: list[dict]
    counted: DataFrame
    hit_columns: list[str | None] = field(default_factory=list)
    errors: list[str | None] = field(default_factory=list)

    def hit_counts(self) -> DataFrame:
        """Rows ``(rule, column, mode, hits)``, computed by one aggregate over the chain."""
        return _hits_long(self)


def java_pattern(pattern: str) -> str:
    """Python regex syntax in Java terms (named groups, Unicode classes).

    Groups are renamed by their number, since Java allows fewer characters in names.
    """
    for name, number in re.compile(pattern).groupindex.items():
        pattern = re.sub(rf"(?<!\\)((?:\\\\)*)\(\?P<{name}>", rf"\1(?<g{number}>", pattern)
        pattern = re.sub(rf"(?<!\\)((?:\\\\)*)\(\?P={name}\)", rf"\1\\k<g{number}>", pattern)
    return "(?U)" + pattern


def java_replacement(text: str, pattern: str = "") -> str:
    """Python replacement template (``\\1``, ``\\g<name>``) in Java terms."""
    named = re.compile(pattern).groupindex
    parts = re.split(r"(\\g<\w+>|\\\d{1,2})", text)
    result = ""
    for part in parts:
        if re.fullmatch(r"\\\d{1,2}", part):
            result += "$" + part[1:]
        elif part.startswith("\\g<"):
            name = part[3:-1]
            result += f"${{g{named[name]}}}" if name in named else "$" + name
        else:
            result += part.replace("\\", "\\\\").replace("$", "\\$")
    return result


def _literal_pattern(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def pattern_error(df: DataFrame, pattern: str) -> str | None:
    """Why a regex is invalid, or None."""
    try:
        re.compile(pattern)
        df.sparkSession.range(1).select(F.lit("").rlike(java_pattern(pattern))).collect()
    except re.error as e:
        return str(e)
    except PySparkException as e:
        return str(e).splitlines()[0]
    return None


def _text_change(c: Column, find: str, repl: str, mode: str, case: bool) -> tuple[Column, Column]:
    """(hit, new value) of a rule on text."""
    if mode == "exact":
        hit = (c == F.lit(find)) if case else (F.lower(c) == F.lower(F.lit(find)))
        return hit, F.lit(repl if repl != "" else None).cast("string")
    if mode == "contains":
        if case:
            hit, new = c.contains(find), F.replace(c, F.lit(find), F.lit(repl))
        else:
            pattern = "(?iu)" + _literal_pattern(find)
            hit, new = c.rlike(pattern), F.regexp_replace(c, pattern, re.sub(r"([\\$])", r"\\\1", repl))
    else:
        pattern = ("" if case else "(?i)") + java_pattern(find)
        hit, new = c.rlike(pattern), F.regexp_replace(c, pattern, java_replacement(repl, find))
    return hit, F.when(strip(new) != "", new)


def _column_change(df: DataFrame, name: str, find: str, repl: str, mode: str, case: bool) -> tuple[Column, Column]:
    """(hit, new column) of a rule on one column of any type."""
    c, dtype = quoted(name), dtype_of(df, name)
    if mode == "exact" and is_numeric(dtype):
        number = number_or_none(find)
        if number is not None:
            hit = F.coalesce(c == F.lit(number), F.lit(False))
            target = number_or_none(repl)
            if repl == "":
                return hit, F.when(~hit, c)
            if target is None:
                return hit, F.when(hit, F.lit(repl)).otherwise(as_text(c, dtype))
            if isinstance(dtype, T.IntegralType) and not target.is_integer():
                return hit, F.when(hit, F.lit(target)).otherwise(c.cast("double"))
            return hit, F.when(hit, F.lit(target).cast(dtype)).otherwise(c)
    text = as_text(c, dtype)
    hit, new = _text_change(text, find, repl, mode, case)
    hit = F.coalesce(hit, F.lit(False))
    return hit, F.when(hit, new).otherwise(text)


def _targets(df: DataFrame, find: str, repl: str, mode: str, case: bool) -> list[str]:
    """Columns an unnamed rule applies to.

    Text columns always; numeric columns when the rule keeps them numeric. A rule that
    would turn other columns into text does so only where it hits, which takes a count.
    """
    chosen, undecided = [], []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            chosen.append(f.name)
        elif mode != "exact":
            continue
        elif is_numeric(f.dataType) and number_or_none(find) is not None:
            keeps_type = repl == "" or number_or_none(repl) is not None
            (chosen if keeps_type else undecided).append(f.name)
        elif isinstance(f.dataType, T.BooleanType):
            undecided.append(f.name)
    if undecided:
        hits = df.agg(
            *[F.count_if(_column_change(df, n, find, repl, mode, case)[0]).alias(f"h{i}") for i, n in enumerate(undecided)]
        ).first()
        chosen += [n for i, n in enumerate(undecided) if hits[f"h{i}"]]
    return [n for n in df.columns if n in chosen]


def apply_rules(df: DataFrame, rules: list[dict], skip: tuple = ()) -> Replaced:
    """Fold the rules over the table, keeping a per-row hit count of each rule.

    Columns in ``skip`` are out of reach of rules without a column.
    """
    names = df.columns
    result = Replaced(df, list(rules), df)
    for i, rule in enumerate(rules):
        column, find, repl = rule.get("column"), str(rule["find"]), str(rule.get("replace") or "")
        mode, case = label(rule.get("mode", "exact")), bool(rule.get("case", False))
        if mode not in RULE_MODES:
            raise ValueError(f"unknown rule mode: {mode!r}")
        if column is not None and column not in names:
            raise ValueError(f"rule names a missing column: {column!r}")
        error = pattern_error(df, find) if mode == "regex" else None
        result.errors.append(error)
        if error:
            result.hit_columns.append(None)
            continue
        state = df.select(*[quoted(n) for n in names])
        open_columns = state.select(*[quoted(n) for n in names if n not in skip])
        targets = [column] if column is not None else _targets(open_columns, find, repl, mode, case)
        changes = {n: _column_change(df, n, find, repl, mode, case) for n in targets}
        hits = f"__hits_{i}"
        total = F.lit(0)
        for hit, _ in changes.values():
            total = total + F.when(hit, 1).otherwise(0)
        df = df.withColumns({**{n: new for n, (_, new) in changes.items()}, hits: total.cast("long")})
        result.hit_columns.append(hits)
    result.df = df.select(*[quoted(n) for n in names])
    result.counted = df
    return result


def _hits_long(result: Replaced) -> DataFrame:
    counted = result.counted.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.coalesce(F.sum(h), F.lit(0)).alias(h) for h in result.hit_columns if h],
    )
    rows = [
        F.struct(
            F.lit(i + 1).alias("rule"),
            F.lit(r.get("column")).cast("string").alias("column"),
            F.lit(label(r.get("mode", "exact"))).alias("mode"),
            (F.col(h) if h else F.lit(0)).cast("long").alias("hits"),
        )
        for i, (r, h) in enumerate(zip(result.rules, result.hit_columns))
    ]
    return counted.select(F.inline(F.array(*rows)))
