"""Queries over the given tables, one per operator."""

from . import charts, cleaning, full, imputation, profiling, structure  # noqa: F401
from .registry import all_oracles, all_queries

__all__ = ["all_oracles", "all_queries"]
