"""Distinct set operations (X1-X3); columns are matched by name."""

from __future__ import annotations

from pyspark.sql import DataFrame


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows of both."""
    return a.unionByName(b).distinct()


def union_changes(a: DataFrame, b: DataFrame) -> bool:
    """Whether ``b`` adds a row to ``a``."""
    return not b.select(*a.columns).join(a, a.columns, "left_anti").isEmpty()


def set_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows in both."""
    return a.intersect(b.select(*a.columns))


def set_subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows of ``a`` that are not in ``b``."""
    return a.subtract(b.select(*a.columns))
