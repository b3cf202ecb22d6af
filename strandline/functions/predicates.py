"""Predicates and small column functions whose null rules differ from Spark's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(column: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Regex search that is false, not null, on null."""
    return F.coalesce(column.rlike(("(?i)" if ignore_case else "") + pattern), F.lit(False))


def is_in(column: Column, values: list | tuple) -> Column:
    """Membership that is false, not null, on null."""
    return F.coalesce(column.isin(*values), F.lit(False)) if values else F.lit(False)


def contains_any(column: Column, words: tuple[str, ...], ignore_case: bool = False) -> Column:
    """Whether one of the words occurs; false on null."""
    text = F.lower(column) if ignore_case else column
    found = F.lit(False)
    for w in words:
        found = found | F.coalesce(text.contains(w.lower() if ignore_case else w), F.lit(False))
    return found


def number(column: Column) -> Column:
    """Numeric coercion: what can't be read is null."""
    return column.cast("string").try_cast("double")


def first_of(columns: list[str]) -> Column:
    """First non-null value from left to right; null without columns."""
    return F.coalesce(*(F.col(f"`{c}`") for c in columns)) if columns else F.lit(None)


def is_true(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value to a variable, so that it is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pinned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds or replaces columns that later expressions use often; a generator keeps the optimiser from repeating their computation."""
    kept = [c for c in df.columns if c not in columns]
    row = F.explode(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))).alias("_pinned")
    return df.select(*kept, row).select(*kept, *(F.col(f"_pinned.{k}").alias(k) for k in columns))
