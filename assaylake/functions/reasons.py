"""Reason codes: predicates become one array column per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reasons(rules: list[tuple[str | Column, Column]]) -> Column:
    """Array of the codes whose condition holds, in rule order, each once."""
    items = [F.when(F.coalesce(cond, F.lit(False)), F.lit(code) if isinstance(code, str) else code) for code, cond in rules]
    return F.array_distinct(F.array_compact(F.array(*items)))


def code_list(col: str | Column) -> Column:
    """Codes as one comma-separated text, for reports."""
    return F.array_join(col, ",")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    Inside higher-order functions Spark does not share common subexpressions, so an
    expression used twice would be evaluated twice at every level of nesting.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
