"""Plan shape helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add an expensive column that later filters read instead of recomputing.

    Predicate pushdown copies the definition of a projected column into every filter
    on it, and again for each reference inside. A one-row generator is a boundary the
    optimizer does not push such predicates through.
    """
    keep = [c for c in df.columns if c != name]
    return df.select(*keep, F.explode(F.array(expr)).alias(name))
