"""Costly columns that a filter reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is evaluated once per row even when a filter uses it.

    A filter on a projected column is pushed below the projection together with a copy of the
    expression, so a token count or a parse would run twice on every row.  A generator over a
    one-element array has the same result and is not copied.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.array(value)).alias(name))
