"""Decisions that depend on the measured size of an input."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_BROADCAST_BYTES = 32 * 1024 * 1024


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes of the rows as JSON text) by one distributed aggregate."""
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).first()
    return row["rows"], row["bytes"] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, int]:
    """(`df`, hinted only when it fits the bound, and its row count); otherwise Spark shuffles."""
    rows, size = measured(df)
    return (F.broadcast(df) if size <= max_bytes else df), rows

