"""Seeded random draws as functions of the row id.

A draw depends on (seed, row id) only, never on partitioning, task order or retries, so a lost
executor recomputes the same value.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_BITS = 60


def _md5(seed: int | str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_key(seed: int | str, *parts: Column) -> Column:
    """A uniform integer in [0, 2**60): the sort key of every seeded shuffle."""
    return F.conv(F.substring(_md5(seed, *parts), 1, 15), 16, 10).cast("long")


def _word(seed: int | str, *parts: Column) -> Column:
    return F.conv(F.substring(_md5(seed, *parts), 1, 8), 16, 10).cast("long")


def pick(seed: int | str, n: int | Column, *parts: Column) -> Column:
    """A uniform integer in [0, n)."""
    return _word(seed, *parts) % n


def unit(seed: int | str, *parts: Column) -> Column:
    """A uniform double in [0, 1)."""
    return _word(seed, *parts).cast("double") / F.lit(float(2**32))


def shuffled(seed: int | str, row_id: Column, items: Column) -> Column:
    """The array in a seeded order, as structs (order, position, item); position is the old index."""
    keyed = F.transform(
        items,
        lambda item, i: F.struct(
            _md5(seed, row_id, i).alias("order"), i.alias("position"), item.alias("item")
        ),
    )
    return F.sort_array(keyed)
