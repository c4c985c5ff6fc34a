"""Vector columns as numpy matrices, and their moments over a whole table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows of double components, which rows hold a vector of finite components).

    Shorter vectors are filled with zeros up to `width` (the longest, unless given); a null or non-finite
    component, or a null vector, makes the row unusable, and its components zero.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    present = pc.is_valid(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max(initial=0)) if width is None else width
    if len(flat) == len(column) * width and (lengths == width).all():
        values = flat.reshape(len(column), width)
    else:
        values = np.zeros((len(column), width))
        row = np.repeat(np.arange(len(column)), lengths)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        inside = place < width
        values[row[inside], place[inside]] = flat[inside]
    usable = present & np.isfinite(values).all(axis=1)
    if not usable.all():
        values = np.where(usable[:, None], values, 0.0)
    return values, usable


def moments(vectors: DataFrame, scale: float | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, variance of each component, usable rows) of the column `embedding`; one row per component reaches the driver.

    With `scale` the components are floor(scale * x).
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total, squares = 0, np.zeros(0), np.zeros(0)
        for batch in batches:
            values, usable = matrix(batch.column(0))
            values = values[usable]
            if scale is not None:
                values = np.floor(values * scale)
            if values.shape[1] > len(total):
                more = values.shape[1] - len(total)
                total, squares = np.append(total, np.zeros(more)), np.append(squares, np.zeros(more))
            rows += len(values)
            total[: values.shape[1]] += values.sum(axis=0)
            squares[: values.shape[1]] += np.einsum("ij,ij->j", values, values)
        # the row -1 counts the vectors, which may all be empty
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(-1, len(total)), pa.int32()),
                pa.array(np.append(float(rows), total)),
                pa.array(np.append(0.0, squares)),
            ],
            ["place", "total", "squares"],
        )

    parts = vectors.select("embedding").mapInArrow(sums, "place int, total double, squares double")
    found = {r["place"]: r for r in parts.groupBy("place").agg(F.sum("total").alias("t"), F.sum("squares").alias("s")).collect()}
    rows = int(found[-1]["t"]) if -1 in found else 0
    width = max(found, default=-1) + 1
    mean = np.array([found[j]["t"] for j in range(width)]) / max(1, rows)
    square = np.array([found[j]["s"] for j in range(width)]) / max(1, rows)
    return mean, np.maximum(square - mean**2, 0.0), rows


def first_of_each(key: np.ndarray, score: np.ndarray, ident: np.ndarray, n: int) -> np.ndarray:
    """Indices of the `n` entries of each key with the largest score; ties go to the smaller id."""
    order = np.lexsort((ident, -score, key))
    ranked = key[order]
    return order[np.arange(len(order)) - np.searchsorted(ranked, ranked, side="left") < n]
