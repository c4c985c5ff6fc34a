"""Adds a struct column computed from whole texts, beside all columns of the table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textprep.llm.batches import CHUNK_BYTES, in_pieces


def free_name(docs: DataFrame, wanted: str) -> str:
    """`wanted`, with as many underscores as it takes not to clash with a column (Spark ignores case)."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def annotated(
    docs: DataFrame,
    name: str,
    fields: str,
    work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], list],
    limit: int = CHUNK_BYTES,
    text: str = "text",
) -> DataFrame:
    """`docs` with the struct `name`; `work(rows, bytes, offsets)` returns one array per field for some rows."""
    struct = T._parse_datatype_string(fields)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, struct)])
    kinds = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in in_pieces(batch, text, limit):
                arrays = [
                    a if isinstance(a, pa.Array) else pa.array(a, kind.type)
                    for a, kind in zip(work(rows, data, offsets), kinds, strict=True)
                ]
                column = pa.StructArray.from_arrays(arrays, names=kinds.names)
                yield pa.RecordBatch.from_arrays([*rows.columns, column], [*rows.schema.names, name])

    return docs.mapInArrow(run, schema)
