"""Vectors of texts, kept by content: a text is encoded once for each encoder, however often and in whatever table it comes.

The store holds (key, embedding) by encoder, the key being a digest of the text. A run encodes only the texts whose key
the store does not hold yet; the encoder is set up once for each Python worker, not for each batch.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

register_pickle_by_value(sys.modules[__name__])

BATCH_TEXTS = 256
_SCHEMA = "key binary, embedding array<float>"


@dataclass(frozen=True)
class Encoder:
    """`name` stands for the model and its version; `load` sets it up and returns the function that encodes a list of texts."""

    name: str
    load: Callable[[], Callable[[list[str]], np.ndarray]]
    batch_texts: int = BATCH_TEXTS


def text_key(text: Column) -> Column:
    """SHA-256 of the text; NULL and "" are one text."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def _encoding(encoder: Encoder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None  # set up when the first text comes: a task without new texts loads no model
        for batch in batches:
            for first in range(0, batch.num_rows, encoder.batch_texts):
                part = batch.slice(first, encoder.batch_texts)
                encode = encode or encoder.load()
                vectors = np.asarray(encode([t or "" for t in part.column("text").to_pylist()]), np.float32)
                if len(vectors) != part.num_rows:
                    raise ValueError(f"{encoder.name} gave {len(vectors)} vectors for {part.num_rows} texts")
                ends = pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("key"), lists], ["key", "embedding"])

    return run


def stored(spark: SparkSession, path: str, encoder: Encoder) -> DataFrame:
    """(key, embedding) of all texts that the encoder has encoded."""
    try:
        return spark.read.schema(_SCHEMA).parquet(f"{path}/encoder={encoder.name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMA)


def unseen(texts: DataFrame, path: str, encoder: Encoder, text_col: str = "text") -> DataFrame:
    """(key, text) of the distinct texts that are not in the store; of the store only keys are read."""
    keyed = texts.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    known = stored(texts.sparkSession, path, encoder).select("key")
    return keyed.join(known, "key", "left_anti").dropDuplicates(["key"])


def add(texts: DataFrame, path: str, encoder: Encoder, text_col: str = "text") -> None:
    """Encode what is not in the store and add it. A run that fails adds nothing of its last job and may be repeated."""
    new = unseen(texts, path, encoder, text_col).mapInArrow(_encoding(encoder), _SCHEMA)
    new.write.mode("append").parquet(f"{path}/encoder={encoder.name}")


def encoded(texts: DataFrame, path: str, encoder: Encoder, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, embedding) of every row, copies of a text included, after adding what is new to the store."""
    add(texts, path, encoder, text_col)
    # two runs at once may both have added a text: its vectors are equal
    vectors = stored(texts.sparkSession, path, encoder).dropDuplicates(["key"])
    keyed = texts.select(id_col, text_key(F.col(text_col)).alias("key"))
    return keyed.join(vectors, "key").select(id_col, "embedding")
