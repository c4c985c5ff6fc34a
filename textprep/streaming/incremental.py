"""Idempotent incremental writes: files that arrive over time, each key written once."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from textprep.streaming.key_index import BUCKETS, KeyIndex

COMPACT_EVERY = 32


def run(
    spark: SparkSession,
    arrivals: str,
    schema: T.StructType,
    sink: str,
    checkpoint: str,
    key: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    files_per_batch: int | None = None,
    buckets: int = BUCKETS,
    compact_every: int = COMPACT_EVERY,
) -> None:
    """Process everything that has arrived and is not processed yet, then stop.

    Every micro-batch owns the folder `run_id=<run>/batch_id=<n>` of the sink and replaces it as a
    whole, so a batch repeated after a failure rewrites itself.  The run is the id that the checkpoint
    gives the query: a lost checkpoint, or another source into the same sink, starts a run of its own and
    overwrites nothing.  Keys that any other batch has written are left out; an index of them by `buckets`
    (see `key_index`) is read only where its filters suspect a key, and merged every `compact_every`
    batches.  Of a batch's rows with one key the one with the least hash stays.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    index = KeyIndex(spark, sink, key, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch)
        columns = [F.col(c) for c in rows.columns]
        fresh = rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row"))
        fresh = fresh.select("_row.*").persist(StorageLevel.MEMORY_AND_DISK)  # its keys are tested, then it is written
        own = (_run_id(spark, checkpoint), batch_id)
        try:
            index.unseen(fresh, own).write.mode("overwrite").parquet(f"{sink}/run_id={own[0]}/batch_id={batch_id}")
        finally:
            fresh.unpersist()
        index.add(own)
        if batch_id % compact_every == compact_every - 1:
            index.compact()

    query = (
        reader.parquet(arrivals)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query, which Spark writes into its checkpoint before the first batch."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]


def read_sink(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink).drop("run_id", "batch_id")
