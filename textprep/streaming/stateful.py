"""De-duplication in stream state: keyed, kept on disk by RocksDB, forgotten some time after arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def deduplicated(stream: DataFrame, key: str, arrival: str, keep_for: str) -> DataFrame:
    """The first row of each key; a key is forgotten `keep_for` after the latest arrival has passed its own.

    State is partitioned by the key and holds one time for each key not yet forgotten, so its size follows the
    arrivals of `keep_for` and not the history.
    """
    return stream.withWatermark(arrival, keep_for).dropDuplicatesWithinWatermark([key])


def run(
    spark: SparkSession,
    arrivals: str,
    schema: T.StructType,
    sink: str,
    checkpoint: str,
    key: str,
    arrival: str,
    keep_for: str = "30 days",
    files_per_batch: int | None = None,
) -> None:
    """Append the new keys of everything that has arrived to a Parquet sink, then stop.

    State and progress are in `checkpoint`: a restart goes on from there, and the sink's own log keeps a repeated
    batch from writing twice. (`incremental.run` instead recognises keys by the sink, without a time limit.)
    """
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # a query takes it over when it starts
    try:
        reader = spark.readStream.schema(schema)
        if files_per_batch is not None:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        rows = deduplicated(reader.parquet(arrivals), key, arrival, keep_for)
        query = (
            rows.writeStream.format("parquet")
            .option("checkpointLocation", checkpoint)
            .option("path", sink)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
