"""Which keys a sink holds, by hash buckets with a Bloom filter each.

Every micro-batch leaves a unit beside its data: its keys by bucket, a Bloom filter of each bucket, and, written last, the
batches that the unit covers. A later batch tests its keys against the filters and reads only the buckets in which some
filter says yes, so a batch of new keys reads no earlier key at all. `compact` merges the units of finished batches,
so that the number of filters stays bounded too. A data folder without a unit (a crash came between the two) is read
directly.

Layout below `<sink>/_keys/<unit>/`: keys/bucket=B/, blooms/ (bucket, bits), covers/ (run_id, batch_id). Readers of the
sink do not see folders that begin with an underscore.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, functions as F

register_pickle_by_value(sys.modules[__name__])

BUCKETS = 64
BITS_PER_KEY = 24  # one key in 100,000 is suspected wrongly
HASHES = 16

Batch = tuple[str, int]  # run_id, batch_id


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(folder)) if system.exists(folder) else []


def _places(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """Bits of each key: a row of HASHES places below `size`, which is a power of two."""
    steps = np.arange(HASHES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        places = first.view(np.uint64)[:, None] + steps * (second.view(np.uint64) | np.uint64(1))[:, None]
    return (places >> np.uint64(7)) & np.uint64(size - 1)


def _hashes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table["h1"].to_numpy(), table["h2"].to_numpy()


def _bloom(keys: pa.Table) -> pa.Table:
    """The filter of one bucket's keys."""
    size = 1 << max(10, int(keys.num_rows * BITS_PER_KEY - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[_places(*_hashes(keys), size).ravel()] = True
    return pa.table({"bucket": keys["bucket"][:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _suspected(keys: pa.Table, blooms: pa.Table) -> pa.Table:
    """Keys of one bucket that some filter may hold."""
    hit = np.zeros(keys.num_rows, bool)
    for bits in blooms["bits"]:
        packed = np.frombuffer(bits.as_buffer(), np.uint8)
        places = _places(*_hashes(keys), 8 * len(packed))
        hit |= ((packed[places >> np.uint64(3)] >> (7 - (places & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)
    return keys.select(["key", "bucket"]).filter(pa.array(hit))


@dataclass(frozen=True)
class KeyIndex:
    """The index of one sink; `buckets` must stay what it was when the sink was new."""

    spark: SparkSession
    sink: str
    key: str
    buckets: int = BUCKETS

    def _hashed(self, keys: DataFrame) -> DataFrame:
        """(key, bucket, h1, h2) of the distinct keys; NULL is a key like any other."""
        named = keys.select(F.col(self.key).alias("key")).distinct()
        hashes = [F.xxhash64(F.lit(n), "key") for n in (1, 2)]
        bucket = F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(self.buckets)).cast("int")
        return named.select("key", bucket.alias("bucket"), hashes[0].alias("h1"), hashes[1].alias("h2"))

    def _folder(self, unit: str, part: str) -> str:
        return f"{self.sink}/_keys/{unit}/{part}"

    def data_folders(self) -> set[Batch]:
        """Batches whose data the sink holds."""
        found = set()
        for run in children(self.spark, self.sink):
            if run.startswith("run_id="):
                for batch in children(self.spark, f"{self.sink}/{run}"):
                    if "_SUCCESS" in children(self.spark, f"{self.sink}/{run}/{batch}"):
                        found.add((run.removeprefix("run_id="), int(batch.removeprefix("batch_id="))))
        return found

    def units(self) -> dict[str, set[Batch]]:
        """Complete units and what they cover, without those that a merged unit covers as well."""
        names = [u for u in children(self.spark, f"{self.sink}/_keys") if "_SUCCESS" in children(self.spark, self._folder(u, "covers"))]
        if not names:
            return {}
        rows = self.spark.read.schema("unit string, run_id string, batch_id long").parquet(*[self._folder(u, "covers") for u in names])
        covers: dict[str, set[Batch]] = {}
        for row in rows.collect():  # a row for each batch
            covers.setdefault(row["unit"], set()).add((row["run_id"], row["batch_id"]))
        kept: dict[str, set[Batch]] = {}
        for unit, own in sorted(covers.items(), key=lambda x: (-len(x[1]), x[0])):
            if not any(own <= other for other in kept.values()):
                kept[unit] = own
        return kept

    def _earlier(self, units: list[str], buckets: list[int]) -> DataFrame:
        """What a batch reads of earlier keys: those of the buckets in which it has a suspect."""
        return self._keys(units, buckets)

    def _keys(self, units: list[str], buckets: list[int]) -> DataFrame:
        """Keys of some buckets; folders of other buckets are not read."""
        folders = [self._folder(u, f"keys/bucket={b}") for u in units for b in buckets]
        there = [f for f in folders if children(self.spark, f)]
        empty = self.spark.createDataFrame([], "key string")
        return self.spark.read.parquet(*there).select("key") if there else empty

    def unseen(self, rows: DataFrame, own: Batch) -> DataFrame:
        """Rows whose key no other batch has written."""
        units, data = self.units(), self.data_folders() - {own}
        covered = set().union(*units.values()) if units else set()
        others = [u for u, batches in units.items() if batches - {own}]
        found = []
        if others:
            keys = self._hashed(rows)
            blooms = self.spark.read.schema("bucket int, bits binary").parquet(*[self._folder(u, "blooms") for u in others])
            kind = rows.schema[self.key].dataType.simpleString()
            suspects = keys.groupBy("bucket").cogroup(blooms.groupBy("bucket")).applyInArrow(_suspected, f"key {kind}, bucket int")
            suspects = suspects.persist()
            touched = sorted(r["bucket"] for r in suspects.select("bucket").distinct().collect())  # at most `buckets`
            if touched:
                earlier = self._earlier(others, touched).select(F.col("key").cast(kind))
                found.append(suspects.select("key").join(earlier, suspects["key"].eqNullSafe(earlier["key"]), "left_semi"))
        if direct := sorted(data - covered):
            paths = [f"{self.sink}/run_id={r}/batch_id={b}" for r, b in direct]
            found.append(self.spark.read.schema(rows.schema).parquet(*paths).select(F.col(self.key).alias("key")))
        for seen in found:
            rows = rows.join(seen, rows[self.key].eqNullSafe(seen["key"]), "left_anti")
        return rows

    def _write(self, unit: str, hashed: DataFrame, covers: list[Batch]) -> None:
        tasks = min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        hashed = hashed.repartition(tasks, "bucket").persist()  # for the keys and for the filters
        hashed.select("key", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._folder(unit, "keys"))
        blooms = hashed.groupBy("bucket").applyInArrow(_bloom, "bucket int, bits binary")
        blooms.coalesce(1).write.mode("overwrite").parquet(self._folder(unit, "blooms"))
        hashed.unpersist()
        rows = self.spark.createDataFrame([(unit, r, b) for r, b in covers], "unit string, run_id string, batch_id long")
        rows.coalesce(1).write.mode("overwrite").parquet(self._folder(unit, "covers"))

    def add(self, batch: Batch) -> None:
        """Index a batch whose data is written."""
        rows = self.spark.read.parquet(f"{self.sink}/run_id={batch[0]}/batch_id={batch[1]}")
        self._write(f"{batch[0]}-{batch[1]}", self._hashed(rows), [batch])

    def compact(self) -> None:
        """Merge the units of all batches but each run's latest, which its query may still repeat."""
        units = self.units()
        latest: dict[str, int] = {}
        for run, batch in set().union(*units.values()) if units else ():
            latest[run] = max(batch, latest.get(run, batch))
        done = [u for u, batches in units.items() if not any(latest[r] == b for r, b in batches)]
        if len(done) < 2:
            return
        keys = self._keys(done, list(range(self.buckets))).select(F.col("key").alias(self.key))
        self._write(uuid.uuid4().hex, self._hashed(keys), sorted(set().union(*(units[u] for u in done))))
