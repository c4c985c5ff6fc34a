"""Incremental writes: reruns, repeats and late arrivals."""

import numpy as np
import pyarrow as pa

from textprep.session import shared_path
from textprep.streaming import incremental, key_index
from textprep.streaming.key_index import KeyIndex


def sink_rows(spark, sink):
    return sorted(((r["id"], r["v"]) for r in incremental.read_sink(spark, sink).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_each_key_is_written_once(spark):
    arrivals, sink, state = (shared_path(spark, n) for n in ("in", "out", "state"))
    frame = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string")

    def arrive(df):
        df.coalesce(1).write.mode("append").parquet(arrivals)
        incremental.run(spark, arrivals, frame.schema, sink, state, "id", files_per_batch=1)

    arrive(frame)
    assert sink_rows(spark, sink) == [(1, "a"), (2, "b")]
    incremental.run(spark, arrivals, frame.schema, sink, state, "id")  # nothing new
    arrive(spark.createDataFrame([(2, "b"), (3, "c")], frame.schema))
    arrive(frame)
    assert sink_rows(spark, sink) == [(1, "a"), (2, "b"), (3, "c")]


def test_a_lost_checkpoint_rewrites_the_same_rows(spark):
    arrivals, sink = shared_path(spark, "in"), shared_path(spark, "out")
    frame = spark.createDataFrame([(i, "x") for i in range(20)], "id long, v string")
    frame.repartition(3).write.parquet(arrivals)
    for _ in range(2):
        incremental.run(spark, arrivals, frame.schema, sink, shared_path(spark, "state"), "id")
    assert [i for i, _ in sink_rows(spark, sink)] == list(range(20))


def test_a_lost_checkpoint_after_two_batches(spark):
    arrivals, sink = shared_path(spark, "in"), shared_path(spark, "out")
    schema = "id long, v string"
    for rows in ([(1, "a")], [(2, "b")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(arrivals)
    frame = spark.createDataFrame([], schema)
    for _ in range(3):
        incremental.run(spark, arrivals, frame.schema, sink, shared_path(spark, "state"), "id", files_per_batch=1)
    assert sink_rows(spark, sink) == [(1, "a"), (2, "b")]


def test_a_second_source_into_the_same_sink(spark):
    sink = shared_path(spark, "out")
    for rows in ([(1, "a"), (3, "x")], [(2, "b"), (3, "y")]):
        arrivals = shared_path(spark, "in")
        frame = spark.createDataFrame(rows, "id long, v string")
        frame.write.parquet(arrivals)
        incremental.run(spark, arrivals, frame.schema, sink, shared_path(spark, "state"), "id")
    assert sink_rows(spark, sink) == [(1, "a"), (2, "b"), (3, "x")]


def test_a_repeated_batch_writes_the_same_row(spark):
    """Of several rows with one key the same one stays, whatever the order they come in."""
    found = set()
    for parts in (1, 3, 5):
        arrivals, sink, state = (shared_path(spark, n) for n in ("in", "out", "state"))
        frame = spark.createDataFrame([(1, c) for c in "abcdefgh"], "id long, v string").repartition(parts)
        frame.write.parquet(arrivals)
        incremental.run(spark, arrivals, frame.schema, sink, state, "id")
        found |= set(sink_rows(spark, sink))
    assert len(found) == 1


def test_a_batch_of_new_keys_reads_no_earlier_key(spark, monkeypatch):
    """Whatever the history, only buckets with a suspected key are read."""
    arrivals, sink, state = (shared_path(spark, n) for n in ("in", "out", "state"))
    read, earlier = [], KeyIndex._earlier
    monkeypatch.setattr(KeyIndex, "_earlier", lambda self, units, buckets: read.append((len(units), buckets)) or earlier(self, units, buckets))

    def arrive(ids):
        frame = spark.createDataFrame([(i, "x") for i in ids], "id long, v string")
        frame.coalesce(1).write.mode("append").parquet(arrivals)
        incremental.run(spark, arrivals, frame.schema, sink, state, "id", buckets=8, compact_every=3)

    for n in range(4):
        arrive(range(100 * n, 100 * n + 100))
    assert read == []
    arrive([5, 1_000])
    assert len(read) == 1 and len(read[0][1]) == 1 and read[0][0] <= 3  # one bucket; batches 0 and 1 are merged
    assert [i for i, _ in sink_rows(spark, sink)] == [*range(400), 1_000]


def test_a_crash_between_data_and_index(spark, monkeypatch):
    arrivals, sink = shared_path(spark, "in"), shared_path(spark, "out")
    frame = spark.createDataFrame([(1, "a"), (None, "n")], "id long, v string")
    frame.coalesce(1).write.parquet(arrivals)
    with monkeypatch.context() as patched:
        patched.setattr(KeyIndex, "add", lambda self, batch: None)
        incremental.run(spark, arrivals, frame.schema, sink, shared_path(spark, "state"), "id")
    spark.createDataFrame([(2, "b")], frame.schema).coalesce(1).write.mode("append").parquet(arrivals)
    incremental.run(spark, arrivals, frame.schema, sink, shared_path(spark, "state"), "id")
    assert sink_rows(spark, sink) == [(1, "a"), (2, "b"), (None, "n")]


def test_filters_hold_their_keys_and_few_others():
    draw = np.random.default_rng(1)
    hashes = draw.integers(-(2**63), 2**63 - 1, (2, 20_000))

    def table(part):
        return pa.table({"key": hashes[0, part], "bucket": pa.array([3] * len(hashes[0, part]), pa.int32()), "h1": hashes[0, part], "h2": hashes[1, part]})

    bloom = key_index._bloom(table(slice(0, 10_000)))
    assert key_index._suspected(table(slice(0, 10_000)), bloom).num_rows == 10_000
    assert key_index._suspected(table(slice(10_000, None)), bloom).num_rows < 5
