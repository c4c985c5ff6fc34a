"""One JSON array, however long, read by many tasks.

Spark's text reader cuts a file into byte ranges and each range at the closing braces. A range does not know whether
it begins inside a string, or how deep in brackets. A first pass over the ranges notes what each does to either state;
running sums of that, one row per range, give every range its state; a second pass then finds the records. A record
that a border cuts is put together from its fragments, of which a range has two at most.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from textprep.session import shared_path

register_pickle_by_value(sys.modules[__name__])

SPLIT_ABOVE = 16 << 20  # bytes of a file that one task may read
_CHUNK = 4 << 20  # bytes looked at together
_QUOTE, _BACKSLASH, _BRACES, _BRACKETS = 34, 92, (123, 125), (91, 93)
_SPACE = b" \t\r\n"


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(range, bytes with the closing braces put back) for runs of pieces of one range."""
    ranges = batch.column("range").to_numpy(zero_copy_only=False)
    values = batch.column("value").cast(pa.large_binary()).to_pylist()
    first = 0
    while first < len(values):
        last, size = first, 0
        while last < len(values) and ranges[last] == ranges[first] and size < _CHUNK:
            size += len(values[last]) + 1
            last += 1
        yield ranges[first], np.frombuffer(b"}".join(values[first:last]) + b"}", np.uint8)
        first = last


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of brackets, +1 or -1 each, parity of the unescaped quotes before each); the last entry stands for the end."""
    quotes = np.flatnonzero(data == _QUOTE)
    plain = np.flatnonzero(data != _BACKSLASH)
    before = np.searchsorted(plain, quotes)  # what stands between the last other byte and the quote are backslashes
    run = quotes - 1 - np.where(before > 0, plain[np.maximum(before, 1) - 1], -1)
    quotes = quotes[run % 2 == 0]
    opening = (data == _BRACES[0]) | (data == _BRACKETS[0])
    places = np.flatnonzero(opening | (data == _BRACES[1]) | (data == _BRACKETS[1]))
    step = np.where(opening[places], 1, -1)
    parity = np.searchsorted(quotes, np.append(places, len(data))) % 2
    return places, step, parity


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each range does: whether it flips the string state, and the depth it adds from either state."""
    found: dict[int, list] = {}
    names: dict[int, tuple] = {}
    for batch in batches:
        for number, data in _chunks(batch):
            if number not in found:
                row = int(np.flatnonzero(batch.column("range").to_numpy(zero_copy_only=False) == number)[0])
                names[number] = tuple(batch.column(c)[row].as_py() for c in ("file", "start"))
            own = found.setdefault(number, [0, 0, 0, None])
            places, step, parity = _marks(data)
            outside = (parity[:-1] ^ own[0]) == 0
            own[1] += int(step[outside].sum())
            own[2] += int(step[~outside].sum())
            own[0] ^= int(parity[-1])
            if own[3] is None:
                own[3] = data[: 1 << 16].tobytes().lstrip(_SPACE)[:1].decode("latin1") or None
    rows = [(*names[k], int(k), *v) for k, v in found.items()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    kinds = (pa.string(), *[pa.int64()] * 5, pa.string())
    fields = ["file", "start", "range", "flips", "from_outside", "from_inside", "first"]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], fields)


WHOLE, BEGUN, CONTINUED = 0, 1, 2  # what a text is: a record, its first fragment, a later one


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and fragments of each range, from the state in which it begins."""
    number = inside = depth = base = None
    open_text: list[bytes] | None = None
    kind = BEGUN

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        kinds = (pa.int64(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array([None if t is None else t.decode("utf8", "replace") for t in c] if k == pa.string() else c, k)
             for c, k in zip(columns, kinds, strict=True)], ["range", "kind", "text"]
        )

    for batch in batches:
        rows: list[tuple] = []
        states = {int(r): i for i, r in reversed(list(enumerate(batch.column("range").to_pylist())))}
        for at, data in _chunks(batch):
            if at != number:
                if open_text:
                    rows.append((number, kind, b"".join(open_text)))
                row = states[int(at)]
                number = int(at)
                inside, depth, base = (batch.column(c)[row].as_py() for c in ("inside", "depth", "base"))
                open_text, kind = ([], CONTINUED) if depth > base else (None, BEGUN)
            places, step, parity = _marks(data)
            outside = (parity[:-1] ^ inside) == 0
            places, step = places[outside], step[outside]
            after = depth + np.cumsum(step)
            brace = data[places] == _BRACES[0]
            starts = places[brace & (after == base + 1)]
            ends = places[(data[places] == _BRACES[1]) & (after == base)] + 1
            body, done = data.tobytes(), 0
            if open_text is not None and len(ends):
                open_text.append(body[: ends[0]])
                rows.append((number, kind if kind == CONTINUED else WHOLE, b"".join(open_text)))
                open_text, kind, done = None, BEGUN, 1
            elif open_text is not None:
                open_text.append(body)
            closed = ends[done:]
            rows += [(number, WHOLE, body[a:b]) for a, b in zip(starts, closed)]
            if open_text is None and len(starts) > len(closed):
                open_text, kind = [body[starts[-1] :]], BEGUN
            inside ^= int(parity[-1])
            depth = int(after[-1]) if len(after) else depth
        yield table(rows)
    if open_text:
        yield table([(number, kind, b"".join(open_text))])


def array_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The objects of the JSON arrays in the files, as text; a file that is one object is one record.

    Elements that are no objects are left out. Where a file breaks off, the record in which it does ends there. Only
    fragments of records that a border cuts are shuffled. The files are read three times: for the ranges' effects, for
    the fragments and for the records.
    """
    pieces = spark.read.option("lineSep", "}").text(paths)
    pieces = pieces.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    keyed = pieces.withColumn("range", F.xxhash64("file", "start"))
    effects = keyed.mapInArrow(
        _effects, "file string, start long, range long, flips long, from_outside long, from_inside long, first string"
    )
    path = shared_path(spark, "json-ranges")
    ahead = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    inside = F.pmod(F.coalesce(F.sum("flips").over(ahead), F.lit(0)), F.lit(2))
    rows = effects.withColumn("inside", inside)
    added = F.when(F.col("inside") == 0, F.col("from_outside")).otherwise(F.col("from_inside"))
    rows = rows.withColumn("added", added).withColumn("depth", F.coalesce(F.sum("added").over(ahead), F.lit(0)))
    kind = F.first("first", ignorenulls=True).over(W.partitionBy("file").orderBy("start"))
    rows = rows.withColumn("base", (kind == "[").cast("long"))
    rows.select("range", "file", "start", "inside", "depth", "base").write.parquet(path)
    states = spark.read.parquet(path)  # one row per range
    placed = keyed.select("range", "value").join(F.broadcast(states.select("range", "inside", "depth", "base")), "range")
    found = placed.mapInArrow(_records, "range long, kind int, text string")
    path = shared_path(spark, "json-fragments")
    found.where(F.col("kind") != WHOLE).write.parquet(path)
    fragments = spark.read.schema(found.schema).parquet(path).join(states, "range")
    # a record belongs to the last range before that has begun one
    so_far = W.partitionBy("file").orderBy("start", F.desc("kind")).rowsBetween(W.unboundedPreceding, W.currentRow)
    owned = fragments.withColumn("owner", F.max(F.when(F.col("kind") == BEGUN, F.col("start"))).over(so_far))
    joined = owned.where("owner IS NOT NULL").groupBy("file", "owner").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text")
    )
    return found.where(F.col("kind") == WHOLE).select("text").unionByName(joined.select("text"))


def large_files(spark: SparkSession, path: str, above: int) -> list[str]:
    """Files of more than `above` bytes; their contents are not read."""
    sizes = spark.read.format("binaryFile").load(path).select("_metadata.file_path", "_metadata.file_size")
    return [r["file_path"] for r in sizes.where(F.col("file_size") > above).collect()]
