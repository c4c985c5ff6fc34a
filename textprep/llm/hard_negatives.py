"""Hard negatives of anchors by a threshold join over an inverted index of vector components.

The query set (anchors) is searched against all rows, in blocks. The components of all vectors have one order, the
strongest on average first. A block's index has a list for each component; a vector stands in the lists up to
the place from which on the norm of its remaining components, its suffix norm, is too short to lift any anchor's score to
the threshold, and is left out of the later lists. Scores are accumulated list by list; a pair is dropped as soon as
its partial score plus the product of both remaining norms stays below the anchor's threshold, and what is left is
computed exactly. The search starts with high thresholds and lowers them for the anchors whose windows are not
full, until they are or the window ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textprep.llm.tables import written
from textprep.llm.vectors import first_of_each, matrix, moments
from textprep.session import shared_path

CHUNK_BYTES = 32 << 20  # anchors that a pass over the rows broadcasts
TILE_PAIRS = 1 << 20  # partial scores held at once
LISTS_AT_ONCE = 8  # lists added between two looks at the bounds
FEW = 0.05  # share of pairs that is computed exactly instead of going on through the lists
WIDER = 16.0  # how many times more rows each lower threshold lets expect
STEPS = (0.25, 1.0)  # standard deviations below a window's upper end, before the whole window
_ROUNDING = 1e-9


class _Anchors:
    """A chunk of anchors: ids, labels, components in index order, suffix norms."""

    def __init__(self, table: pa.Table, order: np.ndarray, scale: float):
        self.ids = table["anchor_id"].to_numpy()
        self.labels = np.array(table["label"].to_pylist(), dtype=object)
        values, _ = matrix(table["embedding"], len(order))
        self.values = np.floor(values[:, order] * scale)
        self.suffix = _suffix_norms(self.values)
        self.by_label: dict[str, np.ndarray] = {}
        for label in set(self.labels):
            self.by_label[label] = np.flatnonzero(self.labels == label)


def _suffix_norms(values: np.ndarray) -> np.ndarray:
    """Norm of the components from each place on; the last column, of none, is 0."""
    squares = np.cumsum(values[:, ::-1] ** 2, axis=1)[:, ::-1]
    return np.sqrt(np.hstack([squares, np.zeros((len(values), 1))]))


def _pairs_above(
    rows: np.ndarray, suffix: np.ndarray, anchors: np.ndarray, anchor_suffix: np.ndarray, limits: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of all pairs whose inner product is at least the anchor's limit."""
    width = rows.shape[1]
    length = np.maximum(anchor_suffix[:, 0], 1e-300)
    least = np.min(limits / length)  # a row whose suffix is shorter cannot reach any limit from there on
    slack = _ROUNDING * (1.0 + float(suffix[:, 0].max(initial=0.0)) * float(length.max()))
    indexed = (suffix[:, :width] >= least * (1 - _ROUNDING)).sum(axis=1) if least > 0 else np.full(len(rows), width)
    by_length = np.argsort(-indexed, kind="stable")  # then the list of a component is a leading run of rows
    lists, listed = rows[by_length], indexed[by_length]
    lists = np.where(np.arange(width)[None, :] < listed[:, None], lists, 0.0)
    partial = np.zeros((len(rows), len(anchors)))
    end = 0
    while True:
        ended = np.minimum(listed, end)
        rest = suffix[by_length, ended][:, None] * anchor_suffix[:, ended].T
        alive = partial + rest >= (limits - slack)[None, :]
        n_alive = int(np.count_nonzero(alive))
        if n_alive <= FEW * alive.size or end >= width or not (listed > end).any():
            break
        start, end = end, min(width, end + LISTS_AT_ONCE)
        members = int(np.searchsorted(-listed, -start, side="left"))  # rows whose lists go beyond `start`
        partial[:members] += lists[:members, start:end] @ anchors[:, start:end].T
    if not n_alive:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row, anchor = np.nonzero(alive)
    row = by_length[row]
    score = np.empty(len(row))
    for first in range(0, len(row), 1 << 16):
        part = slice(first, first + (1 << 16))
        score[part] = np.einsum("ij,ij->i", rows[row[part]], anchors[anchor[part]])
    kept = score >= limits[anchor]
    return row[kept], anchor[kept], score[kept]


class _Windows:
    """The best rows found so far for each (anchor, window): scores at most `high`, at least `low`."""

    def __init__(self, owner: np.ndarray, low: np.ndarray, high: np.ndarray, n: int, anchors: int):
        self.owner, self.low, self.high, self.n, self.anchors = owner, low, high, n, anchors
        # windows of one anchor lie side by side
        self.first = np.searchsorted(owner, np.arange(anchors))
        self.count = np.searchsorted(owner, np.arange(anchors), side="right") - self.first
        self.key, self.score, self.ident = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.limits = self._limits()

    def _limits(self) -> np.ndarray:
        """What a row must score to be of use to an anchor: the least of its windows' limits."""
        own = self.low.copy()
        full = np.bincount(self.key, minlength=len(own)) >= self.n
        worst = np.full(len(own), np.inf)
        np.minimum.at(worst, self.key, self.score)
        own[full] = worst[full]
        limits = np.full(self.anchors, np.inf)
        np.minimum.at(limits, self.owner, own)
        return limits

    def add(self, anchor: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        for k in range(int(self.count.max(initial=0))):
            has = self.count[anchor] > k
            key = self.first[anchor[has]] + k
            inside = (score[has] <= self.high[key]) & (score[has] >= self.low[key])
            self.key = np.append(self.key, key[inside])
            self.score = np.append(self.score, score[has][inside])
            self.ident = np.append(self.ident, ident[has][inside])
        kept = first_of_each(self.key, self.score, self.ident, self.n)
        self.key, self.score, self.ident = self.key[kept], self.score[kept], self.ident[kept]
        self.limits = self._limits()


def _search(chunk, n: int, order: np.ndarray, scale: float, same: bool):
    """Rows of each task against a broadcast chunk of anchors; a task emits at most n rows for each window."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, (owner, low, high, mark) = chunk.value
        found = _Windows(owner, low, high, n, len(anchors.ids))
        for batch in batches:
            values, usable = matrix(batch.column("embedding"), len(order))
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)[usable]
            labels = np.array(batch.column("label").to_pylist(), dtype=object)[usable]
            rows = np.floor(values[usable][:, order] * scale)
            suffix = _suffix_norms(rows)
            if same:
                groups = [(np.flatnonzero(labels == v), anchors.by_label[v]) for v in set(labels) & anchors.by_label.keys()]
            else:
                groups = [(np.arange(len(rows)), np.arange(len(anchors.ids)))]
            for members, asking in groups:
                for a in range(0, len(asking), 512):
                    some = asking[a : a + 512]
                    step = max(1, TILE_PAIRS // max(1, len(some)))
                    for r in range(0, len(members), step):
                        own = members[r : r + step]
                        row, anchor, score = _pairs_above(
                            rows[own], suffix[own], anchors.values[some], anchors.suffix[some], found.limits[some]
                        )
                        row, anchor = own[row], some[anchor]
                        fits = ids[row] != anchors.ids[anchor] if same else labels[row] != anchors.labels[anchor]
                        found.add(anchor[fits], score[fits], ids[row[fits]])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(anchors.ids[owner[found.key]], pa.int64()),
                pa.array(mark[found.key], pa.int64()),
                pa.array(found.ident, pa.int64()),
                pa.array(found.score.astype(np.int64)),
            ],
            ["anchor_id", "window", "vec_id", "score"],
        )

    return search


def _round(rows: DataFrame, todo: DataFrame, n: int, order: np.ndarray, scale: float, same: bool, chunk_bytes: int) -> DataFrame:
    """The n best rows of every window of `todo`: (anchor_id, window, vec_id, score).

    `todo` has one row per anchor with its windows as a list of (window, low, high). Chunks of it are broadcast one after
    another; each is a job over all rows that moves only the rows found.
    """
    spark = rows.sparkSession
    path = shared_path(spark, "llm-hard-found")
    width = max(1, len(order))
    chunks = max(1, math.ceil(todo.count() * 24 * width / chunk_bytes))
    for number in range(chunks):
        own = todo.where(F.pmod(F.xxhash64("anchor_id"), F.lit(chunks)) == number).toArrow()
        lists = own["windows"].combine_chunks()
        counts = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        low, high = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("low", "high"))
        windows = (np.repeat(np.arange(len(counts)), counts), low, high, flat.field("window").to_numpy(zero_copy_only=False))
        chunk = spark.sparkContext.broadcast((_Anchors(own, order, scale), windows))
        found = rows.mapInArrow(
            _search(chunk, n, order, scale, same), "anchor_id bigint, window bigint, vec_id bigint, score bigint"
        )
        best = W.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
        found.write.mode("append").parquet(path)
        chunk.unpersist()
    return spark.read.schema("anchor_id bigint, window bigint, vec_id bigint, score bigint, rank int").parquet(path)


def _one_row_each(rows: DataFrame) -> DataFrame:
    """Of rows that repeat a vec_id the one with the least (label, embedding); only repeated ones are shuffled whole."""
    repeated = written(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "hard-repeated")
    if repeated.isEmpty():
        return rows
    several = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r"))
    return rows.join(repeated, "vec_id", "left_anti").unionByName(several.select("vec_id", "r.label", "r.embedding"))


def _weighed(anchors: DataFrame, mean: np.ndarray, variance: np.ndarray, scale: float) -> DataFrame:
    """`anchors` with the mean and the deviation of the scores that rows may be expected to have with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, _ = matrix(batch.column("embedding"), len(mean))
            values = np.floor(values * scale)
            columns = [*batch.columns, pa.array(values @ mean), pa.array(np.sqrt(values**2 @ variance))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "mean", "deviation"])

    schema = "anchor_id bigint, label string, embedding array<double>, mean double, deviation double"
    return anchors.mapInArrow(run, schema)


def _floor_share(score: Column, share: int, of: int) -> Column:
    """floor(share * score / of) of a whole score, in whole numbers."""
    times = score * F.lit(share)
    return ((times - F.pmod(times, F.lit(of))) / F.lit(of)).cast("bigint")


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    n_positives: int = 5,
    n_negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: float = 256.0,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` has vec_id, label and embedding (other columns are not read); `anchors` is a condition on vec_id. Scores
    are inner products of floor(scale * component), higher first, ties by smaller vec_id; they are exact as long as
    their partial sums stay below 2 ** 53. An anchor's positives are its first `n_positives` other rows of its
    label. For each, the first `n_negatives` rows of other labels are returned whose score is at least `low` and at most
    `high` hundredths of the positive's; no such row, no result, and so none for a negative positive score.

    Rows take no part if vec_id, label or embedding is null or a component is null or not finite. Shorter vectors count as
    filled up with zeros. Of rows that repeat a vec_id the one with the least (label, embedding) counts. Without anchors,
    or in an empty table, the result is empty. Labels may be few or many, and one may hold most rows: rows are read
    where they lie, and a task emits at most `n_positives` or `n_negatives` rows for each window.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = _one_row_each(rows.where(finite))
    mean, variance, n_rows = moments(rows, scale)
    order = np.argsort(-(mean**2 + variance), kind="stable")  # the strongest component first
    asking = rows.where(anchors).select(F.col("vec_id").alias("anchor_id"), "label", "embedding")
    asking = written(_weighed(asking, mean, variance, scale), "hard-anchors")
    labels = rows.agg(F.approx_count_distinct("label").alias("n")).first()["n"]

    # positives: one window without an upper end for each anchor
    share, positives = min(1.0, 3.0 * n_positives * max(1, labels) / max(1, n_rows)), None
    todo = asking
    while True:
        last = share >= 0.25
        limit = F.lit(float("-inf")) if last else F.col("mean") + F.col("deviation") * NormalDist().inv_cdf(1 - share)
        window = F.struct(F.lit(0).cast("bigint").alias("window"), limit.alias("low"), F.lit(float("inf")).alias("high"))
        found = _round(rows, todo.withColumn("windows", F.array(window)), n_positives, order, scale, True, chunk_bytes)
        if last:
            positives = found if positives is None else positives.unionByName(found)
            break
        full = written(found.where(F.col("rank") == n_positives).select("anchor_id"), "hard-full")
        kept = found.join(full, "anchor_id", "left_semi")
        positives = kept if positives is None else positives.unionByName(kept)
        todo = written(todo.join(full, "anchor_id", "left_anti"), "hard-todo")
        if todo.isEmpty():
            break
        share *= WIDER
    positives = positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    positives = written(positives, "hard-positives")

    # negatives: a window for each positive score of an anchor
    least, most = -_floor_share(-F.col("positive_score"), low, 100), _floor_share(F.col("positive_score"), high, 100)
    windows = positives.select("anchor_id", F.col("positive_score").alias("window")).distinct()
    windows = windows.withColumn("positive_score", F.col("window")).select(
        "anchor_id", "window", least.alias("least"), most.alias("most")
    )
    todo = written(windows.where("least <= most"), "hard-windows")
    negatives, none = None, "anchor_id bigint, window bigint, vec_id bigint, score bigint, rank int"
    for step in (*STEPS, None):
        if todo.isEmpty():
            break
        lowered = F.col("least") if step is None else F.greatest("least", F.floor(F.col("most") - F.col("deviation") * step))
        placed = todo.join(asking.select("anchor_id", "deviation"), "anchor_id").withColumn("low", lowered)
        lists = placed.groupBy("anchor_id").agg(
            F.sort_array(F.collect_list(F.struct("window", "low", F.col("most").alias("high")))).alias("windows")
        )
        asked = asking.select("anchor_id", "label", "embedding").join(lists, "anchor_id")
        found = _round(rows, asked, n_negatives, order, scale, False, chunk_bytes)
        full = found.where(F.col("rank") == n_negatives).select("anchor_id", "window")
        done = placed.join(full.withColumn("full", F.lit(True)), ["anchor_id", "window"], "left").select(
            "anchor_id", "window", "least", "most", (F.coalesce("full", F.lit(False)) | (F.col("low") <= F.col("least"))).alias("done")
        )
        done = written(done, "hard-done")
        kept = found.join(done.where("done").select("anchor_id", "window"), ["anchor_id", "window"], "left_semi")
        negatives = kept if negatives is None else negatives.unionByName(kept)
        todo = done.where("NOT done").drop("done")
    if negatives is None:
        negatives = spark.createDataFrame([], none)
    result = positives.join(negatives, (positives["anchor_id"] == negatives["anchor_id"]) & (positives["positive_score"] == negatives["window"]))
    return result.select(
        positives["anchor_id"], "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
