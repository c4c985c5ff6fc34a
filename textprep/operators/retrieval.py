"""Exact top-k retrieval as a partitioned join, and its centroid-pruned approximation.

The corpus is divided into cells around pivot vectors. Small cells are packed, large ones cut, into blocks of bounded size.
The triangle inequality tells which cells can hold one of the k nearest documents of a query; the
query travels once to each block that has such a cell, by an equi-join on the block.  A task meets one bounded block of
documents with one bounded chunk of queries, run by run, and emits the k best per query.  Queries come in waves where
all of them at once would shuffle much more than the documents.
"""

from __future__ import annotations

import gc
import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textprep.functions import draws
from textprep.functions.text import token_ids
from textprep.operators.set_search import knn_jaccard as knn_jaccard
from textprep.session import shared_path

# The helpers travel with the task, so executors need not have this package installed.
register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 32 * 1024 * 1024  # vectors of one block of documents, or of one chunk of queries, as doubles
_TILE = 512  # queries multiplied at once,
_RUN = 1024  # and documents; no task holds more scores than that
_ONE_GROUP = 256  # pivots that are not divided into groups
_VISIT_ROWS = 1024  # queries whose cells are found at once
PIVOT_BYTES = 32 * 1024 * 1024  # vectors that the driver draws as pivots
WAVE_BYTES = 128 * 1024 * 1024  # that a search may shuffle at once, as estimated; twice the documents if that is more
_KEY_BYTES = 32  # of a vector's keys in a shuffle,
_FILLED_BYTES = 8  # of each component that is not zero, and
_HIT_BYTES = 12  # of a candidate
_FEW = 4  # times k near documents of a run that are scored one by one
_SINGLE = 1.2e-7  # rounding in single precision
_CELLS_PER_BLOCK = 8  # finer cells prune better; a cell longer than a block is cut into blocks
_PIVOTS_PER_ROOT = 4  # times the square root of the documents: finding cells stays cheaper than searching them
_SLACK = 1e-5  # absorbs rounding in the pruning bound
ROUND = 6
_TIE = 10.0**-ROUND  # scores closer than this may be equal after rounding

_CANDIDATE = "query_id long, doc_id long, score double"


# --- vectors ---------------------------------------------------------------------------------------


def _floats(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """array<float> column as a matrix (rows of equal length), without a copy where that can be."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """array<float> column as a float64 matrix."""
    return _floats(column).astype(np.float64)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _squared_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :]
    return np.maximum(squares - 2.0 * (a @ b.T), 0.0)


def _l2_sides(x: np.ndarray, is_query: bool) -> np.ndarray:
    """Rows whose products are squared distances."""
    square, one = np.einsum("ij,ij->i", x, x)[:, None], np.ones((len(x), 1))
    return np.hstack([-2.0 * x, one, square]) if is_query else np.hstack([x, square, one])


@dataclass(frozen=True)
class _Metric:
    """`space` maps vectors to where nearness means plain distance; the products of `sides` rank, smaller first.

    The squared distance in that space is `scale` times the score, plus `base` of the query.
    """

    space: Callable[[np.ndarray, bool], np.ndarray]
    sides: Callable[[np.ndarray, bool], np.ndarray]
    descending: bool
    scale: float = 1.0
    base: Callable[[np.ndarray], np.ndarray] = lambda x: np.zeros(len(x))


def _metric(name: str, longest: float = 0.0) -> _Metric:
    if name == "l2":
        return _Metric(lambda x, is_query: x, _l2_sides, False)
    if name == "cosine":
        return _Metric(
            lambda x, is_query: _unit_rows(x),
            lambda x, is_query: -_unit_rows(x) if is_query else _unit_rows(x),
            True, 2.0, lambda x: np.full(len(x), 2.0),
        )
    if name not in ("dot", "max_inner_product"):
        raise ValueError(f"unknown metric {name!r}")

    def lifted(x: np.ndarray, is_query: bool) -> np.ndarray:
        # One more coordinate gives all documents the same length: the largest product is then the
        # smallest distance.
        gap = longest**2 - np.einsum("ij,ij->i", x, x)
        extra = np.zeros(len(x)) if is_query else np.sqrt(np.maximum(gap, 0.0))
        return np.hstack([x, extra[:, None]])

    return _Metric(
        lifted, lambda x, is_query: -x if is_query else x, True,
        2.0, lambda x: np.einsum("ij,ij->i", x, x) + longest**2,
    )


class _Top:
    """The k smallest scores of each query so far; ties go to the smaller document id."""

    def __init__(self, n: int, k: int) -> None:
        self.scores, self.ids = np.full((n, k), np.inf), np.zeros((n, k), np.int64)

    def limits(self, rows: np.ndarray) -> np.ndarray:
        return self.scores[rows, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(rows):
            return
        k, own = self.scores.shape[1], np.unique(rows)
        rows = np.concatenate([np.repeat(own, k), rows])
        scores = np.concatenate([self.scores[own].ravel(), scores])
        ids = np.concatenate([self.ids[own].ravel(), ids])
        order = np.lexsort((ids, scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        kept = place < k
        self.scores[rows[kept], place[kept]] = scores[kept]
        self.ids[rows[kept], place[kept]] = ids[kept]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, place = np.nonzero(np.isfinite(self.scores))
        return rows, self.ids[rows, place], self.scores[rows, place]


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th smallest entry of each row; inf where it has fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), np.inf)
    found = np.partition(scores, k - 1, axis=1)[:, k - 1]
    return np.where(np.isnan(found), np.inf, found)


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what is true: few places are found faster in one dimension."""
    return np.divmod(np.flatnonzero(mask.ravel()), mask.shape[1])


def _runs(n: int) -> list[tuple[int, int]]:
    return [(a, min(n, a + _RUN)) for a in range(0, n, _RUN)]


@dataclass(frozen=True)
class _Balls:
    """A ball around each run of documents, in the space of the metric."""

    centers: np.ndarray
    radius: np.ndarray

    @staticmethod
    def around(vectors: np.ndarray, how: _Metric) -> _Balls:
        centers, radius = [], []
        for a, b in _runs(len(vectors)):
            x = how.space(vectors[a:b].astype(np.float64), False)
            center = x.mean(axis=0)
            centers.append(center)
            radius.append(np.sqrt(np.einsum("ij,ij->i", x - center, x - center).max()))
        return _Balls(np.array(centers), np.array(radius))

    def gaps(self, queries: np.ndarray) -> np.ndarray:
        """How far each query is from each ball at least."""
        return np.sqrt(_squared_l2(queries, self.centers)) - self.radius[None, :]


def _near(asking: np.ndarray, answering: np.ndarray, limit: np.ndarray, k: int) -> tuple:
    """(row, column, score) of what scores at most `limit`: found in single precision, scored in double; None where that is much."""
    longest = np.sqrt(np.einsum("ij,ij->i", answering, answering).max())
    length = np.sqrt(np.einsum("ij,ij->i", asking, asking))
    most = _FEW * k * len(asking)
    if not (np.isfinite(limit).all() and length.max() * longest < 1e30):
        return None, None, None
    loose = limit + (asking.shape[1] + 4) * _SINGLE * length * longest
    near = asking.astype(np.float32) @ answering.astype(np.float32).T <= loose.astype(np.float32)[:, None]
    if np.count_nonzero(near) > most:
        return None, None, None
    row, col = _where(near)
    score = np.einsum("ij,ij->i", asking[row], answering[col])
    kept = score <= limit[row]
    return row[kept], col[kept], score[kept]


def _candidates(
    query_ids: np.ndarray, query_vectors: np.ndarray, doc_ids: np.ndarray, doc_vectors: np.ndarray,
    how: _Metric, k: int, exclude_self: bool, bound: np.ndarray | None = None,
) -> pa.Table:
    """Top k of one block for every query of one chunk, at most _TILE x _RUN scores at a time.

    With a `bound` on the distance of each query's k-th nearest, runs beyond it, or beyond what was found so far, are left out.
    """
    found: list[tuple] = []
    balls = None if bound is None or not len(doc_ids) else _Balls.around(doc_vectors, how)
    for start in range(0, len(query_ids), _TILE):
        ids = query_ids[start : start + _TILE]
        x = query_vectors[start : start + _TILE].astype(np.float64)
        asking, top, every = how.sides(x, True), _Top(len(ids), k), np.arange(len(ids))
        highest = np.full(len(ids), np.inf)
        if balls is not None:
            gaps, base, reach = balls.gaps(how.space(x, True)), how.base(x), bound[start : start + _TILE] + _SLACK
            highest = (reach**2 - base) / how.scale
        for run, (a, b) in enumerate(_runs(len(doc_ids))):
            rows = every
            if balls is not None:
                far = np.sqrt(np.maximum(base + how.scale * (top.scores[:, -1] + _TIE), 0.0))
                rows = np.flatnonzero(gaps[:, run] <= np.minimum(far + _SLACK, reach))
                if not len(rows):
                    continue
            docs, answering = doc_ids[a:b], how.sides(doc_vectors[a:b].astype(np.float64), False)
            own = asking if len(rows) == len(ids) else asking[rows]
            limit = np.minimum(top.limits(rows), highest[rows]) + _TIE
            row, col, score = _near(own, answering, limit, k)
            if row is None:
                scores = own @ answering.T
                crowded = np.flatnonzero(np.count_nonzero(scores <= limit[:, None], axis=1) > k)
                if len(crowded):
                    theirs = scores[crowded]
                    if exclude_self:
                        theirs[ids[rows[crowded], None] == docs[None, :]] = np.inf
                    limit[crowded] = np.minimum(limit[crowded], _kth(theirs, k) + _TIE)
                row, col = _where(scores <= limit[:, None])
                score = scores[row, col]
            score = np.round(score, ROUND)
            row = rows[row]
            kept = np.isfinite(score)
            if exclude_self:
                kept &= ids[row] != docs[col]
            top.add(row[kept], score[kept] if how.descending else np.maximum(score[kept], 0.0) + 0.0, docs[col[kept]])
        row, doc, score = top.entries()
        found.append((ids[row], doc, score))
    parts = [np.concatenate(p) for p in zip(*found)] if found else [np.empty(0)] * 3
    return pa.table(
        {
            "query_id": pa.array(parts[0], pa.int64()),
            "doc_id": pa.array(parts[1], pa.int64()),
            "score": pa.array(parts[2], pa.float64()),
        }
    )


def _keep_best(candidates: DataFrame, k: int) -> DataFrame:
    """rank 1..k per query; ties go to the smaller document id."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "doc_id"))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= k)


def _join_blocks(docs: DataFrame, queries: DataFrame, search, schema: str = _CANDIDATE) -> DataFrame:
    keys = ["cell", "block", "chunk"]
    return docs.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, schema)


@dataclass(frozen=True)
class _Tree:
    """Pivots in groups, as many as the square root of their number, each around one of them, its head."""

    heads: np.ndarray
    group: np.ndarray  # of each pivot
    to_head: np.ndarray
    members: list[np.ndarray]

    def nearest(self, vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pivot, squared distance): the nearest pivot of the nearest group, at the cost of two square roots.

        Any assignment makes valid cells; one that is not quite the nearest makes them a little wider.
        """
        home = _squared_l2(vectors, pivots[self.heads]).argmin(axis=1)
        cell, distance = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
        for g in np.unique(home):
            own = np.flatnonzero(home == g)
            squared = _squared_l2(vectors[own], pivots[self.members[g]])
            best = squared.argmin(axis=1)
            cell[own], distance[own] = self.members[g][best], squared[np.arange(len(own)), best]
        return cell, distance


def _tree(pivots: np.ndarray) -> _Tree:
    """Few pivots are one group: each vector then goes to the nearest of all."""
    n = math.isqrt(len(pivots)) if len(pivots) > _ONE_GROUP else 1
    heads = np.arange(len(pivots))[:: max(1, len(pivots) // n)]
    squared = _squared_l2(pivots, pivots[heads])
    group = squared.argmin(axis=1)
    members = [np.flatnonzero(group == g) for g in range(len(heads))]
    filled = [g for g, own in enumerate(members) if len(own)]  # equal pivots leave a later head without any
    place = np.full(len(heads), -1)
    place[filled] = np.arange(len(filled))
    return _Tree(heads[filled], place[group], np.sqrt(squared[np.arange(len(pivots)), group]), [members[g] for g in filled])


@dataclass(frozen=True)
class Cells:
    """Pivots and the extent of their cells: bounded by PIVOT_BYTES, whatever the corpus size."""

    pivots: np.ndarray
    counts: np.ndarray
    radius: np.ndarray  # largest distance of a member from its pivot
    near: np.ndarray  # distance of the k-th nearest member, inf when there are fewer
    block_rows: int

    def blocks(self) -> np.ndarray:
        return np.maximum(1, np.ceil(self.counts / self.block_rows)).astype(np.int64)

    def reachable(self, query_vectors: np.ndarray) -> np.ndarray:
        """Which cells may hold one of the k nearest members of each query."""
        return self.within(query_vectors)[0]

    def within(self, query_vectors: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(which cells may hold one of the k nearest members of each query, a bound on the distance of the k-th).

        `known` are bounds that are known before.

        Pivots lie in groups around a few of them. A query looks at the pivots of its nearest group for a first bound, and
        then only at those of groups that reach within it.
        """
        tree = _tree(self.pivots)
        reach = np.where(self.counts > 0, tree.to_head + self.radius, -np.inf)
        extent = np.full(len(tree.heads), -np.inf)
        np.maximum.at(extent, tree.group, reach)
        to_head = np.sqrt(_squared_l2(query_vectors, self.pivots[tree.heads]))
        home = to_head.argmin(axis=1)
        bound = np.full(len(query_vectors), np.inf) if known is None else known.copy()
        for g in np.unique(home):
            own = np.flatnonzero(home == g)
            first = (np.sqrt(_squared_l2(query_vectors[own], self.pivots[tree.members[g]])) + self.near[tree.members[g]]).min(axis=1)
            bound[own] = np.minimum(bound[own], first)
        mask = np.zeros((len(query_vectors), len(self.pivots)), bool)
        distance = {}
        for g, members in enumerate(tree.members):
            own = np.flatnonzero(to_head[:, g] - extent[g] <= bound + _SLACK)
            if len(own):
                to_pivot = np.sqrt(_squared_l2(query_vectors[own], self.pivots[members]))
                bound[own] = np.minimum(bound[own], (to_pivot + self.near[members]).min(axis=1))
                distance[g] = own, to_pivot
        for g, (own, to_pivot) in distance.items():
            members = tree.members[g]
            near = (to_pivot - self.radius[members] <= bound[own, None] + _SLACK) & (self.counts[members] > 0)
            mask[np.ix_(own, members)] = near
        return mask, bound

    def nearest(self, query_vectors: np.ndarray, probes: int) -> np.ndarray:
        to_pivot = _squared_l2(query_vectors, self.pivots)
        to_pivot[:, self.counts == 0] = np.inf
        mask = np.zeros(to_pivot.shape, dtype=bool)
        closest = np.argsort(to_pivot, axis=1, kind="stable")[:, :probes]
        np.put_along_axis(mask, closest, True, axis=1)
        return mask & np.isfinite(to_pivot)


@dataclass(frozen=True)
class _Packing:
    """Cells in blocks: neighbouring small ones share a block, a large one has several of its own."""

    place: np.ndarray  # number of the pack that a cell is in
    blocks: dict[int, int]  # of each pack
    rows: dict[int, int]  # of each pack
    order: np.ndarray  # cells, pack by pack
    starts: np.ndarray  # of the packs in that order

    @staticmethod
    def of(cells: Cells) -> _Packing:
        pivots, n = cells.pivots, len(cells.pivots)
        heads = pivots[:: max(1, n // math.isqrt(n))]
        squared = _squared_l2(pivots, heads)
        home = squared.argmin(axis=1)
        order = np.lexsort((squared[np.arange(n), home], home))
        place, starts, filled, sizes = np.zeros(n, np.int64), [0], 0, []
        for at, cell in enumerate(order):
            if filled and filled + cells.counts[cell] > cells.block_rows:
                sizes.append(filled)
                starts.append(at)
                filled = 0
            place[cell], filled = len(sizes), filled + cells.counts[cell]
        sizes.append(filled)
        blocks = {pack: max(1, math.ceil(size / cells.block_rows)) for pack, size in enumerate(sizes)}
        rows = {pack: int(size) for pack, size in enumerate(sizes)}
        return _Packing(place, blocks, rows, order, np.array(starts))

    def visited(self, mask: np.ndarray) -> np.ndarray:
        """Which packs hold a cell of the mask."""
        return np.logical_or.reduceat(mask[:, self.order], self.starts, axis=1)


def assign_cells(
    corpus: DataFrame, pivots: np.ndarray, space=lambda x, is_query: x, with_vectors: bool = True
) -> DataFrame:
    """Each document's cell and its distance to the pivot, in one narrow pass.

    Without vectors only (cell, reach) leave the Python worker.
    """
    kept = ["doc_id", "embedding"] if with_vectors else []

    def assign(batches):
        tree = _tree(pivots)
        for batch in batches:
            if batch.num_rows:
                cell, squared = tree.nearest(space(_matrix(batch.column("embedding")), False), pivots)
                reach = np.sqrt(squared)
                columns = [*[batch.column(c) for c in kept], pa.array(cell, pa.int32()), pa.array(reach)]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "cell", "reach"])

    slim = corpus.select(F.col("doc_id").cast("long"), F.col("embedding").cast("array<float>"))
    result = "cell int, reach double"
    if with_vectors:
        result = f"doc_id long, embedding array<float>, {result}"
    return slim.mapInArrow(assign, result)


def measure_cells(reaches: DataFrame, pivots: np.ndarray, k: int, block_rows: int) -> Cells:
    """Count, radius and k-th distance of each cell, from (cell, reach) rows.

    Spark prunes the ranking to k rows per cell and task before the shuffle, so a cell with most of
    the corpus costs no more than the others.
    """
    reaches = reaches.select("cell", "reach").persist(StorageLevel.MEMORY_AND_DISK)  # read twice
    order = F.row_number().over(W.partitionBy("cell").orderBy("reach"))
    nearest = reaches.withColumn("n", order).where(F.col("n") <= k)
    kth = nearest.groupBy("cell").agg(F.max("reach").alias("near"), F.max("n").alias("n"))
    extent = reaches.groupBy("cell").agg(F.count(F.lit(1)).alias("count"), F.max("reach").alias("radius"))
    size = len(pivots)
    counts, radius, near = np.zeros(size), np.zeros(size), np.full(size, np.inf)
    for row in extent.join(kth, "cell").collect():  # one row per pivot
        counts[row["cell"]], radius[row["cell"]] = row["count"], row["radius"]
        if row["n"] >= k:
            near[row["cell"]] = row["near"]
    reaches.unpersist()
    return Cells(pivots, counts, radius, near, block_rows)


def _visits(queries: DataFrame, space, visit, more: tuple[str, ...] = ()) -> DataFrame:
    """Each query with the cells that it must visit, and the bound that `visit` knows on the distance of its k-th nearest.

    `visit` gets the vectors and, after them, the columns `more`.
    """

    def place(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, _VISIT_ROWS):
                batch = whole.slice(first, _VISIT_ROWS)
                known = [batch.column(c).to_numpy(zero_copy_only=False) for c in more]
                mask = visit(space(_matrix(batch.column("embedding")), True), *known)
                mask, bound = mask if isinstance(mask, tuple) else (mask, np.full(len(mask), np.inf))
                row, cell = np.nonzero(mask)
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                cells_of = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell, pa.int32()))
                columns = [batch.column("query_id"), batch.column("embedding"), cells_of, pa.array(bound)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "embedding", "cells", "bound"])

    slim = queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<float>"), *more)
    return slim.mapInArrow(place, "query_id long, embedding array<float>, cells array<int>, bound double")


def _chunks_of_cells(visits: DataFrame, blocks: dict[int, int], chunk_rows: int) -> dict[int, int]:
    """How many chunks the queries of each visited cell fall into, by the visits it gets.

    A block is sent once for each chunk of its own cell: once, unless more than `chunk_rows` queries
    reach it or there are too few blocks to fill the cores.
    """
    return _chunks(_visited(visits), blocks, chunk_rows, visits.sparkSession.sparkContext.defaultParallelism)


def _visited(visits: DataFrame) -> dict[int, int]:
    """How many queries visit each cell."""
    rows = visits.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()  # one per cell
    return {row["cell"]: row["count"] for row in rows}


def _chunks(visited: dict[int, int], blocks: dict[int, int], chunk_rows: int, cores: int) -> dict[int, int]:
    idle = math.ceil(cores / max(1, sum(blocks[c] for c in visited)))
    return {c: max(math.ceil(n / chunk_rows), min(idle, math.ceil(n / _TILE))) for c, n in visited.items()}


def _place(
    docs: DataFrame,
    visits: DataFrame,
    blocks: dict[int, int],
    chunks: dict[int, int],
    doc_payload: tuple[str, ...] = ("embedding",),
    query_payload: tuple[str, ...] = ("embedding",),
):
    """Documents and queries keyed by (cell, block, chunk); only keys that some query holds get documents.

    The cells' blocks and chunks are a broadcast table of three numbers for each visited cell, at most one row
    per pivot, so the plan does not grow with the cells.
    """
    columns = ([int(v) for v in part] for part in (chunks, (blocks[c] for c in chunks), chunks.values()))
    rows = pa.table([pa.array(c, pa.int32()) for c in columns], ["cell", "n_blocks", "n_chunks"])
    cells = F.broadcast(docs.sparkSession.createDataFrame(rows))
    placed_docs = docs.join(cells, "cell").select(
        "doc_id",
        *doc_payload,
        "cell",
        F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"),
    )
    exploded = visits.select("query_id", *query_payload, F.explode("cells").alias("cell")).join(cells, "cell")
    placed_queries = exploded.select(
        "query_id",
        *query_payload,
        "cell",
        F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("query_id"), F.col("n_chunks")).cast("int").alias("chunk"),
    )
    return placed_docs, placed_queries


def _first_copies(doc_ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the documents that can be among k nearest: of equal vectors those of the k + 1 smallest ids.

    Equal vectors have equal scores and the smaller id ranks first; one more stands in for the query's own row.
    """
    if not vectors.size:
        return np.arange(len(doc_ids))
    whole = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, kind = np.unique(whole, return_inverse=True)
    order = np.lexsort((doc_ids, kind))
    ids, kinds = doc_ids[order], kind[order]
    new = np.concatenate([[True], kinds[1:] != kinds[:-1]])
    other = np.cumsum(np.concatenate([[True], ids[1:] != ids[:-1]]) | new)  # numbers the ids of each kind
    first = np.maximum.accumulate(np.where(new, other, 0))
    return np.sort(order[other - first <= k])


def _search_vectors(how: _Metric, k: int, exclude_self: bool):
    """Where the documents name their `part` of the block, those of one part lie together and far ones are left out."""

    def search(docs: pa.Table, queries: pa.Table) -> pa.Table:
        doc_ids, doc_vectors = docs["doc_id"].to_numpy(), _floats(docs["embedding"])
        order, bound = _first_copies(doc_ids, doc_vectors, k), None
        if "part" in docs.column_names:
            order = order[np.argsort(docs["part"].to_numpy()[order], kind="stable")]
            bound = queries["bound"].to_numpy()
        doc_ids, doc_vectors = doc_ids[order], doc_vectors[order]
        asked = queries["query_id"].to_numpy() if len(doc_ids) else np.empty(0, np.int64)
        return _candidates(asked, _floats(queries["embedding"]), doc_ids, doc_vectors, how, k, exclude_self, bound)

    return search


def _finish(candidates: DataFrame, k: int, descending: bool) -> DataFrame:
    best = _keep_best(candidates, k)
    score = (-F.col("score")) + F.lit(0.0) if descending else F.col("score")
    return best.select("query_id", "rank", "doc_id", score.alias("score"))


def _pivots(corpus: DataFrame, n: int, n_docs: int, space, seed: int) -> np.ndarray:
    """About `n` documents drawn by hash; any choice gives the same result, only the pruning differs."""
    slim = corpus.select("doc_id", "embedding")
    limit = int(min(1.0, n / n_docs) * 2**draws.HASH_BITS)
    rows = slim.where(draws.hash_key(seed, F.col("doc_id")) < limit).limit(4 * n).collect() or slim.limit(1).collect()
    vectors = np.array([row["embedding"] for row in rows], dtype=np.float64)
    directed = vectors[vectors.any(axis=1)]
    return space(directed if len(directed) else vectors[:1], False)


def _extent(vectors: DataFrame, id_col: str, need_length: bool = False) -> tuple[int, int, float, float]:
    """(rows, components, length of the longest, components that are not zero on average); vectors of different widths are an error."""
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    width = F.size("embedding")
    row = vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(width).alias("low"),
        F.max(width).alias("high"),
        F.min_by(F.col(id_col), width).alias("odd"),
        F.avg(F.size(F.filter("embedding", lambda x: x != 0))).alias("filled"),
        *([F.max(square).alias("square")] if need_length else []),
    ).first()
    if row["low"] != row["high"]:
        raise ValueError(f"the vector of {id_col} {row['odd']} has {row['low']} components, others have {row['high']}")
    longest = math.sqrt(row["square"] or 0.0) * (1 + 1e-9) if need_length else 0.0
    return row["n"], row["high"] or 1, longest, row["filled"] or 0.0


def _undirected(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Candidates where one side is zero: every cosine is 0, so the smallest ids of `corpus` are the nearest."""
    first = corpus.select(F.col("doc_id").cast("long")).orderBy("doc_id").limit(k + 1).collect()  # k + 1 rows
    ids = F.array(*[F.lit(row["doc_id"]) for row in first]).cast("array<long>")
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(ids).alias("doc_id"), F.lit(0.0).alias("score"))
    return rows.where(F.col("query_id") != F.col("doc_id")) if exclude_self else rows


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    metric: str = "l2",
    exclude_self: bool = False,
    block_rows: int | None = None,
    chunk_rows: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Exact k nearest documents: (query_id, rank, doc_id, score).

    `queries` is (query_id, embedding), `corpus` (doc_id, embedding).  The score is the squared
    distance for l2 and the similarity otherwise, rounded before ranking so that ties are stable.
    Rows without a vector neither ask nor answer.  A zero vector has the cosine 0 with all others.
    `block_rows` says how fine the cells are. Blocks of documents and chunks of queries that are sent are sized by bytes, and
    cells share a block, so that small cells do not multiply what is sent.
    """
    queries, corpus = (df.where(F.col("embedding").isNotNull()) for df in (queries, corpus))
    n_docs, width, longest, doc_filled = _extent(corpus, "doc_id", metric not in ("l2", "cosine"))
    n_queries, query_width, _, query_filled = _extent(queries, "query_id")
    if n_docs and n_queries and width != query_width:
        raise ValueError(f"queries have {query_width} components, documents {width}")
    most_rows = max(1, BLOCK_BYTES // (8 * width))
    block_rows = block_rows or most_rows
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    sent_rows = max(block_rows, min(most_rows, math.ceil(n_docs / cores)))
    chunk_rows = max(chunk_rows or block_rows, most_rows)
    how = _metric(metric, longest)
    wanted = k + 1 if exclude_self else k
    if n_docs <= block_rows:  # one block: nothing to prune
        candidates = _one_block(queries, corpus, _search_vectors(how, k, exclude_self), n_queries, chunk_rows)
        return _finish(candidates, k, how.descending)
    n_pivots = _CELLS_PER_BLOCK * math.ceil(n_docs / block_rows)
    n_pivots = max(1, min(PIVOT_BYTES // (8 * width), n_pivots, _PIVOTS_PER_ROOT * math.isqrt(n_docs)))
    corpus = _handed_off(corpus, max(cores, math.ceil(n_docs / most_rows)) if n_docs > most_rows else 0)  # read for the pivots, the cells' extents and the search
    extra = None
    if metric == "cosine":
        directed = F.exists("embedding", lambda x: x != 0)
        extra = _undirected(queries.where(~directed), corpus, k, exclude_self)
        queries, zeros, corpus = queries.where(directed), corpus.where(~directed), corpus.where(directed)
        extra = extra.unionByName(_undirected(queries, zeros, k, exclude_self))
    pivots = _pivots(corpus, n_pivots, n_docs, how.space, seed)
    assigned = assign_cells(corpus, pivots, how.space)
    cells = measure_cells(assign_cells(corpus, pivots, how.space, with_vectors=False), pivots, wanted, sent_rows)
    packing = _Packing.of(cells)

    def visit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask, bound = cells.within(vectors)
        return packing.visited(mask), bound

    packs = pa.table([pa.array(np.arange(len(pivots)), pa.int32()), pa.array(packing.place, pa.int32())], ["part", "cell"])
    packs = F.broadcast(corpus.sparkSession.createDataFrame(packs))  # one row per pivot
    assigned = assigned.withColumnRenamed("cell", "part").join(packs, "part")
    doc_bytes, query_bytes = (_KEY_BYTES + min(4 * width, _FILLED_BYTES * filled) for filled in (doc_filled, query_filled))
    sizes = _Sizes(packing, chunk_rows, cores, doc_bytes, query_bytes + k * _HIT_BYTES)

    def search(visits: DataFrame, chunks: dict[int, int]) -> DataFrame:
        placed = _place(assigned, visits, packing.blocks, chunks, ("embedding", "part"), ("embedding", "bound"))
        return _join_blocks(*placed, _search_vectors(how, k, exclude_self))

    visits = _visits(queries, how.space, visit)
    visited = _visited(visits)
    if sizes.waves(visited) == 1:
        candidates = search(visits, sizes.chunks(visited))
    else:
        queries = queries.withColumn("query_id", F.col("query_id").cast("long"))
        queries = queries.repartition(max(cores, math.ceil(n_queries / most_rows)), "query_id")
        candidates = _in_waves(queries, how, cells, packing, sizes, search, k)
    return _finish(candidates if extra is None else candidates.unionByName(extra), k, how.descending)


@dataclass(frozen=True)
class _Sizes:
    """What a search shuffles: each block once for each chunk of its queries, each query and its candidates once for each block."""

    packing: _Packing
    chunk_rows: int
    cores: int
    doc_bytes: float
    query_bytes: float

    def chunks(self, visited: dict[int, int], waves: int = 1) -> dict[int, int]:
        """Of each wave; queries are dealt to waves by a hash."""
        share = {pack: math.ceil(n / waves) for pack, n in visited.items()}
        return _chunks(share, self.packing.blocks, self.chunk_rows, self.cores)

    def waves(self, visited: dict[int, int]) -> int:
        """So many that none shuffles much more than the documents, however many queries there are."""
        rows, blocks = self.packing.rows, self.packing.blocks
        asked = self.query_bytes * sum(n * blocks[pack] for pack, n in visited.items())
        limit, waves = max(WAVE_BYTES, 2 * self.doc_bytes * sum(rows.values())), 1
        while asked / waves + self.doc_bytes * sum(rows[pack] * math.ceil(n / waves / self.chunk_rows) for pack, n in visited.items()) > limit:
            waves += math.ceil(waves / 8)
        return waves


def _in_waves(
    queries: DataFrame, how: _Metric, cells: Cells, packing: _Packing, sizes: _Sizes, search: Callable[[DataFrame, dict[int, int]], DataFrame], k: int
) -> DataFrame:
    """Candidates of a search that would shuffle much more than its documents: queries come in waves, and what one has shuffled is freed.

    Each query first meets the pack of its nearest pivot. The k-th score that it finds there says which others it must visit.
    """
    spark = queries.sparkSession

    def home(points: np.ndarray) -> np.ndarray:
        mask = np.zeros((len(points), len(packing.blocks)), bool)
        mask[np.arange(len(points)), packing.place[_tree(cells.pivots).nearest(points, cells.pivots)[0]]] = True
        return mask

    def others(points: np.ndarray, seen: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = np.sqrt(np.maximum(how.base(points) + how.scale * (limit + _TIE), 0.0)) + _SLACK
        mask, bound = cells.within(points, known)
        mask = packing.visited(mask)
        mask[np.arange(len(points)), seen] = False
        return mask, bound

    def found(visits_of: Callable[[Column], DataFrame], name: str) -> DataFrame:
        path, visited = shared_path(spark, name), _visited(visits_of(F.lit(True)))
        waves = sizes.waves(visited)
        for wave in range(waves if visited else 0):
            visits = visits_of(F.pmod(F.hash("query_id"), F.lit(waves)) == wave)
            best = _keep_best(search(visits, sizes.chunks(visited, waves)), k)
            best.select("query_id", "doc_id", "score").write.mode("append").parquet(path)
            del visits, best
            _free_shuffles(spark)
        return spark.read.schema(_CANDIDATE).parquet(path) if visited else spark.createDataFrame([], _CANDIDATE)

    path = shared_path(spark, "asked")
    _visits(queries, how.space, home).write.parquet(path)  # so that a query's own pack is the same in every pass
    asked = spark.read.schema("query_id long, embedding array<float>, cells array<int>").parquet(path)
    first = found(lambda own: asked.where(own).withColumn("bound", F.lit(math.inf)), "first-hits")

    def further(own: Column) -> DataFrame:
        kth = F.when(F.count(F.lit(1)) >= k, F.max("score"))
        limits = first.where(own).groupBy("query_id").agg(kth.alias("limit"))
        rows = asked.where(own).join(limits, "query_id", "left")
        rows = rows.withColumns({"seen": F.get("cells", F.lit(0)), "limit": F.coalesce("limit", F.lit(math.inf))})
        return _visits(rows, how.space, others, ("seen", "limit"))

    return first.unionByName(found(further, "further-hits"))


def _free_shuffles(spark) -> None:
    """Spark removes the shuffle files of a finished job once the driver has collected what refers to them."""
    gc.collect()
    spark._jvm.System.gc()


def _handed_off(corpus: DataFrame, parts: int = 0) -> DataFrame:
    """(doc_id, embedding) as a table of its own, so that a costly upstream plan, e.g. an encoder, runs once.

    With `parts` the rows are dealt out evenly: a small file of short texts may hold most of them.
    """
    path = shared_path(corpus.sparkSession, "vectors")
    slim = corpus.select(F.col("doc_id").cast("long"), F.col("embedding").cast("array<float>"))
    (slim.repartition(parts, "doc_id") if parts else slim).write.parquet(path)
    return corpus.sparkSession.read.schema("doc_id long, embedding array<float>").parquet(path)


def _one_block(queries: DataFrame, corpus: DataFrame, search, n_queries: int, chunk_rows: int) -> DataFrame:
    """All documents against the queries, which are divided among the cores."""
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, math.ceil(n_queries / chunk_rows), min(cores, math.ceil(n_queries / _TILE)))
    vector, zero = F.col("embedding").cast("array<float>").alias("embedding"), F.lit(0)
    docs = corpus.select(
        F.col("doc_id").cast("long"), vector, zero.alias("cell"), zero.alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
    )
    chunk = F.pmod(F.xxhash64(F.col("query_id").cast("long")), F.lit(chunks)).cast("int").alias("chunk")
    asked = queries.select(F.col("query_id").cast("long"), vector, zero.alias("cell"), zero.alias("block"), chunk)
    return _join_blocks(docs, asked, search)


# --- persisted centroid partitions ------------------------------------------------------------------


def build_index(corpus: DataFrame, path: str, cells: int, seed: int = 0, iterations: int = 5) -> None:
    """Write the corpus partitioned by its nearest k-means centroid, and the centroids with their extents beside it.

    The centroids are written last, so a path without them is not an index and is built anew.  Files
    are packed by cell: Spark rebalances the shuffle, splitting large cells and joining small ones.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = corpus.sparkSession
    corpus = corpus.where(F.col("embedding").isNotNull())
    featured = corpus.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=iterations).fit(featured)
    centers = np.array([center for center in model.clusterCenters()])
    packed = assign_cells(corpus, centers).hint("rebalance", "cell")
    packed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    reaches = spark.read.parquet(f"{path}/vectors").select("cell", "reach")
    extent = {r["cell"]: r for r in reaches.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius")).collect()}
    rows = [
        (i, [float(v) for v in center], extent[i]["n"] if i in extent else 0, extent[i]["radius"] if i in extent else 0.0)
        for i, center in enumerate(centers)
    ]
    table = spark.createDataFrame(rows, "cell int, center array<double>, n long, radius double")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def load_or_build(spark, path: str, build: Callable[[], None]) -> DataFrame:
    """Vectors of an index, built first when the path holds no centroids; any other failure is raised."""
    try:
        spark.read.parquet(f"{path}/centroids").count()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        build()
    return spark.read.parquet(f"{path}/vectors")


def search_index(
    spark,
    queries: DataFrame,
    path: str,
    k: int,
    probes: int | None = None,
    exclude_self: bool = False,
    block_rows: int | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """k nearest documents by squared distance over a written index.

    Exact without `probes`: a cell is skipped only when it cannot hold a neighbour.  With `probes`,
    approximate: just that many nearest cells are searched.  Only visited cells are read.
    """
    queries = queries.where(F.col("embedding").isNotNull())
    assigned = spark.read.parquet(f"{path}/vectors")
    centers = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    pivots = np.array([row["center"] for row in centers], dtype=np.float64)
    block_rows = block_rows or max(1, BLOCK_BYTES // (8 * max(1, pivots.shape[1])))
    chunk_rows = chunk_rows or block_rows
    if probes is None:
        cells = measure_cells(assigned, pivots, k + 1 if exclude_self else k, block_rows)
    else:  # the extents written with the index will do
        counts, radius = np.array([[row["n"], row["radius"]] for row in centers]).T
        cells = Cells(pivots, counts, radius, np.full(len(counts), np.inf), block_rows)

    def visit(vectors: np.ndarray) -> np.ndarray:
        return cells.reachable(vectors) if probes is None else cells.nearest(vectors, probes)

    visits = _visits(queries, lambda x, is_query: x, visit)
    blocks = dict(enumerate(cells.blocks().tolist()))
    chunks = _chunks_of_cells(visits, blocks, chunk_rows)
    if len(chunks) < int((cells.counts > 0).sum()):
        assigned = assigned.where(F.col("cell").isin(list(chunks)))  # folders of other cells are not read
    found = _join_blocks(*_place(assigned, visits, blocks, chunks), _search_vectors(_metric("l2"), k, exclude_self))
    return _finish(found, k, False)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true neighbours that were found."""
    hits = truth.select("query_id", "doc_id").join(
        found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left"
    )
    return hits.agg(
        F.countDistinct("query_id").alias("n_queries"),
        F.count(F.lit(1)).alias("n_neighbours"),
        F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"),
    )


# --- hits ------------------------------------------------------------------------------------------------


def with_texts(hits: DataFrame, documents: DataFrame, metadata: tuple[str, ...] = ("source",)) -> DataFrame:
    """Hits with rank, similarity, text and metadata; ids without a document are dropped."""
    return hits.join(documents.select("doc_id", "text", *metadata), "doc_id")


def similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance


def result_lists(hits: DataFrame) -> DataFrame:
    """One row per query: its results as an array sorted by rank (k entries, so bounded)."""
    entry = F.struct("rank", similarity(F.col("score")).alias("similarity"), "doc_id", "text", "source")
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("results"))


# --- vectors of texts ----------------------------------------------------------------------------------------


def encode(
    df: DataFrame,
    id_col: str,
    text_col: str,
    encode_batch: Callable[[list[str]], np.ndarray] | None = None,
    load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
) -> DataFrame:
    """Vectors of an external encoder, called once per Arrow batch: (id, embedding).

    `load`, if given, sets the encoder up, once for each task. `vector_store` keeps the vectors as well.
    """

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = encode_batch if load is None else load()
        for texts in batches:
            yield pd.Series(list(np.asarray(run(texts.fillna("").tolist()), dtype=np.float32)))

    return df.select(id_col, vectors(F.col(text_col)).alias("embedding"))


def lexical_vectors(
    df: DataFrame, id_col: str, text_col: str = "text", features: int = 1024, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Unit-length tf-idf vectors over hashed tokens: the stand-in for a neural encoder.

    Fitting aggregates one vector of `features` counts; the rest is a narrow projection.  The result
    has the `embedding` column that `knn` and `build_index` read.
    """
    from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer
    from pyspark.ml.functions import vector_to_array

    # The feature of a token is its hashed id, so the vocabulary is fixed and nothing is fitted for it.
    # They are handed off: the fit, the result and each further read of it would else tokenise all texts anew.
    hashed = df.select(id_col, *keep, token_ids(F.coalesce(F.col(text_col), F.lit("")), features).alias("ids"))
    path = shared_path(df.sparkSession, "token-ids")
    hashed.write.parquet(path)
    hashed = df.sparkSession.read.schema(hashed.schema).parquet(path)
    buckets = F.transform("ids", lambda i: i.cast("string"))
    vocabulary = [str(i) for i in range(features)]
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="tokens", outputCol="tf")
    counted = counter.transform(hashed.select(id_col, *keep, buckets.alias("tokens")))
    weighted = IDF(inputCol="tf", outputCol="tfidf").fit(counted).transform(counted)
    unit = Normalizer(inputCol="tfidf", outputCol="vector").transform(weighted)
    return unit.select(
        id_col, *keep, F.size("tokens").alias("n_tokens"), vector_to_array("vector", "float32").alias("embedding")
    )
