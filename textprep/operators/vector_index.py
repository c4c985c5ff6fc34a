"""A vector index with compressed lists that can be extended, thinned out and compacted without a rebuild.

Vectors lie in the inverted lists (cells) of k-means centroids. Beside each lies its product-quantised code: the
components are cut into parts, and a part of the difference from the centroid is replaced by the number of the nearest
entry of that part's codebook. A search reads the codes, adds up tabled distances to codebook entries, and reads
the vectors of the survivors only, which are ranked by their true distance.

Layout below `path`:
  centroids/                 cell, center
  codebooks/                 part, code, center
  vectors/segment=S/cell=C/  doc_id, embedding, codes, error (length of what the code leaves out)
  removed/segment=S/         doc_id
  log/version=N/             segment, since, cell, n, radius: all segments that version N consists of
A row of a segment is alive unless a segment of a later version has removed its id. Nothing that is written is changed, so a
reader that has pinned a version keeps its view while writers go on.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from textprep.functions import draws
from textprep.operators import retrieval
from textprep.operators.retrieval import _TILE, BLOCK_BYTES, ROUND, Cells, _floats, _kth, _l2_sides, _matrix, _runs, _squared_l2, _Top, _where
from textprep.plans.sizing import broadcast_if_small
from textprep.session import shared_path

register_pickle_by_value(sys.modules[__name__])

CODES = 256  # entries of a codebook, so that a code is a byte
TRAIN_ROWS = 16_384  # vectors that the codebooks are fitted to, drawn by hash; every vector is indexed
SEED_CELLS = 2  # cells that give an exact search its first bound
SEED_REFINE = 4  # times k vectors that are ranked exactly for it
_SLACK = 1e-5  # rounding in bounds
_BOUNDED = "query_id long, doc_id long, cell int, score double"
_REMOVED_ONLY = -1  # cell of log rows of segments that only remove


# --- codebooks -------------------------------------------------------------------------------------


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return _squared_l2(x, centers).argmin(axis=1)


def _lloyd(x: np.ndarray, n: int, rounds: int, draw: np.random.Generator) -> np.ndarray:
    """k-means centers of a sample; a center that loses all its members stays where it is."""
    centers = x[draw.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        owner = _nearest(x, centers)
        counts = np.bincount(owner, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, owner, x)
        kept = counts > 0
        centers[kept] = sums[kept] / counts[kept, None]
    return centers


def _cuts(width: int, parts: int) -> np.ndarray:
    """Borders of `parts` runs of components, as even as can be."""
    return np.linspace(0, width, parts + 1).round().astype(int)


@dataclass(frozen=True)
class Coder:
    """Centroids and codebooks: at most a few thousand cells, and CODES entries for each part."""

    centers: np.ndarray
    books: list[np.ndarray]

    @property
    def cuts(self) -> np.ndarray:
        return np.cumsum([0, *(b.shape[1] for b in self.books)])

    def encode(self, vectors: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, error) of vectors in their cells."""
        rest, cuts = vectors - self.centers[cell], self.cuts
        codes = np.empty((len(vectors), len(self.books)), np.uint8)
        for m, book in enumerate(self.books):
            part = rest[:, cuts[m] : cuts[m + 1]]
            codes[:, m] = _nearest(part, book)
            rest[:, cuts[m] : cuts[m + 1]] = part - book[codes[:, m]]
        return codes, np.sqrt(np.einsum("ij,ij->i", rest, rest))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """What codes stand for: differences from their cell's centroid."""
        return np.hstack([book[codes[:, m]] for m, book in enumerate(self.books)])

    def distances(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distance of every query to every coded vector of a cell, by one product with the decoded vectors."""
        return np.sqrt(_squared_l2(queries - self.centers[cell], self.decode(codes)))


def _fit(corpus: DataFrame, cells: int, parts: int | None, seed: int, rounds: int) -> Coder:
    """Centroids by Spark's k-means over all vectors, codebooks on a bounded sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    featured = corpus.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=rounds).fit(featured)
    centers = np.array(list(model.clusterCenters()))
    limit = int(min(1.0, TRAIN_ROWS / max(1, corpus.count())) * 2**draws.HASH_BITS)
    drawn = corpus.where(draws.hash_key(seed, F.col("doc_id")) <= limit).select("embedding").limit(2 * TRAIN_ROWS).toArrow()
    sample = _matrix(drawn["embedding"]) if drawn.num_rows else centers
    rest = sample - centers[_nearest(sample, centers)]
    cuts, draw = _cuts(centers.shape[1], parts or max(1, centers.shape[1] // 2)), np.random.default_rng(seed)
    return Coder(centers, [_lloyd(rest[:, a:b], CODES, rounds, draw) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _save_coder(spark: SparkSession, path: str, coder: Coder) -> None:
    cells = [(i, c.tolist()) for i, c in enumerate(coder.centers)]
    books = [(m, code, c.tolist()) for m, book in enumerate(coder.books) for code, c in enumerate(book)]
    spark.createDataFrame(books, "part int, code int, center array<double>").coalesce(1).write.parquet(f"{path}/codebooks")
    spark.createDataFrame(cells, "cell int, center array<double>").coalesce(1).write.parquet(f"{path}/centroids")


def _coder(spark: SparkSession, path: str) -> Coder:
    cells = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    rows = spark.read.parquet(f"{path}/codebooks").orderBy("part", "code").collect()
    books: dict[int, list] = {}
    for row in rows:
        books.setdefault(row["part"], []).append(row["center"])
    return Coder(np.array([r["center"] for r in cells]), [np.array(books[m]) for m in sorted(books)])


# --- versions ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Pinned:
    """One version of an index: its segments with the version that added them, and the extent of its cells."""

    path: str
    version: int
    since: dict[str, int]
    counts: dict[int, int]
    radius: dict[int, float]
    removing: tuple[str, ...]


_LOG = "segment string, since int, cell int, n long, radius double, removes boolean"


def pin(spark: SparkSession, path: str, version: int | None = None) -> Pinned:
    """The given version, or the latest complete one. A reader that keeps it is not touched by later writers."""
    log = spark.read.schema(f"{_LOG}, version int").option("basePath", f"{path}/log").parquet(f"{path}/log")
    if version is None:
        version = log.agg(F.max("version")).first()[0]
    rows = log.where(F.col("version") == F.lit(version)).collect()  # segments x cells
    if not rows:
        raise ValueError(f"no version {version} of the index {path}")
    counts, radius = {}, {}
    for row in rows:
        if row["cell"] != _REMOVED_ONLY:
            counts[row["cell"]] = counts.get(row["cell"], 0) + row["n"]
            radius[row["cell"]] = max(radius.get(row["cell"], 0.0), row["radius"])
    removing = tuple(sorted({r["segment"] for r in rows if r["removes"]}))
    return Pinned(path, version, {r["segment"]: r["since"] for r in rows}, counts, radius, removing)


def _commit(spark: SparkSession, path: str, version: int, rows: list[tuple]) -> None:
    """Make a version visible; it fails if another writer has taken the number meanwhile."""
    log = spark.createDataFrame(rows, _LOG).coalesce(1)
    try:
        log.write.mode("errorifexists").parquet(f"{path}/log/version={version}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise RuntimeError(f"another writer has made version {version} of {path}: pin the index anew and repeat") from error


def _entries(spark: SparkSession, pinned: Pinned) -> list[tuple]:
    log = spark.read.schema(f"{_LOG}, version int").option("basePath", f"{pinned.path}/log").parquet(f"{pinned.path}/log")
    return [tuple(r)[:6] for r in log.where(F.col("version") == F.lit(pinned.version)).collect()]


def _write_segment(spark: SparkSession, path: str, rows: DataFrame, coder: Coder, since: int, removes: bool) -> list[tuple]:
    """Write vectors by cell, with their codes; returns the segment's log rows."""
    segment = uuid.uuid4().hex

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column("embedding"))
                distance = _squared_l2(vectors, coder.centers)
                cell = distance.argmin(axis=1)
                codes, error = coder.encode(vectors, cell)
                columns = [
                    batch.column("doc_id"), batch.column("embedding"), pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(error), pa.array(np.sqrt(distance[np.arange(len(cell)), cell])), pa.array(cell, pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "embedding", "codes", "error", "reach", "cell"])

    slim = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    coded = slim.where("embedding IS NOT NULL").mapInArrow(
        code, "doc_id long, embedding array<float>, codes binary, error double, reach double, cell int"
    )
    target = f"{path}/vectors/segment={segment}"
    coded.hint("rebalance", "cell").write.partitionBy("cell").parquet(target)
    try:
        extent = spark.read.parquet(target).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius"))
        found = [(segment, since, r["cell"], r["n"], r["radius"], removes) for r in extent.collect()]  # one row per cell
    except AnalysisException as error:  # no rows, no files
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        found = []
    return found or [(segment, since, _REMOVED_ONLY, 0, 0.0, removes)]


def _write_removed(path: str, ids: DataFrame, segment: str) -> None:
    ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().write.parquet(f"{path}/removed/segment={segment}")


# --- writers -----------------------------------------------------------------------------------------


def build(corpus: DataFrame, path: str, cells: int, parts: int | None = None, seed: int = 0, rounds: int = 5) -> Pinned:
    """Fit the codebooks and write version 0. `corpus` is (doc_id, embedding) with one row per id; rows without a vector are left out.

    A code has `parts` bytes, half as many as there are components unless given.
    """
    spark = corpus.sparkSession
    corpus = corpus.where(F.col("embedding").isNotNull())
    coder = _fit(corpus, cells, parts, seed, rounds)
    _save_coder(spark, path, coder)
    _commit(spark, path, 0, _write_segment(spark, path, corpus, coder, 0, False))
    return pin(spark, path)


def append(rows: DataFrame, path: str) -> Pinned:
    """Add vectors, or replace those whose id the index holds already; the codebooks stay as they are."""
    spark = rows.sparkSession
    before = pin(spark, path)
    since = before.version + 1
    entries = _write_segment(spark, path, rows, _coder(spark, path), since, True)
    # the ids come from what was written: an upstream plan that is not stable cannot make the two differ
    if entries[0][2] != _REMOVED_ONLY:
        _write_removed(path, spark.read.parquet(f"{path}/vectors/segment={entries[0][0]}"), entries[0][0])
        _commit(spark, path, since, _entries(spark, before) + entries)
    return pin(spark, path)


def delete(ids: DataFrame, path: str) -> Pinned:
    """Remove the vectors of the ids (doc_id); unknown ids are no error."""
    spark = ids.sparkSession
    before, segment = pin(spark, path), uuid.uuid4().hex
    _write_removed(path, ids, segment)
    _commit(spark, path, before.version + 1, _entries(spark, before) + [(segment, before.version + 1, _REMOVED_ONLY, 0, 0.0, True)])
    return pin(spark, path)


def compact(spark: SparkSession, path: str) -> Pinned:
    """All vectors that are alive in one segment; earlier versions stay readable."""
    before = pin(spark, path)
    live = vectors(spark, before).select("doc_id", "embedding")
    since = before.version + 1
    _commit(spark, path, since, _write_segment(spark, path, live, _coder(spark, path), since, False))
    return pin(spark, path)


# --- readers -----------------------------------------------------------------------------------------

_STORED = "doc_id long, embedding array<float>, codes binary, error double, reach double, segment string, cell int"


def vectors(spark: SparkSession, pinned: Pinned, cells: list[int] | None = None) -> DataFrame:
    """The rows that are alive, of some cells or all: doc_id, embedding, codes, error, cell."""
    since = {s: n for s, n in pinned.since.items()}
    table = spark.createDataFrame(sorted(since.items()), "segment string, since int")  # a row per segment
    folders = [f"{pinned.path}/vectors/segment={s}" for s in sorted(since) if _has_rows(pinned, s, spark)]
    if not folders:
        return spark.createDataFrame([], "doc_id long, embedding array<float>, codes binary, error double, cell int")
    rows = spark.read.schema(_STORED).option("basePath", f"{pinned.path}/vectors").parquet(*folders)
    if cells is not None:
        rows = rows.where(F.col("cell").isin(cells))  # folders of other cells are not read
    if pinned.removing:
        removed = spark.read.schema("doc_id long, segment string").option("basePath", f"{pinned.path}/removed")
        removed = removed.parquet(*[f"{pinned.path}/removed/segment={s}" for s in pinned.removing])
        last = removed.join(F.broadcast(table), "segment").groupBy("doc_id").agg(F.max("since").alias("gone_since"))
        last, _ = broadcast_if_small(last)
        rows = rows.join(F.broadcast(table), "segment").join(last, "doc_id", "left")
        rows = rows.where("gone_since IS NULL OR since >= gone_since")
    return rows.select("doc_id", "embedding", "codes", "error", "cell")


def _has_rows(pinned: Pinned, segment: str, spark: SparkSession) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{pinned.path}/vectors/segment={segment}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _look_up(coder: Coder, k: int, n: int, exclude_self: bool):
    """Of one block of codes, for each query: the `n` nearest by the code, or all that may be among the `k` nearest.

    The second if the query has a bound (the true distance of a k-th nearest found so far): a vector is at
    least as far as its code's distance less the code's error.
    """

    def search(docs: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if docs.num_rows and queries.num_rows:
            cell = docs["cell"][0].as_py()
            order = np.argsort(docs["error"].to_numpy(), kind="stable")  # a run's largest error is then not far above the others
            ids, error = docs["doc_id"].to_numpy()[order], docs["error"].to_numpy()[order]
            codes = np.frombuffer(b"".join(docs["codes"].to_pylist()), np.uint8).reshape(docs.num_rows, -1)[order]
            every, bounds, vectors = queries["query_id"].to_numpy(), queries["bound"].to_numpy(), _floats(queries["embedding"])
            for start in range(0, len(every), _TILE):
                asked, limit = every[start : start + _TILE], bounds[start : start + _TILE].copy()
                asking = _l2_sides(vectors[start : start + _TILE] - coder.centers[cell], True)
                top, near = _Top(len(asked), n or k), []
                for a, b in _runs(len(ids)):
                    squared = asking @ _l2_sides(coder.decode(codes[a:b]), False).T
                    if exclude_self:
                        squared[asked[:, None] == ids[None, a:b]] = np.inf
                    # n: distances rank; else a vector is at least as far as its code's distance less the code's error
                    reach = top.limits(slice(None)) if n else limit + error[b - 1]
                    reach = np.where(np.isinf(reach), np.sqrt(np.maximum(_kth(squared, n or k), 0.0)) + (0.0 if n else 2 * error[b - 1]), reach)
                    row, col = _where(squared <= (reach[:, None] + _SLACK) ** 2)
                    distance, col = np.sqrt(np.maximum(squared[row, col], 0.0)), col + a
                    here = np.isfinite(distance)
                    row, col, distance = row[here], col[here], distance[here]
                    top.add(row, distance if n else distance + error[col], ids[col])
                    if not n:  # k vectors of this block are as near as that
                        limit = np.minimum(limit, top.limits(slice(None)) + _SLACK)
                        near.append((row, col, distance))
                if n:
                    row, doc, distance = top.entries()
                else:
                    row, col, distance = (np.concatenate(p) for p in zip(*near))
                    here = distance - error[col] <= limit[row]
                    row, doc, distance = row[here], ids[col[here]], distance[here]
                found.append((asked[row], doc, np.full(len(row), cell), distance))
        parts = [np.concatenate(p) for p in zip(*found)] if found else [np.empty(0)] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64())
        names = ("query_id", "doc_id", "cell", "score")
        return pa.table({c: pa.array(p, kind) for c, p, kind in zip(names, parts, kinds)})

    return search


def _ranked(candidates: DataFrame, queries: DataFrame, spark: SparkSession, pinned: Pinned, k: int) -> DataFrame:
    """The k nearest candidates by their true distance; vectors are read of the candidates' cells only."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gap = _matrix(batch.column("embedding")) - _matrix(batch.column("asked"))
                score = np.round(np.einsum("ij,ij->i", gap, gap), ROUND)
                columns = [batch.column("query_id"), batch.column("doc_id"), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "doc_id", "score"])

    cells = [r["cell"] for r in candidates.select("cell").distinct().collect()]  # of the index's cells
    stored = vectors(spark, pinned, None if len(cells) == len(pinned.counts) else cells).select("doc_id", "embedding")
    ids, _ = broadcast_if_small(candidates.select("doc_id").distinct())
    pairs = candidates.select("query_id", "doc_id").join(stored.join(ids, "doc_id", "left_semi"), "doc_id")
    asked = queries.select("query_id", F.col("embedding").alias("asked"))
    scored = pairs.join(asked, "query_id").mapInArrow(measure, "query_id long, doc_id long, score double")
    return retrieval._finish(scored, k, False)


def search(
    spark: SparkSession,
    queries: DataFrame,
    index: Pinned,
    k: int,
    probes: int | None = None,
    refine: int | None = None,
    exclude_self: bool = False,
    block_rows: int | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """(query_id, rank, doc_id, score): k nearest by squared distance. `queries` is (query_id, embedding).

    With `probes` the search is approximate: codes of so many nearest cells are looked up, and the `refine` (16 k unless
    given) nearest by their codes are ranked by true distance. Without it the search is exact: a first look
    into the nearest cells bounds the k-th distance, and cells and codes are left out only if they cannot be nearer.
    What it then ranks depends on how little the codes leave out; longer codes leave out less.
    """
    coder = _coder(spark, index.path)
    width = coder.centers.shape[1]
    block_rows = block_rows or max(1, BLOCK_BYTES // (len(coder.books) + 16))
    chunk_rows = chunk_rows or max(1, BLOCK_BYTES // (8 * width))
    queries = queries.where(F.col("embedding").isNotNull()).select(
        F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding")
    )
    counts, radius = np.zeros(len(coder.centers)), np.zeros(len(coder.centers))
    for cell, n in index.counts.items():
        counts[cell], radius[cell] = n, index.radius[cell]
    cells = Cells(coder.centers, counts, radius, np.full(len(counts), np.inf), block_rows)
    blocks = dict(enumerate(cells.blocks().tolist()))
    occupied = int((counts > 0).sum())

    def looked_up(visits: DataFrame, n: int) -> DataFrame:
        chunks = retrieval._chunks_of_cells(visits, blocks, chunk_rows)
        some = None if len(chunks) == occupied else list(chunks)
        coded = vectors(spark, index, some).select("doc_id", "codes", "error", "cell")
        placed = retrieval._place(coded, visits, blocks, chunks, ("codes", "error"), ("embedding", "bound"))
        return retrieval._join_blocks(*placed, _look_up(coder, k, n, exclude_self), _BOUNDED)

    def nearest(n_cells: int) -> DataFrame:
        visits = retrieval._visits(queries, lambda x, is_query: x, lambda x: cells.nearest(x, n_cells))
        return visits.withColumn("bound", F.lit(float("inf")))

    def first(candidates: DataFrame, n: int) -> DataFrame:
        place = F.row_number().over(W.partitionBy("query_id").orderBy("score", "doc_id"))
        return _written(candidates.withColumn("n", place).where(F.col("n") <= n).drop("n"))

    if not occupied:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    if probes is not None:
        n = refine or 16 * k
        return _ranked(first(looked_up(nearest(probes), n), n), queries, spark, index, k)
    n = SEED_REFINE * k
    seeds = _ranked(first(looked_up(nearest(SEED_CELLS), n), n), queries, spark, index, k)
    bound = seeds.groupBy("query_id").agg(F.max("rank").alias("found"), F.max("score").alias("worst"))
    bound = bound.where(F.col("found") == k).select("query_id", (F.sqrt("worst") + _SLACK).alias("bound"))
    bounded = queries.join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    bounded = _written(bounded)
    visits = _within(bounded, cells)
    return _ranked(_written(looked_up(visits, 0)), queries, spark, index, k)


def _within(queries: DataFrame, cells: Cells) -> DataFrame:
    """Queries with the cells that may hold a vector within their bound."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                to_center = np.sqrt(_squared_l2(_matrix(batch.column("embedding")), cells.pivots))
                bound = batch.column("bound").to_numpy(zero_copy_only=False)
                inside = (to_center - cells.radius[None, :] <= bound[:, None] + _SLACK) & (cells.counts > 0)[None, :]
                row, cell = np.nonzero(inside)
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                cells_of = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell, pa.int32()))
                columns = [batch.column(c) for c in ("query_id", "embedding", "bound")]
                yield pa.RecordBatch.from_arrays([*columns, cells_of], ["query_id", "embedding", "bound", "cells"])

    schema = "query_id long, embedding array<float>, bound double, cells array<int>"
    return queries.select("query_id", "embedding", "bound").mapInArrow(place, schema)


def _written(df: DataFrame) -> DataFrame:
    path = shared_path(df.sparkSession, "index-candidates")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load_or_build(corpus: DataFrame, path: str, cells: int, **options) -> Pinned:
    """The latest version of the index; it is built first where the path holds no version."""
    try:
        return pin(corpus.sparkSession, path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return build(corpus, path, cells, **options)
