"""The compressed, maintained index against the plain search over the same vectors."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textprep.operators import retrieval, vector_index
from textprep.session import shared_path


def frame(spark, ids, values, name="doc_id"):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, values)], f"{name} long, embedding array<float>")


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(12, 16)) * 3
    values = centers[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16))
    values[600:700] = values[0]  # ties
    docs = frame(spark, range(900), values).repartition(6)
    queries = frame(spark, range(5000, 5060), values[rng.integers(0, 900, 60)] + rng.normal(size=(60, 16)) * 0.2, "query_id")
    path = shared_path(spark, "test-compressed")
    return docs, queries, path, vector_index.build(docs, path, cells=12)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 40, "chunk_rows": 16}])
def test_exact_search(spark, made, sizes):
    docs, queries, _, index = made
    assert rows(vector_index.search(spark, queries, index, 4, **sizes)) == rows(retrieval.knn(queries, docs, 4))
    own = docs.select(F.col("doc_id").alias("query_id"), "embedding")
    found = vector_index.search(spark, own, index, 3, exclude_self=True, **sizes)
    assert rows(found) == rows(retrieval.knn(own, docs, 3, exclude_self=True))


def test_recall_grows_with_probes_and_refinement(spark, made):
    docs, queries, _, index = made
    truth = retrieval.knn(queries, docs, 4)

    def share(**kw):
        return retrieval.recall(vector_index.search(spark, queries, index, 4, **kw), truth).first()["recall"]

    by_probes = [share(probes=n) for n in (1, 3, 12)]
    assert by_probes == sorted(by_probes) and by_probes[1] >= 0.9 and by_probes[2] >= 0.99
    assert share(probes=12, refine=4) <= by_probes[2]
    assert share(probes=12, refine=900) == 1.0


def test_codes_are_a_fraction_of_the_vectors(spark, made):
    _, queries, path, index = made
    size = {"codes": 0, "embedding": 0}
    for name in glob.glob(f"{path}/vectors/**/*.parquet", recursive=True):
        groups = pq.ParquetFile(name).metadata
        for g in range(groups.num_row_groups):
            for c in range(groups.row_group(g).num_columns):
                column = groups.row_group(g).column(c)
                root = column.path_in_schema.split(".")[0]
                if root in size:
                    size[root] += column.total_uncompressed_size
    assert size["codes"] < size["embedding"] / 3
    looked = vector_index.vectors(spark, index).select("doc_id", "codes", "error", "cell")
    assert "embedding" not in looked._jdf.queryExecution().executedPlan().toString()


def test_codes_bound_the_distance():
    rng = np.random.default_rng(1)
    x, centers = rng.normal(size=(400, 8)), rng.normal(size=(5, 8))
    cell = vector_index._nearest(x, centers)
    books = [vector_index._lloyd((x - centers[cell])[:, a : a + 2], 16, 4, rng) for a in range(0, 8, 2)]
    coder = vector_index.Coder(centers, books)
    codes, error = coder.encode(x, cell)
    own = np.flatnonzero(cell == 2)
    near, true = coder.distances(x[:50], 2, codes[own]), np.sqrt(retrieval._squared_l2(x[:50], x[own]))
    assert (near - error[own] <= true + 1e-9).all() and (near + error[own] >= true - 1e-9).all()


def test_appends_replacements_deletes_and_compaction(spark):
    """After each step the search equals the plain one over the table as it should be."""
    rng = np.random.default_rng(2)
    values = {i: rng.normal(size=6) for i in range(200)}
    path = shared_path(spark, "test-maintained")
    queries = frame(spark, range(20), rng.normal(size=(20, 6)), "query_id")

    def table(ids):
        return frame(spark, ids, [values[i] for i in ids])

    def check(index, ids):
        assert rows(vector_index.search(spark, queries, index, 3)) == rows(retrieval.knn(queries, table(ids), 3))

    first = vector_index.build(table(range(100)), path, cells=4, parts=3)
    before = rows(vector_index.search(spark, queries, first, 3))
    vector_index.append(table(range(100, 180)), path)
    for i in range(50, 60):
        values[i] = rng.normal(size=6)
    check(vector_index.append(table(range(50, 60)), path), range(180))
    vector_index.delete(spark.range(40, 55).toDF("doc_id"), path)
    check(vector_index.append(table([45, 199]), path), [*range(40), 45, *range(55, 180), 199])
    small = vector_index.compact(spark, path)
    assert len(small.since) == 1 and not small.removing
    check(vector_index.delete(spark.range(0, 30).toDF("doc_id"), path), [*range(30, 40), 45, *range(55, 180), 199])
    assert rows(vector_index.search(spark, queries, first, 3)) == before  # a pinned reader
    assert rows(vector_index.search(spark, queries, vector_index.pin(spark, path, 0), 3)) == before
    vector_index.delete(spark.range(0, 300).toDF("doc_id"), path)
    assert vector_index.search(spark, queries, vector_index.compact(spark, path), 3).count() == 0


def test_two_writers(spark):
    path = shared_path(spark, "test-writers")
    vector_index.build(frame(spark, range(8), np.eye(8)), path, cells=2, parts=2)
    stale = vector_index.pin(spark, path)
    vector_index.append(frame(spark, [9], np.ones((1, 8))), path)
    with pytest.raises(RuntimeError, match="another writer"):
        vector_index._commit(spark, path, stale.version + 1, vector_index._entries(spark, stale))
    assert vector_index.append(frame(spark, [], []), path).version == 1  # nothing to add, no version
    with pytest.raises(ValueError, match="no version 7"):
        vector_index.pin(spark, path, 7)


def test_null_vectors_and_a_second_load(spark):
    path = shared_path(spark, "test-load")
    docs = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [1.0, 0.0])], "doc_id long, embedding array<float>")
    index = vector_index.load_or_build(docs, path, cells=2)
    assert vector_index.load_or_build(docs.where("false"), path, cells=2) == index
    queries = spark.createDataFrame([(1, [0.0, 0.9]), (2, None)], "query_id long, embedding array<float>")
    found = vector_index.search(spark, queries, index, 5)
    assert [(r.query_id, r.doc_id) for r in found.orderBy("rank").collect()] == [(1, 1), (1, 3)]
