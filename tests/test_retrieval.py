"""Nearest neighbours against brute force, with every pruning and blocking path."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from textprep.operators import raft, retrieval, set_search
from textprep.session import shared_path

SCORES = {
    "l2": (lambda q, d: ((q[:, None, :] - d[None, :, :]) ** 2).sum(-1), False),
    "cosine": (
        lambda q, d: (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (d / np.linalg.norm(d, axis=1, keepdims=True)).T,
        True,
    ),
    "dot": (lambda q, d: q @ d.T, True),
}


def brute(query_ids, q, doc_ids, d, k, metric, exclude_self=False):
    score, descending = SCORES[metric]
    scores = np.round(score(q, d), 6)
    out = set()
    for i, query in enumerate(query_ids):
        ranked = sorted(
            ((-s if descending else s, doc) for s, doc in zip(scores[i], doc_ids) if not (exclude_self and doc == query))
        )
        out |= {(query, r + 1, doc) for r, (_, doc) in enumerate(ranked[:k])}
    return out


def tables(spark, query_ids, q, doc_ids, d):
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in zip(query_ids, q)], "query_id long, embedding array<float>")
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in zip(doc_ids, d)], "doc_id long, embedding array<float>")
    return queries, corpus


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8)) * 4
    d = (centers[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8))).astype(np.float32).astype(np.float64)
    d[200:300] = d[0]  # a third of the corpus is one document
    q = d[rng.integers(0, 200, 40)] + rng.normal(size=(40, 8)) * 0.1
    q = q.astype(np.float32).astype(np.float64)
    return [int(i) for i in range(100, 140)], q, [int(i) for i in range(300)], d


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
@pytest.mark.parametrize("block_rows, chunk_rows", [(10_000, 10_000), (32, 16)])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_knn_is_exact(spark, data, metric, block_rows, chunk_rows, exclude_self):
    queries, corpus = tables(spark, *data)
    found = retrieval.knn(
        queries, corpus, 4, metric, exclude_self=exclude_self, block_rows=block_rows, chunk_rows=chunk_rows
    )
    got = {(r["query_id"], r["rank"], r["doc_id"]) for r in found.collect()}
    assert got == brute(*data, 4, metric, exclude_self)


def test_fewer_documents_than_k(spark):
    queries, corpus = tables(spark, [1], np.ones((1, 3)), [5, 6], np.eye(3)[:2])
    assert retrieval.knn(queries, corpus, 5).count() == 2
    assert retrieval.knn(queries, corpus, 5, block_rows=1).count() == 2


def test_empty_corpus(spark):
    queries, corpus = tables(spark, [1], np.ones((1, 3)), [5], np.ones((1, 3)))
    assert retrieval.knn(queries, corpus.where("doc_id < 0"), 5).count() == 0


def test_pruning_skips_far_cells(spark, data):
    queries, corpus = tables(spark, *data)
    pivots = retrieval._pivots(corpus, 10, corpus.count(), lambda x, is_query: x, 0)
    cells = retrieval.measure_cells(retrieval.assign_cells(corpus, pivots), pivots, 4, 32)
    assert cells.counts.sum() == 300
    visited = cells.reachable(data[1])
    assert 0 < visited.mean() < 0.7
    assert cells.blocks().sum() > (cells.counts > 0).sum()  # the cell of copies is split


def test_no_cartesian_product(spark, data):
    queries, corpus = tables(spark, *data)
    plan = retrieval.knn(queries, corpus, 4, block_rows=32)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_index_recall_grows_to_exact(spark, data):
    queries, corpus = tables(spark, *data)
    path = shared_path(spark, "index")
    calls = []

    def build():
        calls.append(1)
        retrieval.build_index(corpus, path, cells=8)

    for _ in range(2):
        assert retrieval.load_or_build(spark, path, build).count() == 300
    assert calls == [1]
    truth = retrieval.knn(queries, corpus, 4)
    shares = []
    for probes in (1, 3, 8):
        found = retrieval.search_index(spark, queries, path, 4, probes)
        shares.append(retrieval.recall(found, truth).first()["recall"])
    assert shares[0] <= shares[1] <= shares[2] == 1.0 and shares[1] > 0.8
    exact = retrieval.search_index(spark, queries, path, 4)
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, truth.collect()))


def _jaccard(a, b):
    return round(len(a & b) / len(a | b), 6)


@pytest.mark.parametrize("seed_postings, salt_matches", [(2_000, 1_000_000), (20, 15)])
def test_jaccard_is_exact(spark, seed_postings, salt_matches):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(80)]
    docs += [(100 + i, "w1 w2 w3") for i in range(40)]
    asked = [(i, " ".join(rng.choice(words, rng.integers(1, 12)))) for i in range(15)] + [(50, ""), (51, "zzz")]
    found = retrieval.knn_jaccard(
        spark.createDataFrame(asked, "query_id long, text string"),
        spark.createDataFrame([*docs, (999, None)], "doc_id long, text string"),
        3,
        seed_postings=seed_postings,
        salt_matches=salt_matches,
    )
    want = set()
    for query, text in asked:
        a = set(text.split())
        ranked = sorted((-_jaccard(a, set(t.split())), i) for i, t in docs if a & set(t.split()))
        want |= {(query, r + 1, i, -s) for r, (s, i) in enumerate(ranked[:3])}
    assert {tuple(r) for r in found.collect()} == want


def test_jaccard_compares_few_pairs(spark, monkeypatch):
    """Documents of a topic share rare words, all share frequent ones: a tenth of the pairs and less is compared."""
    rng = np.random.default_rng(6)
    common = [f"c{i}" for i in range(20)]
    topics = [[f"t{n}w{i}" for i in range(60)] for n in range(40)]

    def text(n):
        return " ".join([*rng.choice(common, 12), *rng.choice(topics[n % 40], 25)])

    docs = spark.createDataFrame([(i, text(i)) for i in range(800)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, text(i)) for i in range(40)], "query_id long, text string")
    counted, scored = [], set_search._scored
    monkeypatch.setattr(set_search, "_scored", lambda pairs, *rest: counted.append(pairs.count()) or scored(pairs, *rest))
    found = retrieval.knn_jaccard(asked, docs, 3)
    assert found.count() == 120 and 0 < sum(counted) < 800 * 40 / 10


def test_lexical_vectors(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, None)], "id long, text string")
    got = {r["id"]: np.array(r["embedding"]) for r in retrieval.lexical_vectors(df, "id", features=64).collect()}
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-6 and np.linalg.norm(got[3]) == 0
    idf = {w: np.log(4 / (1 + n)) for w, n in (("a", 2), ("b", 1), ("c", 1))}
    weights = np.array([2 * idf["a"], idf["b"]])
    assert np.allclose(sorted(got[1][got[1] > 0]), sorted(weights / np.linalg.norm(weights)), atol=1e-6)
    shared = got[1] @ got[2]
    other = np.array([idf["a"], idf["c"]])
    want = 2 * idf["a"] ** 2 / (np.linalg.norm(weights) * np.linalg.norm(other))
    assert abs(shared - want) < 1e-6


def test_samples_skip_unanswered_and_short_lists(spark, data):
    queries, corpus = tables(spark, *data)
    qa = queries.select("query_id", F.lit("q").alias("question"), F.when(F.col("query_id") > 105, "a").alias("answer"), F.lit("s").alias("source"))
    documents = corpus.select("doc_id", F.concat(F.lit("text "), "doc_id").alias("text"))
    made = raft.samples(qa, queries, corpus, documents, k=4, block_rows=64).collect()
    assert {r["query_id"] for r in made} == set(range(106, 140))
    truth = brute(*data, 4, "l2")
    for r in made:
        assert (r["query_id"], 1, int(r["golden_document"].split()[1])) in truth
        assert (r["query_id"], 4, int(r["distractor_documents"].split()[1])) in truth
    assert raft.samples(qa, queries, corpus.where("doc_id < 3"), documents, k=4).count() == 0


def test_external_encoder(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    encoded = retrieval.encode(df, "id", "text", lambda texts: [[len(t), 1.0] for t in texts])
    assert sorted((r["id"], r["embedding"]) for r in encoded.collect()) == [(1, [2.0, 1.0]), (2, [0.0, 1.0])]


ODD = np.array([[0, 0, 0], [1, 0, 0], [0, 0, 0], [0, 2, 0], [1, 0, 0], [-1, 0.5, 0], [0, 0, 3], [2, 2, 2]] * 6, dtype=float)


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_blocks_do_not_change_the_answer(spark, metric, exclude_self):
    """Zero, equal and missing vectors: one block against many cells."""
    ids = list(range(len(ODD)))
    queries, corpus = tables(spark, ids, ODD, ids, ODD)
    missing = spark.createDataFrame([(1000, None)], "id long, embedding array<float>")
    queries = queries.union(missing.select("id", F.col("embedding").cast(queries.schema["embedding"].dataType)))
    corpus = corpus.union(missing.select("id", F.col("embedding").cast(corpus.schema["embedding"].dataType)))
    found = [
        sorted(map(tuple, retrieval.knn(queries, corpus, 4, metric, exclude_self, block_rows=rows).collect()))
        for rows in (None, 5, 1)
    ]
    assert found[0] == found[1] == found[2] and len(found[0]) == 4 * len(ids)


def test_vectors_of_different_widths_are_an_error(spark):
    corpus = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<float>")
    with pytest.raises(ValueError, match="2 has 1"):
        retrieval.knn(queries, corpus, 1)
    with pytest.raises(ValueError, match="components"):
        retrieval.knn(queries, corpus.where("doc_id = 2"), 1)


def test_a_block_is_sent_only_where_a_query_needs_it(spark, data):
    """Documents to shuffle: those of visited cells, once for each chunk of queries of their own cell."""
    queries, corpus = tables(spark, *data)
    visits = spark.createDataFrame([(i, [1.0], [0] if i < 9 else [0, 2]) for i in range(10)], "query_id long, embedding array<float>, cells array<int>")
    chunks = retrieval._chunks_of_cells(visits, {0: 100, 1: 100, 2: 100}, 4)
    assert chunks == {0: 3, 2: 1}
    docs = spark.createDataFrame([(i, [1.0], i % 3) for i in range(30)], "doc_id long, embedding array<float>, cell int")
    placed, asked = retrieval._place(docs, visits, {0: 1, 1: 1, 2: 2}, chunks)
    assert placed.count() == 3 * 10 + 10 and asked.count() == 10 + 2


def test_only_probed_cells_are_read(spark, data):
    queries, corpus = tables(spark, *data)
    path = shared_path(spark, "index")
    retrieval.build_index(corpus, path, cells=8)
    one = queries.limit(1)
    plan = retrieval.search_index(spark, one, path, 3, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan


def test_an_unfinished_index_is_built_anew(spark, data):
    queries, corpus = tables(spark, *data)
    path = shared_path(spark, "index")
    retrieval.assign_cells(corpus, np.zeros((1, 8))).write.partitionBy("cell").parquet(f"{path}/vectors")  # and then a crash
    assert retrieval.load_or_build(spark, path, lambda: retrieval.build_index(corpus, path, cells=4)).count() == 300
    assert retrieval.search_index(spark, queries, path, 3).count() == 3 * queries.count()


def test_samples_from_texts(spark):
    """Golden and distractor are the nearest and the k-th nearest text of a plain search over the same vectors."""
    random = np.random.default_rng(8)
    texts = [(i, " ".join(f"w{n}" for n in random.integers(0, 40, random.integers(5, 12)))) for i in range(60)]
    corpus = spark.createDataFrame(texts, "doc_id long, text string")
    qa = spark.createDataFrame([(i, texts[i][1] + " w1", "a", "s") for i in range(0, 60, 7)] + [(99, "w3", "", "s")], "query_id long, question string, answer string, source string")
    made = {r["query_id"]: r for r in raft.from_corpus(qa, corpus, k=3, features=64, block_rows=16).collect()}
    both = corpus.selectExpr("doc_id AS id", "text").union(qa.where("answer <> ''").selectExpr("query_id + 1000 AS id", "question AS text"))
    vectors = {r["id"]: np.array(r["embedding"]) for r in retrieval.lexical_vectors(both, "id", features=64).collect()}
    assert set(made) == set(range(0, 60, 7))
    for i, row in made.items():
        near = sorted(range(60), key=lambda d: (round(((vectors[1000 + i] - vectors[d]) ** 2).sum(), 6), d))
        assert row["golden_document"] == texts[near[0]][1] and row["distractor_documents"] == texts[near[2]][1]


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_pivot_tree_finds_all_reachable_cells(n, monkeypatch):
    """Groups leave out no cell that the plain bounds keep."""
    monkeypatch.setattr(retrieval, "_ONE_GROUP", 1)
    rng = np.random.default_rng(n)
    pivots = rng.normal(size=(n, 5)) * 3
    if n > 6:
        pivots[3] = pivots[0]
    radius, near = rng.random(n), rng.random(n) + 1
    counts = np.where(rng.random(n) < 0.2, 0, 5)
    counts[0] = 5
    near[counts == 0] = np.inf
    queries = rng.normal(size=(40, 5)) * 3
    to_pivot = np.sqrt(retrieval._squared_l2(queries, pivots))
    bound = (to_pivot + near).min(axis=1)
    plain = (counts > 0) & (to_pivot - radius <= bound[:, None] + retrieval._SLACK)
    found = retrieval.Cells(pivots, counts, radius, near, 4).reachable(queries)
    assert (found >= plain).all() and found.sum() <= 1.2 * plain.sum() + 40
    cell, squared = retrieval._tree(pivots).nearest(queries, pivots)
    assert np.allclose(squared, retrieval._squared_l2(queries, pivots)[np.arange(40), cell])


def test_small_blocks_do_not_multiply_what_is_sent(spark, monkeypatch):
    """Vectors that no cell can rule out, in cells of a few: queries travel to packs of cells, not to each cell."""
    rng = np.random.default_rng(11)
    ids, x = list(range(600)), rng.normal(size=(600, 24))
    queries, corpus = tables(spark, ids, x, ids, x)
    sent, join = [], retrieval._join_blocks
    monkeypatch.setattr(retrieval, "_join_blocks", lambda d, q, *rest: sent.append((d.count(), q.count())) or join(d, q, *rest))
    found = retrieval.knn(queries, corpus, 3, block_rows=4, chunk_rows=4)
    packs = 2 * spark.sparkContext.defaultParallelism
    assert sent[0][0] <= packs * 600 and sent[0][1] <= packs * 600
    assert {(r["query_id"], r["rank"], r["doc_id"]) for r in found.collect()} == brute(ids, x.astype(np.float32), ids, x.astype(np.float32), 3, "l2")


def test_a_task_holds_few_scores():
    """Memory of a block is that of its vectors; copies of one vector are compared once."""
    rng = np.random.default_rng(12)
    docs = rng.normal(size=(20_000, 8)).astype(np.float32)
    docs[5_000:] = docs[0]
    column = pa.FixedSizeListArray.from_arrays(pa.array(docs.ravel()), 8).cast(pa.list_(pa.float32()))
    block = pa.table({"doc_id": pa.array(np.arange(20_000)), "embedding": column})
    asked = pa.table({"query_id": pa.array(np.arange(1_000)), "embedding": column[:1_000]})
    tracemalloc.start()
    found = retrieval._search_vectors(retrieval._metric("l2"), 3, True)(block, asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20  # 1,000 x 20,000 scores are 160 MB
    assert found.filter(pc.equal(found["query_id"], 0))["doc_id"].to_pylist() == [5000, 5001, 5002]


def test_texts_are_tokenised_once(spark):
    """The fit and every read of the vectors start from the hashed tokens; no plan goes back to the texts."""
    df = spark.createDataFrame([(1, "a a b"), (2, None)], "id long, text string")
    vectors = retrieval.lexical_vectors(df, "id", features=16)
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan and [r["n_tokens"] for r in vectors.orderBy("id").collect()] == [3, 0]


@pytest.mark.parametrize("metric, exclude_self", [("cosine", False), ("l2", False), ("l2", True)])
def test_what_a_task_meets_does_not_grow_with_the_table(spark, monkeypatch, metric, exclude_self):
    """The largest group of documents and the largest group of queries stay near the block's rows."""
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 64 * 8 * 8)  # 64 rows of 8 components
    met, join = [], retrieval._join_blocks

    def largest(df):
        return df.groupBy("cell", "block", "chunk").count().agg(F.max("count")).first()[0]

    monkeypatch.setattr(retrieval, "_join_blocks", lambda d, q, *rest: met.append((largest(d), largest(q))) or join(d, q, *rest))
    rng = np.random.default_rng(13)
    for n in (400, 1_600):
        ids, x = list(range(n)), rng.normal(size=(n, 8)).astype(np.float32).astype(np.float64)
        x[n // 2 :: 2] = x[0]  # a quarter of the table is one vector
        queries, corpus = tables(spark, ids, x, ids, x)
        found = retrieval.knn(queries, corpus, 3, metric, exclude_self)
        if n == 400:
            assert {(r["query_id"], r["rank"], r["doc_id"]) for r in found.collect()} == brute(ids, x, ids, x, 3, metric, exclude_self)
    assert len(met) == 2 and max(rows for sizes in met for rows in sizes) <= 2 * 64


@pytest.mark.parametrize("metric, exclude_self", [("l2", False), ("cosine", True)])
def test_queries_come_in_waves(spark, monkeypatch, metric, exclude_self):
    """What one join is sent follows the documents, not the pairs; ids that ask or answer twice change nothing."""
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 96 * 8 * 8)  # 96 rows of 8 components
    rng = np.random.default_rng(14)
    ids, x = list(range(240)), rng.normal(size=(240, 8)).astype(np.float32).astype(np.float64)
    x[100:130], x[7] = x[0], 0
    queries, corpus = tables(spark, ids, x, ids, x)
    queries, corpus = queries.union(queries.where("query_id < 9")), corpus.union(corpus.where("doc_id < 20"))
    whole = sorted(map(tuple, retrieval.knn(queries, corpus, 3, metric, exclude_self).collect()))
    sent, join = [], retrieval._join_blocks
    monkeypatch.setattr(retrieval, "WAVE_BYTES", 0)
    monkeypatch.setattr(retrieval, "_join_blocks", lambda d, q, *rest: sent.append(d.count() + q.count()) or join(d, q, *rest))
    found = sorted(map(tuple, retrieval.knn(queries, corpus, 3, metric, exclude_self).collect()))
    assert found == whole and len(sent) > 2 and max(sent) <= 4 * 260
