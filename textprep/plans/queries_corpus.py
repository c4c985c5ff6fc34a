"""Queries over sampling, the corpus, retrieval and retrieval-augmented samples."""

from __future__ import annotations

import hashlib

import numpy as np

from pyspark.sql import functions as F

from textprep import fixed_values as fixed
from textprep.functions import draws, prompts
from textprep.functions.text import token_ids
from textprep.operators import corpus, mcq, raft, retrieval, sampling, vector_index, vector_store
from textprep.plans.registry import hash_key, lit, n_tokens, query, render, strip, word, TOKENS
from textprep.session import shared_path, shared_root

SEED = fixed.SEED

# --- ordering and sampling ------------------------------------------------------------------------------


@query(
    "seeded_shuffle_rank",
    f"SELECT doc_id, row_number() OVER (ORDER BY {hash_key(SEED, 'doc_id')}, doc_id) AS position FROM documents",
)
def _(t):
    return sampling.shuffle_positions(t.documents.select("doc_id"), "doc_id")


@query("first_n", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 300")
def _(t):
    return sampling.first_n(t.documents.select("doc_id", "text"), 300, "doc_id")


@query("sample_n", f"SELECT doc_id, text FROM documents ORDER BY {hash_key(SEED, 'doc_id')}, doc_id LIMIT 512")
def _(t):
    return sampling.sample_n(t.documents.select("doc_id", "text"), fixed.CALIBRATION_SAMPLES, "doc_id")


@query(
    "exact_split",
    f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {hash_key(SEED, 'doc_id')}, doc_id)
               <= ceil(0.1::DOUBLE * count(*) OVER ()) THEN 'validation' ELSE 'train' END AS split FROM documents""",
)
def _(t):
    return sampling.exact_split(t.documents.select("doc_id"), "doc_id")


@query(
    "exact_cut_orders",
    """SELECT o_orderkey, o_orderpriority FROM orders
       ORDER BY o_orderpriority DESC, o_orderkey LIMIT (SELECT count(*) * 2 // 5 FROM orders)""",
)
def _(t):
    """Top two fifths by a key with very few values: whole priorities tie, the id decides."""
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    keys = sampling.text_keys(rows, "o_orderpriority", descending=True)
    return rows.where(sampling.before_cut(rows, rows.count() * 2 // 5, {**keys, "id": F.col("o_orderkey")}))


@query(
    "top_n_tokens",
    f"SELECT doc_id, {n_tokens('text')} AS token_count FROM documents ORDER BY token_count DESC, doc_id LIMIT 100",
)
def _(t):
    counted = corpus.with_tokens(t.documents).select("doc_id", "token_count")
    return sampling.top_n(counted, 100, "token_count", "doc_id")


@query(
    "top_n_per_source",
    f"""SELECT doc_id, source, token_count FROM (
          SELECT doc_id, source, {n_tokens('text')} AS token_count,
                 row_number() OVER (PARTITION BY source ORDER BY {n_tokens('text')} DESC, doc_id) AS rk
          FROM documents WHERE {n_tokens('text')} <= 512) AS d WHERE rk <= 5""",
)
def _(t):
    limited = corpus.limit_tokens(t.documents, "doc_id", max_chunks=5, by="source")
    return limited.select("doc_id", "source", "token_count")


# --- corpus --------------------------------------------------------------------------------------------------


def _tag_sql(c: str) -> str:
    return f"CASE WHEN coalesce({c}, '') <> '' THEN '<{c}>' || {c} || '</{c}>' END"


_TAGGED = strip("concat_ws(chr(10), " + ", ".join(_tag_sql(c) for c in corpus.WIKI_COLUMNS) + ")")
_WIKI = f"SELECT doc_id, {_TAGGED} AS text, {lit(fixed.SOURCE_TAGS['wiki'])} AS source FROM v_wiki"
_QA_TEXT = strip("coalesce(question, '') || chr(10) || coalesce(rationale, '')")
_QA = f"SELECT row_id AS doc_id, {_QA_TEXT} AS text, 'choices' AS source FROM v_mcq_list WHERE {_QA_TEXT} <> ''"


def _wiki(t):
    return corpus.tagged(t.v_wiki, keep=("doc_id",))


def _qa(t):
    rows = t.v_mcq_list.select(F.col("row_id").alias("doc_id"), "question", F.col("rationale").alias("answer"))
    return corpus.from_qa(rows, "choices", keep=("doc_id",))


@query("corpus_tagged", _WIKI, views=("v_wiki",))
def _(t):
    return _wiki(t)


@query("corpus_qa", _QA, views=("v_mcq_list",))
def _(t):
    return _qa(t)


def _small(name: str, rows: str, cut: str = "") -> str:
    return f"""SELECT * FROM (SELECT *, {n_tokens('text')} AS token_count FROM ({rows}) AS {name}_rows
               WHERE {n_tokens('text')} <= 512 {cut}) AS {name}"""


_CUT = f"ORDER BY {n_tokens('text')} DESC, doc_id LIMIT 400"


_CORPUS_VIEWS = ("v_wiki", "v_mcq_list")
_CORPUS_STEPS = {"corpus": f"{_small('wiki', _WIKI)} UNION ALL {_small('qa', _QA)}"}


def _corpus(t):
    return corpus.build([_wiki(t), _qa(t)], "doc_id")


@query("corpus_budgeted", f"{_small('wiki', _WIKI, _CUT)} UNION ALL {_small('qa', _QA, _CUT)}", views=_CORPUS_VIEWS)
def _(t):
    """The budget of rows per part is this query's own feature."""
    return corpus.build([_wiki(t), _qa(t)], "doc_id", max_chunks=400)


@query("corpus_union", "SELECT * FROM corpus", views=_CORPUS_VIEWS, steps=_CORPUS_STEPS)
def _(t):
    return _corpus(t)


@query("corpus_final", "SELECT text, source FROM corpus", views=_CORPUS_VIEWS, steps=_CORPUS_STEPS)
def _(t):
    return corpus.final_columns(_corpus(t))


@query(
    "corpus_full",
    f"SELECT doc_id, text, source, {n_tokens('text')} AS token_count FROM ({_WIKI} UNION ALL {_QA}) AS c",
    views=_CORPUS_VIEWS,
)
def _(t):
    return corpus.build([_wiki(t), _qa(t)], "doc_id", small=False)


@query(
    "token_stats",
    f"""SELECT count(*) AS n, round(avg(token_count), 6) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens
        FROM (SELECT {n_tokens('text')} AS token_count FROM documents) AS d""",
)
def _(t):
    stats = corpus.token_stats(corpus.with_tokens(t.documents.select("text")))
    return stats.withColumn("avg_tokens", F.round("avg_tokens", 6))


_BUCKET = "CAST(CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % 1024 AS BIGINT)"


@query(
    "lexical_vectors",
    """SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
              CAST(coalesce(total, 0) AS BIGINT) AS feature_sum, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length
       FROM hashed LEFT JOIN (
         SELECT doc_id, count(*) AS n, sum(id) AS total FROM (SELECT DISTINCT doc_id, unnest(ids) AS id FROM hashed) AS d
         JOIN weighted USING (id) GROUP BY doc_id) AS f USING (doc_id)""",
    steps={
        "hashed": f"SELECT doc_id, list_transform(regexp_extract_all(text, {TOKENS}), lambda x: {_BUCKET}) AS ids FROM documents",
        "weighted": """SELECT id FROM (SELECT DISTINCT doc_id, unnest(ids) AS id FROM hashed) AS d GROUP BY id
                       HAVING count(*) < (SELECT count(*) FROM documents)""",
    },
)
def _(t):
    """Which features a text has and that its vector has unit length; the tests compare the weights themselves."""
    rows = retrieval.lexical_vectors(t.documents, "doc_id")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, w: s + w.cast("double") * w)
    used = F.filter(F.transform("embedding", lambda w, i: F.when(w > 0, i)), lambda i: i.isNotNull())
    total = F.aggregate(used, F.lit(0).cast("long"), lambda s, i: s + i)
    return rows.select(
        "doc_id", "n_tokens", F.size(used).alias("n_features"), total.alias("feature_sum"), F.round(square, 4).alias("length")
    )


def _measuring():
    """A stand-in for an encoder: the length of a text, its spaces and its letters e."""
    return lambda texts: np.array([[len(t), t.count(" "), t.count("e")] for t in texts], float).reshape(-1, 3)


@query(
    "vector_store",
    """SELECT doc_id, CAST(length(text) AS DOUBLE) AS length, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces,
              CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS letters
       FROM (SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN coalesce(text, '') || ' e' ELSE coalesce(text, '') END AS text FROM documents) AS d""",
)
def _(t):
    """Vectors of a corpus of which one text in a hundred has changed since the store was filled."""
    path, encoder = shared_path(t.spark, "vector-store"), vector_store.Encoder("measures-1", _measuring)
    vector_store.add(t.documents, path, encoder)
    changed = F.when(F.col("doc_id") % 100 == 7, F.concat(F.coalesce("text", F.lit("")), F.lit(" e"))).otherwise(F.col("text"))
    rows = vector_store.encoded(t.documents.withColumn("text", changed), path, encoder, "doc_id")
    return rows.select("doc_id", *[F.get("embedding", F.lit(n)).cast("double").alias(c) for n, c in enumerate(("length", "spaces", "letters"))])


# --- nearest neighbours ---------------------------------------------------------------------------------------


def _vectors(t):
    queries = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    docs = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    return queries, docs


def _hits_sql(score: str, k: int, descending: bool, where: str = "true") -> str:
    direction = "DESC" if descending else "ASC"
    return f"""SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, score FROM (
        SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score {direction}, doc_id) AS rank
        FROM (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round({score}, 6) AS score
              FROM embeddings AS q, embeddings AS d WHERE {where}) AS pairs) AS r WHERE rank <= {k}"""


_Q, _D = "CAST(q.embedding AS DOUBLE[])", "CAST(d.embedding AS DOUBLE[])"
_L2 = f"pow(list_distance({_Q}, {_D}), 2)"
_DOT = f"list_dot_product({_Q}, {_D})"
_COS = f"list_cosine_similarity({_Q}, {_D})"


@query("knn_l2", _hits_sql(_L2, 5, False))
def _(t):
    return retrieval.knn(*_vectors(t), k=fixed.RETRIEVE_K)


@query("knn_cosine", _hits_sql(_COS, 3, True))
def _(t):
    return retrieval.knn(*_vectors(t), k=fixed.SERVE_K, metric="cosine")


@query("knn_dot", _hits_sql(_DOT, 3, True))
def _(t):
    return retrieval.knn(*_vectors(t), k=fixed.SERVE_K, metric="dot")


@query("knn_l2_pruned", _hits_sql(_L2, 5, False, "q.vec_id <> d.vec_id"))
def _(t):
    """The same search with small blocks, so that cells, pruning and block joins take part."""
    return retrieval.knn(*_vectors(t), k=fixed.RETRIEVE_K, exclude_self=True, block_rows=128, chunk_rows=256)


@query(
    "knn_jaccard",
    f"""SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
            SELECT q.id AS query_id, d.id AS doc_id,
                   round(len(list_intersect(q.words, d.words))::DOUBLE
                         / (len(q.words) + len(d.words) - len(list_intersect(q.words, d.words))), 6) AS score
            FROM asked AS q, docs AS d WHERE len(list_intersect(q.words, d.words)) > 0) AS pairs) AS r WHERE rank <= 3""",
    steps={
        "asked": f"SELECT item_id AS id, list_distinct(regexp_extract_all(text, {TOKENS})) AS words FROM benchmark",
        "docs": f"SELECT doc_id AS id, list_distinct(regexp_extract_all(text, {TOKENS})) AS words FROM documents",
    },
)
def _(t):
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return retrieval.knn_jaccard(asked, t.documents.select("doc_id", "text"), k=fixed.SERVE_K)


def _index(t, docs) -> str:
    """One index for each folder and application, built by whichever query comes first."""
    mark = hashlib.md5(f"{t.spark.sparkContext.applicationId} {t._folder}".encode()).hexdigest()
    path = f"{shared_root(t.spark)}/textprep/vector-index-{mark}"
    retrieval.load_or_build(t.spark, path, lambda: retrieval.build_index(docs, path, cells=16))
    return path


# Vectors with zero, NULL and equal ones among them; both searches below must agree with the plain product.
_ODD = {
    "odd": f"""SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: 0::FLOAT)
                      WHEN vec_id % 11 = 0 THEN first_one ELSE embedding END AS embedding
               FROM embeddings, (SELECT embedding AS first_one FROM embeddings ORDER BY vec_id LIMIT 1) AS f"""
}


def _odd(t):
    [first] = t.embeddings.agg(F.min_by("embedding", "vec_id")).first()  # one vector
    first = F.array(*[F.lit(float(x)).cast("float") for x in first])
    zero = F.transform("embedding", lambda x: F.lit(0).cast("float"))
    odd = F.when(F.col("vec_id") % 9 == 0, None).when(F.col("vec_id") % 7 == 0, zero).when(F.col("vec_id") % 11 == 0, first)
    rows = t.embeddings.select("vec_id", odd.otherwise(F.col("embedding")).alias("embedding"))
    return rows.withColumnRenamed("vec_id", "query_id"), rows.withColumnRenamed("vec_id", "doc_id")


def _odd_sql(score: str, descending: bool) -> str:
    sql = _hits_sql(score, 5, descending, "q.embedding IS NOT NULL AND d.embedding IS NOT NULL")
    return sql.replace("FROM embeddings AS q, embeddings AS d", "FROM odd AS q, odd AS d")


@query("knn_l2_odd", _odd_sql(_L2, False), steps=_ODD)
def _(t):
    return retrieval.knn(*_odd(t), k=5, block_rows=64, chunk_rows=100)


@query("knn_cosine_odd", _odd_sql(f"coalesce(nullif({_COS}, 'nan'::DOUBLE), 0)", True), steps=_ODD)
def _(t):
    return retrieval.knn(*_odd(t), k=5, metric="cosine", block_rows=64, chunk_rows=100)


@query("knn_dot_odd", _odd_sql(_DOT, True), steps=_ODD)
def _(t):
    return retrieval.knn(*_odd(t), k=5, metric="dot", block_rows=64, chunk_rows=100)


@query("knn_ivf_recall", f"SELECT h.*, true AS half_of_the_cells_find_nine_in_ten FROM ({_hits_sql(_L2, 5, False)}) AS h")
def _(t):
    """Exact when all cells are probed, which are the rows; a bounded loss when fewer are, which is the last column."""
    queries, docs = _vectors(t)
    path = _index(t, docs)
    few = retrieval.search_index(t.spark, queries, path, k=fixed.RETRIEVE_K, probes=8)
    every = retrieval.search_index(t.spark, queries, path, k=fixed.RETRIEVE_K, probes=16)
    [share] = retrieval.recall(few, every).select("recall").first()
    return every.withColumn("half_of_the_cells_find_nine_in_ten", F.lit(share >= 0.9))


@query("knn_index", _hits_sql(_L2, 5, False))
def _(t):
    """The exact search over a written index."""
    queries, docs = _vectors(t)
    return retrieval.search_index(t.spark, queries, _index(t, docs), k=fixed.RETRIEVE_K)


def _compressed(t, docs):
    """One compressed index for each folder and application."""
    mark = hashlib.md5(f"{t.spark.sparkContext.applicationId} {t._folder}".encode()).hexdigest()
    return vector_index.load_or_build(docs, f"{shared_root(t.spark)}/textprep/compressed-index-{mark}", cells=16)


@query("knn_compressed", _hits_sql(_L2, 5, False))
def _(t):
    """The exact search over product-quantised lists: codes are read first, vectors of the survivors only."""
    queries, docs = _vectors(t)
    return vector_index.search(t.spark, queries, _compressed(t, docs), k=fixed.RETRIEVE_K)


_MAINTAINED = {
    "kept": """SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding
               FROM embeddings WHERE vec_id % 7 <> 1"""
}


@query(
    "knn_maintained",
    _hits_sql(_L2, 5, False, "q.embedding IS NOT NULL").replace("embeddings AS d", "kept AS d"),
    steps=_MAINTAINED,
)
def _(t):
    """Built from half of the vectors, extended by the others, some replaced and some removed, half of that after compaction."""
    queries, docs = _vectors(t)
    path = shared_path(t.spark, "maintained-index")
    vector_index.build(docs.where("doc_id % 2 = 0"), path, cells=8)
    vector_index.append(docs.where("doc_id % 2 = 1"), path)
    vector_index.delete(docs.where("doc_id % 7 = 1 AND doc_id % 3 = 0"), path)
    vector_index.compact(t.spark, path)
    turned = F.transform("embedding", lambda x: -x).alias("embedding")
    vector_index.append(docs.where("doc_id % 10 = 3").select("doc_id", turned), path)
    index = vector_index.delete(docs.where("doc_id % 7 = 1"), path)
    return vector_index.search(t.spark, queries, index, k=fixed.RETRIEVE_K)


_HITS5 = {"hits": _hits_sql(_L2, 5, False)}


def _results(t):
    hits = retrieval.knn(*_vectors(t), k=fixed.RETRIEVE_K)
    return retrieval.with_texts(hits, t.documents)


@query(
    "retrieval_results",
    """SELECT h.query_id, h.rank, round(1.0::DOUBLE - h.score, 6) AS similarity, h.doc_id, d.text, d.source
       FROM hits AS h JOIN documents AS d ON d.doc_id = h.doc_id""",
    steps=_HITS5,
)
def _(t):
    similarity = F.round(retrieval.similarity(F.col("score")), 6).alias("similarity")
    return _results(t).select("query_id", "rank", similarity, "doc_id", "text", "source")


_LISTS = {
    **_HITS5,
    "lists": """SELECT h.query_id, list(d.text ORDER BY h.rank) AS texts
                FROM hits AS h JOIN documents AS d ON d.doc_id = h.doc_id GROUP BY h.query_id""",
    "asked": """SELECT q.doc_id AS query_id, q.lang || ' ' || q.source AS question, texts
                FROM documents AS q LEFT JOIN lists AS l ON l.query_id = q.doc_id""",
    "contexts": f"""SELECT query_id, question, texts,
        coalesce(array_to_string(texts, chr(10) || chr(10)), {lit(fixed.NO_RELEVANT_DOCUMENTS)}) AS served,
        array_to_string(list_transform(texts[1:3], lambda d: substr(d, 1, 500)), chr(10) || chr(10)) AS viewed FROM asked""",
}


@query(
    "rag_prompt",
    f"""SELECT query_id, {render(fixed.SERVE_PROMPT, context='served', question='question')} AS served,
               CASE WHEN texts IS NOT NULL THEN {render(fixed.VIEWER_PROMPT, context='viewed', question='question')}
                    ELSE {render(fixed.BARE_PROMPT, question='question')} END AS viewed FROM contexts""",
    steps=_LISTS,
)
def _(t):
    lists = retrieval.result_lists(_results(t))
    texts = F.transform("results", lambda r: r["text"])
    asked = t.documents.select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", "lang", "source").alias("question"))
    joined = asked.join(lists.select("query_id", texts.alias("texts")), "query_id", "left")
    return joined.select(
        "query_id",
        prompts.serve_prompt(F.col("texts"), F.col("question")).alias("served"),
        prompts.viewer_prompt(F.col("texts"), F.col("question")).alias("viewed"),
    )


# --- retrieval-augmented samples ----------------------------------------------------------------------------------


def raft_samples(t, exclude_self=False):
    vectors, docs = _vectors(t)
    return raft.samples(
        t.v_qa, vectors, docs, t.documents.select("doc_id", "text"), exclude_self=exclude_self
    )


def _raft_steps(where: str) -> dict[str, str]:
    return {
        "hits": _hits_sql(_L2, 5, False, where),
        "ends": """SELECT query_id, max(CASE WHEN rank = 1 THEN doc_id END) AS golden_id,
                          max(CASE WHEN rank = 5 THEN doc_id END) AS distractor_id
                   FROM hits GROUP BY query_id HAVING count(*) = 5""",
        "samples": """SELECT v.query_id, v.question, g.text AS golden_document, d.text AS distractor_documents,
                             v.answer AS chain_of_thought_answer, v.source
                      FROM ends JOIN v_qa AS v ON v.query_id = ends.query_id
                      JOIN documents AS g ON g.doc_id = golden_id JOIN documents AS d ON d.doc_id = distractor_id
                      WHERE coalesce(v.question, '') <> '' AND coalesce(v.answer, '') <> ''""",
    }


@query("raft_samples", "SELECT * FROM samples", views=("v_qa",), steps=_raft_steps("true"))
def _(t):
    return raft_samples(t)


@query(
    "raft_samples_exclude_self",
    "SELECT * FROM samples",
    views=("v_qa",),
    steps=_raft_steps("q.vec_id <> d.vec_id"),
)
def _(t):
    return raft_samples(t, exclude_self=True)


@query("raft_from_corpus")
def _(t):
    """Corpus, vectors, search and samples in one; the tests compare it with a plain search over the same vectors."""
    qa = t.v_mcq_list.selectExpr("row_id AS query_id", "question", "rationale AS answer", "'choices' AS source")
    # ids of the two corpus parts: articles keep theirs, question texts go below zero
    texts = _wiki(t).unionByName(_qa(t).withColumn("doc_id", -1 - F.col("doc_id")))
    return raft.from_corpus(qa, corpus.limit_tokens(texts, "doc_id").select("doc_id", "text"))


_SEPARATED = "' ' || lang || ' ||| ||| ' || text || '|||' || source"


@query(
    "raft_distractors",
    f"""SELECT doc_id, CAST(len(parts) AS BIGINT) AS n, array_to_string(parts, '#') AS parts FROM (
          SELECT doc_id, list_filter(list_transform(string_split({_SEPARATED}, '|||'), lambda x: {strip('x')}), lambda x: x <> '') AS parts
          FROM documents) AS d""",
)
def _(t):
    parts = raft.distractor_list(F.expr(_SEPARATED))
    return t.documents.select("doc_id", F.size(parts).alias("n"), F.array_join(parts, "#").alias("parts"))


def _raft_prompt(t, answer=True):
    flag = draws.unit(SEED, F.col("query_id")) < fixed.GOLDEN_RATIO_IN_CONTEXT
    distractors = raft.distractor_list(F.col("distractor_documents"))
    return raft.prompt(
        F.col("question"),
        F.col("golden_document"),
        distractors,
        F.col("chain_of_thought_answer") if answer else None,
        flag,
    )


_FLAG = f"{word(SEED, 'query_id')}::DOUBLE / 4294967296.0::DOUBLE < 0.8::DOUBLE"
_PROMPT_STEPS = {
    **_raft_steps("q.vec_id <> d.vec_id"),
    "prepared": f"""SELECT query_id, question, chain_of_thought_answer AS answer,
        CASE WHEN {_FLAG} THEN 'Relevant Document:' || chr(10) || golden_document || chr(10) || chr(10) ELSE '' END
        || 'Distractor Document 1:' || chr(10) || {strip('distractor_documents')} AS context FROM samples
        WHERE length({strip('question')}) > 10 AND length({strip('chain_of_thought_answer')}) > 10""",
}


@query(
    "raft_prompts",
    """SELECT query_id, 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Answer:' AS prompt,
              'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Answer: ' || answer AS text
       FROM prepared""",
    views=("v_qa",),
    steps=_PROMPT_STEPS,
)
def _(t):
    rows = raft_samples(t, exclude_self=True)
    kept = rows.where(raft.valid(F.col("question"), F.col("chain_of_thought_answer")))
    built = kept.select("query_id", _raft_prompt(t, answer=False).alias("prompt"), "chain_of_thought_answer")
    return built.select("query_id", "prompt", raft.completed(F.col("prompt"), F.col("chain_of_thought_answer")).alias("text"))


_ID = "CAST(CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % 32000 AS BIGINT)"
_IDS = f"list_transform(regexp_extract_all({{}}, {TOKENS}), lambda x: {_ID})"
_MASK_STEPS = {
    "exchange": """SELECT conv_id, coalesce(max(CASE WHEN turn = 0 THEN text END), '') AS question,
                          coalesce(max(CASE WHEN turn = 1 THEN text END), '') AS answer FROM conversations GROUP BY conv_id""",
    "encoded": f"""SELECT conv_id, {_IDS.format("question || ' ' || answer")} AS full_ids,
                          CAST(least(len({_IDS.format('question')}), 1024) AS BIGINT) AS prompt_length FROM exchange""",
    "cut": "SELECT conv_id, prompt_length, full_ids[1:1024] AS ids FROM encoded",
}


@query(
    "label_mask",
    """SELECT conv_id, prompt_length, CAST(1024 AS BIGINT) AS n_ids, CAST(len(ids) AS BIGINT) AS n_real,
              CAST(coalesce(list_sum(ids), 0) AS BIGINT) AS id_sum,
              CAST(coalesce(list_sum(ids[prompt_length + 1:]), 0) - 100 * prompt_length AS BIGINT) AS label_sum,
              CAST(prompt_length AS BIGINT) AS n_masked
       FROM cut""",
    steps=_MASK_STEPS,
)
def _(t):
    length = fixed.RAFT_MAX_LENGTH
    pairs = mcq.exchange_rows(t.conversations, exact_turns=None)
    question, answer = (F.coalesce(c, F.lit("")) for c in ("question", "answer"))
    rows = pairs.select(
        "conv_id",
        token_ids(F.concat(question, F.lit(" "), answer)).alias("full_ids"),
        F.least(F.size(token_ids(question)), F.lit(length)).alias("prompt_length"),
    )
    ids = raft.padded(F.col("full_ids"), length, 0)
    rows = rows.withColumn("ids", ids)
    rows = rows.withColumn("labels", raft.labels(F.col("ids"), F.col("prompt_length"), length))

    def total(c):
        return F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)

    return rows.select(
        "conv_id",
        "prompt_length",
        F.size("ids").alias("n_ids"),
        F.least(F.size("full_ids"), F.lit(length)).alias("n_real"),
        total("ids").alias("id_sum"),
        total("labels").alias("label_sum"),
        F.size(F.filter("labels", lambda x: x == -100)).alias("n_masked"),
    )
