"""Queries over sources, sinks, adapters, filters and incremental writes."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from textprep import fixed_values as fixed
from textprep.functions import prompts
from textprep.functions.text import strip as strip_text, token_count, truncate
from textprep.operators import corpus, evaluate, mcq, preference, raft, sampling
from textprep.plans.registry import lit, n_tokens, query, strip, TOKENS
from textprep.schemas import MIXED_QUESTION
from textprep.session import shared_path
from textprep.sources import adapters, files
from textprep.sources.catalog import Catalog
from textprep.sources.identity import with_row_id
from textprep.streaming import incremental, stateful

_DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@query("source_parquet", "SELECT doc_id, lang, source, n_chars, length(text) AS chars FROM documents")
def _(t):
    catalog = Catalog().register("corpus", f"{t._folder}/documents.parquet", config="raw", split="train")
    table = catalog.read_table(t.spark, "corpus", "raw", "train")
    return table.select("doc_id", "lang", "source", "n_chars", F.length("text").alias("chars"))


_MIXED = """SELECT question_type, question_body, array_to_string(question_options, '|') AS options,
                   question_answer FROM v_mixed"""


def _mixed_records(t, **how):
    path = shared_path(t.spark, "mixed-json")
    files.write_json_arrays(t.v_mixed, path, "row_id")
    records = files.read_json_array(t.spark, path, MIXED_QUESTION, **how)
    return records.select(
        "question_type", "question_body", F.array_join("question_options", "|").alias("options"), "question_answer"
    )


@query("source_json", _MIXED, views=("v_mixed",))
def _(t):
    return _mixed_records(t)


@query("source_json_split", _MIXED, views=("v_mixed",))
def _(t):
    """The same with every array read in byte ranges."""
    return _mixed_records(t, split_above=0)


_TEMPLATE = "concat('About ', p_brand, ', ', p_type, ':\\n\\n<question>\\nAnswer:')"


def template_table(t):
    """One template for each brand and type (there are 150), written as JSON arrays of bounded size and read back."""
    path = shared_path(t.spark, "templates")
    files.write_templates(t.part.selectExpr(f"{_TEMPLATE} AS template").distinct(), path, per_file_rows=64)
    return files.read_templates(t.spark, path)


TEMPLATES = {
    "templates": """SELECT CAST(row_number() OVER (ORDER BY template) - 1 AS BIGINT) AS template_id, template
                    FROM (SELECT DISTINCT 'About ' || p_brand || ', ' || p_type || ':' || chr(10) || chr(10)
                                 || '<question>' || chr(10) || 'Answer:' AS template FROM part) AS d"""
}


@query("template_dim", "SELECT template_id, template FROM templates", steps=TEMPLATES)
def _(t):
    return template_table(t)


@query(
    "csv_roundtrip",
    """SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents""",
)
def _(t):
    path = shared_path(t.spark, "documents-csv")
    files.write_csv(t.documents.select(*_DOCUMENT.names), path)
    return files.read_csv(t.spark, path, _DOCUMENT)


@query(
    "csv_append",
    """SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars
       FROM (SELECT lang, n_chars FROM documents UNION ALL SELECT lang, n_chars FROM documents) AS d GROUP BY lang""",
)
def _(t):
    path = shared_path(t.spark, "documents-csv-append")
    for _run in range(2):
        files.write_csv(t.documents.select(*_DOCUMENT.names), path, mode="append")
    rows = files.read_csv(t.spark, path, _DOCUMENT)
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("stage_roundtrip", "SELECT doc_id, text, source FROM documents")
def _(t):
    path = shared_path(t.spark, "stage")
    files.save_table(t.documents.select("doc_id", "text", "source"), path)
    return files.load_table(t.spark, path)


@query(
    "split_partition_counts",
    """SELECT split, source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars
       FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split,
                    source, text FROM documents) AS d GROUP BY split, source""",
)
def _(t):
    path = shared_path(t.spark, "splits")
    split = "CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END"
    files.write_splits(t.documents.withColumn("split", F.expr(split)), path)
    parts = [files.read_split(t.spark, path, name) for name in ("train", "validation", "test")]
    return (
        adapters.union_by_name(parts)
        .groupBy("split", "source")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    )


@query(
    "row_identity",
    """SELECT p_brand, p_type,
              CAST(row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS BIGINT) AS copy FROM part""",
)
def _(t):
    keyed = with_row_id(t.part.select("p_brand", "p_type"))
    return keyed.select("p_brand", "p_type", F.substring_index("row_id", "-", -1).cast("long").alias("copy"))


@query(
    "sft_prompt_completion",
    """SELECT row_id, question AS prompt, rationale AS completion FROM v_mcq_list
       WHERE {} + {} < 10""".format(n_tokens("question"), n_tokens("rationale")),
    views=("v_mcq_list",),
)
def _(t):
    rows = t.v_mcq_list.select("row_id", "question", F.col("rationale").alias("answer"))
    return sampling.sft_view(rows, max_length=10)


@query(
    "preference_adapters",
    """SELECT doc_id, lang AS prompt, text AS chosen, source AS rejected, tag AS source
       FROM documents, (VALUES ('code-preference-pairs'), ('python-dpo'), ('math-dpo')) AS tags(tag)""",
)
def _(t):
    d = t.documents
    code = d.selectExpr("doc_id", "lang AS input", "text AS accepted", "source AS rejected")
    python = d.selectExpr("doc_id", "lang AS prompt", "text AS chosen", "source AS rejected")
    math = d.selectExpr("doc_id", "lang AS question", "text AS chosen", "source AS rejected")
    tags = fixed.SOURCE_TAGS
    return adapters.union_by_name(
        [
            adapters.adapt(code, adapters.CODE_PAIRS, tags["code_pairs"], keep=("doc_id",)),
            adapters.adapt(python, adapters.PYTHON_PAIRS, tags["python_pairs"], keep=("doc_id",)),
            adapters.adapt(math, adapters.MATH_PAIRS, tags["math_pairs"], keep=("doc_id",)),
        ]
    )


@query(
    "corpus_metadata",
    """SELECT doc_id, source, length(text) AS char_length, lang AS meta_lang,
              CAST(length(text) AS VARCHAR) AS meta_chars, CAST(doc_id AS VARCHAR) AS meta_id,
              CAST(5 AS BIGINT) AS entries
       FROM documents WHERE {} <> ''""".format(strip("text")),
)
def _(t):
    docs = corpus.to_documents(t.documents, "doc_id")
    return docs.select(
        "doc_id",
        "source",
        "char_length",
        F.col("metadata")["lang"].alias("meta_lang"),
        F.col("metadata")["char_length"].alias("meta_chars"),
        F.col("metadata")["doc_id"].alias("meta_id"),
        F.size("metadata").alias("entries"),
    )


@query(
    "corpus_documents_exported",
    """SELECT doc_id, {0} AS text, source, length({0}) AS char_length FROM v_blank
       WHERE lower({0}) NOT IN ('', 'nan', 'null')""".format(strip("text")),
    views=("v_blank",),
)
def _(t):
    return corpus.to_documents(t.v_blank, "doc_id", exported=True).drop("metadata")


# --- filters ------------------------------------------------------------------------------------------


@query("filter_single_choice", "SELECT row_id, question FROM v_mcq_cols WHERE choice_type = 'single'", views=("v_mcq_cols",))
def _(t):
    return mcq.single_choice(t.v_mcq_cols).select("row_id", "question")


@query(
    "filter_subject_in",
    """SELECT row_id, subject, split FROM v_mcq_idx
       WHERE split = 'auxiliary_train' OR subject IN ({})""".format(", ".join(lit(s) for s in fixed.STEM_SUBJECTS)),
    views=("v_mcq_idx",),
)
def _(t):
    return mcq.in_subjects(t.v_mcq_idx).select("row_id", "subject", "split")


@query(
    "filter_source_ne",
    """SELECT doc_id, source FROM (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN source END AS source
       FROM documents) AS d WHERE source IS DISTINCT FROM 'src1'""",
)
def _(t):
    rows = t.documents.selectExpr("doc_id", "CASE WHEN doc_id % 11 <> 0 THEN source END AS source")
    return adapters.drop_source(rows, "src1")


@query(
    "filter_two_turn",
    """SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS question, max(CASE WHEN turn = 1 THEN text END) AS answer
       FROM conversations GROUP BY conv_id HAVING count(*) = 2""",
)
def _(t):
    return mcq.exchange_rows(t.conversations).drop("turns")


@query("filter_domain", "SELECT doc_id, domain FROM v_pair WHERE domain IN ('code', 'stem')", views=("v_pair",))
def _(t):
    return preference.in_domains(t.v_pair).select("doc_id", "domain")


@query(
    "filter_valid_example",
    """SELECT doc_id, question, answer FROM
       (SELECT doc_id, text AS question, CASE WHEN doc_id % 4 = 0 THEN '  ' || lang || '  ' ELSE source || ' by ' || lang END AS answer
        FROM documents) AS d WHERE length({}) > 10 AND length({}) > 10""".format(strip("question"), strip("answer")),
)
def _(t):
    rows = t.documents.selectExpr(
        "doc_id",
        "text AS question",
        "CASE WHEN doc_id % 4 = 0 THEN '  ' || lang || '  ' ELSE source || ' by ' || lang END AS answer",
    )
    return rows.where(raft.valid(F.col("question"), F.col("answer")))


@query(
    "filter_blank_content",
    """SELECT doc_id, text FROM v_blank WHERE lower({}) NOT IN ('', 'nan', 'null')""".format(strip("text")),
    views=("v_blank",),
)
def _(t):
    return t.v_blank.where(~corpus.is_blank(F.col("text"))).select("doc_id", "text")


@query(
    "filter_pair_token_budget",
    """SELECT conv_id, question, answer FROM (
         SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS question,
                max(CASE WHEN turn = 1 THEN text END) AS answer FROM conversations GROUP BY conv_id) AS c
       WHERE {} + {} < 128""".format(n_tokens("question"), n_tokens("answer")),
)
def _(t):
    rows = mcq.exchange_rows(t.conversations, exact_turns=None).drop("turns")
    return sampling.within_pair_budget(rows, "question", "answer", fixed.RL_MAX_TOKENS)


@query(
    "filter_token_limit",
    "SELECT doc_id, {0} AS token_count FROM documents WHERE {0} <= 512".format(n_tokens("text")),
)
def _(t):
    return corpus.limit_tokens(t.documents, "doc_id").select("doc_id", "token_count")


@query(
    "filter_answered",
    """SELECT doc_id AS query_id, text AS question FROM v_blank WHERE coalesce(text, '') <> '' AND coalesce(source, '') <> ''""",
    views=("v_blank",),
)
def _(t):
    rows = t.v_blank.selectExpr("doc_id AS query_id", "text AS question", "source AS answer")
    return adapters.answered(rows).select("query_id", "question")


# --- texts ------------------------------------------------------------------------------------------------


@query("token_count", "SELECT doc_id, {} AS token_count FROM documents".format(n_tokens("text")))
def _(t):
    return t.documents.select("doc_id", token_count(F.col("text")).alias("token_count"))


@query(
    "token_truncate",
    """SELECT doc_id, CASE WHEN len(toks) <= 256 THEN text ELSE array_to_string(toks[1:256], ' ') END AS text,
              CAST(least(len(toks), 256) AS BIGINT) AS token_count
       FROM (SELECT doc_id, text, regexp_extract_all(text, {}) AS toks FROM documents) AS d""".format(TOKENS),
)
def _(t):
    return t.documents.select("doc_id", truncate(F.col("text"), 256).alias("cut")).select("doc_id", "cut.*")


@query(
    "doc_preview",
    """SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS short,
              CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS long FROM documents""",
)
def _(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id", prompts.preview(text, 100).alias("short"), prompts.preview(text, 300).alias("long")
    )


@query(
    "counts_by_source_split",
    """SELECT source, CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split, count(*) AS n
       FROM documents GROUP BY 1, 2""",
)
def _(t):
    split = "CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END"
    return evaluate.counts(t.documents.withColumn("split", F.expr(split)), "source", "split")


# --- incremental -------------------------------------------------------------------------------------------


_ARRIVED = """SELECT doc_id, source, text FROM documents
              UNION ALL SELECT -1 - item_id, 'benchmark', text FROM benchmark"""


@query("incremental_append", f"SELECT doc_id, source, {strip('text')} AS text FROM ({_ARRIVED}) AS a")
def _(t):
    """The second arrival repeats every document and adds new items; the sink holds each row once."""
    spark = t.spark
    arrivals, sink, state = (shared_path(spark, name) for name in ("arrivals", "sink", "progress"))

    def stripped(batch):
        return batch.select("doc_id", "source", strip_text(F.col("text")).alias("text"))

    first = t.documents.select("doc_id", "source", "text")
    added = t.benchmark.selectExpr("-1 - item_id AS doc_id", "'benchmark' AS source", "text")
    for arrival in (first, first.unionByName(added)):
        arrival.write.mode("append").parquet(arrivals)
        incremental.run(spark, arrivals, first.schema, sink, state, "doc_id", stripped)
    return incremental.read_sink(spark, sink)


@query(
    "streaming_dedup",
    "SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS day FROM documents",
)
def _(t):
    """Three arrivals, the later ones with repeats, and a restart before each: the state lets the first of each document pass."""
    arrivals, sink, state = (shared_path(t.spark, name) for name in ("stream-in", "stream-out", "stream-state"))
    for day, some in ((1, "doc_id % 2 = 0"), (2, "true"), (3, "doc_id % 3 = 0")):
        at = F.make_timestamp(F.lit(2024), F.lit(1), F.lit(day), F.lit(0), F.lit(0), F.lit(0)).alias("at")
        arrived = t.documents.where(some).select("doc_id", F.lit(day).cast("long").alias("day"), at)
        arrived.write.mode("append").parquet(arrivals)
        stateful.run(t.spark, arrivals, arrived.schema, sink, state, "doc_id", "at")
    return t.spark.read.schema("doc_id long, day long").parquet(sink)
