"""Physical plans: what must not appear, and where."""

import os
import re

import pytest

from textprep.plans.catalogue import QUERIES
from textprep.plans.registry import CHECKS
from textprep.plans.sizing import broadcast_if_small

# Queries that run numpy code inside tasks, and those whose sink or index jobs run while they are built.
PYTHON = {"knn_l2", "knn_cosine", "knn_dot", "knn_l2_pruned", "knn_ivf_recall", "knn_index", "knn_compressed", "knn_maintained", "vector_store", "source_json_split",
          "knn_l2_odd", "knn_cosine_odd", "knn_dot_odd", "raft_from_corpus", "retrieval_results", "rag_prompt", "raft_samples", "raft_samples_exclude_self", "raft_prompts"}
# Plain projections and filters: not a single shuffle.
NARROW = ["mcq_letter_options", "mcq_prelettered", "mcq_label_lookup", "mcq_index_answer", "option_shuffle",
          "mcq_repair_letters", "mcq_rationale", "eval_extract_choices", "eval_gold_index", "eval_doc", "few_shot_prompt",
          "preference_prompt", "clean_think", "clean_first_marker", "clean_last_marker", "ranking_parse", "ranking_valid",
          "preference_pairs", "corpus_tagged", "corpus_qa", "corpus_metadata", "filter_single_choice", "filter_subject_in",
          "filter_source_ne", "filter_domain", "filter_blank_content", "filter_answered", "doc_preview", "raft_distractors",
          "source_parquet"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_quadratic_join_and_no_stray_python(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    if name not in PYTHON:
        assert not re.search(r"Python|InPandas|InArrow|BatchEval", text)
    if "documents.parquet" in text or "part.parquet" in text:
        # One-partition windows only ever see one row per bucket.
        for block in re.findall(r"Exchange SinglePartition.*\n.*", text):
            assert "HashAggregate" in block or "Aggregate" in block, block


@pytest.mark.parametrize("name", NARROW)
def test_narrow_queries_do_not_shuffle(name, spark, sf_dir):
    assert "Exchange" not in plan(QUERIES[name](spark, sf_dir))


def test_columns_are_pruned_and_filters_pushed(spark, sf_dir):
    text = plan(QUERIES["filter_source_ne"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in text
    text = plan(QUERIES["seeded_shuffle_rank"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint>" in text


def test_costly_filter_column_runs_once(spark, sf_dir):
    text = plan(QUERIES["filter_token_limit"](spark, sf_dir))
    assert text.count("regexp_extract_all") == 1


def test_group_limit_is_pruned_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(QUERIES["top_n_per_source"](spark, sf_dir))


def test_broadcast_needs_a_small_side(spark):
    df = spark.range(100)
    hinted, rows = broadcast_if_small(df)
    assert rows == 100 and "broadcast" in hinted._jdf.queryExecution().logical().toString()
    plain, _ = broadcast_if_small(df, max_bytes=10)
    assert plain is df


def test_template_join_is_broadcast(spark, sf_dir):
    assert "BroadcastHashJoin" in plan(QUERIES["template_fill"](spark, sf_dir))


def test_sources_hold_no_local_shortcuts():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "textprep")
    for folder, _, names in os.walk(root):
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf8") as source:
                    text = source.read()
                assert "localCheckpoint" not in text and "crossJoin" not in text and ".toPandas(" not in text
    assert set(CHECKS) <= set(QUERIES)
