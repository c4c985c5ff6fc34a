"""Queries over model answers, rankings and preference pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep import fixed_values as fixed
from textprep.functions import answers
from textprep.functions.text import token_count
from textprep.operators import attempts, preference
from textprep.plans.queries_mcq import CHATS, choose_sql, nested_turns
from textprep.plans.registry import hash_key, lit, n_tokens, query, strip, word, WS
from textprep.session import shared_path
from textprep.sources import adapters, files

SEED = fixed.SEED
MODELS = ["model_a", "model_b", "model_c"]
COLUMNS = ["answer_a", "answer_b", "answer_c"]
_CLEAN = dict(zip(MODELS, (answers.after_think, answers.from_first_marker, answers.from_last_marker)))


def _think_sql(x: str) -> str:
    return f"""CASE WHEN strpos({x}, '</think>') > 0
                    THEN ltrim(substr({x}, strpos({x}, '</think>') + 8), {WS}) ELSE {x} END"""


def _first_sql(x: str) -> str:
    places = ", ".join(f"nullif(strpos({x}, {lit(m)}), 0)" for m in fixed.ANSWER_MARKERS)
    return strip(f"replace(substr({x}, CAST(coalesce(least({places}), 1) AS BIGINT)), '</s>', '')")


def _rfind(x: str, mark: str) -> str:
    back = f"strpos(reverse({x}), reverse({lit(mark)}))"
    return f"CASE WHEN {back} > 0 THEN length({x}) - {back} - {len(mark)} + 2 END"


def _last_sql(x: str) -> str:
    places = ", ".join(_rfind(x, m) for m in fixed.ANSWER_MARKERS)
    cut = f"substr({x}, CAST(coalesce(greatest({places}), 1) AS BIGINT))"
    return strip(
        f"""CASE WHEN strpos(lower({cut}), 'assistant') > 0
                 THEN substr({cut}, strpos(lower({cut}), 'assistant') + 9) ELSE {cut} END"""
    )


_CANDIDATES = ("v_candidates",)


@query("clean_think", f"SELECT row_id, {_think_sql('answer_a')} AS answer FROM v_candidates", views=_CANDIDATES)
def _(t):
    return t.v_candidates.select("row_id", answers.after_think(F.col("answer_a")).alias("answer"))


@query("clean_first_marker", f"SELECT row_id, {_first_sql('answer_b')} AS answer FROM v_candidates", views=_CANDIDATES)
def _(t):
    return t.v_candidates.select("row_id", answers.from_first_marker(F.col("answer_b")).alias("answer"))


@query("clean_last_marker", f"SELECT row_id, {_last_sql('answer_c')} AS answer FROM v_candidates", views=_CANDIDATES)
def _(t):
    return t.v_candidates.select("row_id", answers.from_last_marker(F.col("answer_c")).alias("answer"))


@query(
    "answers_attach",
    f"""SELECT row_id, prompt, {_think_sql('answer_a')} AS model_a, {_first_sql('answer_b')} AS model_b,
               {_last_sql('answer_c')} AS model_c FROM v_candidates""",
    views=_CANDIDATES,
)
def _(t):
    requests = t.v_distill.select("row_id", "prompt")
    return preference.attach(requests, t.v_responses, "row_id", MODELS, clean=_CLEAN)


@query("answers_missing", "SELECT row_id, 'model_a' AS model FROM v_candidates WHERE answer_a IS NULL", views=_CANDIDATES)
def _(t):
    return preference.missing(t.v_distill, t.v_responses, "row_id", MODELS)


@query(
    "answers_duplicated",
    """SELECT row_id, model, CAST(count(*) AS BIGINT) AS answers FROM (
         SELECT row_id, model FROM v_responses UNION ALL SELECT row_id, model FROM v_responses WHERE model = 'model_a') AS r
       GROUP BY row_id, model HAVING count(*) > 1""",
    views=("v_responses",),
)
def _(t):
    again = t.v_responses.where(F.col("model") == "model_a")
    return preference.duplicated(t.v_responses.unionByName(again), "row_id")


@query(
    "pending_requests",
    "SELECT row_id, prompt FROM v_distill AS d WHERE NOT EXISTS (SELECT 1 FROM v_candidates AS c WHERE c.row_id = d.row_id AND c.ranking IS NOT NULL)",
    views=("v_candidates",),
)
def _(t):
    judged = t.v_candidates.where(F.col("ranking").isNotNull()).select("row_id", F.lit("judge").alias("model"))
    left = preference.missing(t.v_distill, judged, "row_id", ["judge"]).select("row_id")
    return t.v_distill.join(left, "row_id", "left_semi").select("row_id", "prompt")


@query(
    "request_attempts",
    """SELECT d.row_id AS key, m.model, CAST(CASE WHEN d.row_id % 5 = 0 THEN 3 ELSE 2 END AS BIGINT) AS attempt
       FROM v_distill AS d, (VALUES ('model_a'), ('model_b'), ('model_c')) AS m(model)
       WHERE NOT EXISTS (SELECT 1 FROM v_responses AS r WHERE r.row_id = d.row_id AND r.model = m.model AND r.response IS NOT NULL)""",
    views=("v_responses",),
)
def _(t):
    """A run that was interrupted: what was answered stays, what failed or whose lease has ended is claimed once more."""

    def minute(n):
        return F.lit(f"2024-01-01 00:{n:02d}:00").cast("timestamp")

    path, requests = shared_path(t.spark, "attempts"), attempts.pairs(t.v_distill, "row_id", ["model_a", "model_b", "model_c"])
    claims = attempts.claim(requests, path, minute(0), "10 minutes", "first")
    answered = t.v_responses.where("response IS NOT NULL").select(F.col("row_id").alias("key"), "model")
    attempts.settle(claims.join(answered, ["key", "model"], "left_semi"), path, minute(1), "first")
    failed = claims.join(answered, ["key", "model"], "left_anti").where("key % 5 = 0")
    attempts.settle(failed, path, minute(2), "first", attempts.FAILED)
    attempts.claim(requests, path, minute(5), "10 minutes", "second")  # gets what has failed, and crashes
    return attempts.claim(requests, path, minute(20), "10 minutes", "third")


_TAIL = f"rtrim({strip('substr(ranking, strpos(ranking, ' + lit('Ranking:') + '))')}, '.')"
_RANK_STEPS = {
    "split_up": f"""SELECT *, list_transform(string_split(substr({_TAIL}, 9), '>'), lambda x: {strip('x')}) AS found
                    FROM v_candidates""",
    "ranked": """SELECT *, CASE WHEN strpos(ranking, 'Ranking:') > 0 AND len(found) = 3
                        AND len(list_filter(found, lambda x: x IN ('A', 'B', 'C'))) = 3 THEN found END AS labels FROM split_up""",
}


@query(
    "ranking_parse",
    "SELECT row_id, array_to_string(labels, '>') AS labels FROM ranked",
    views=_CANDIDATES,
    steps=_RANK_STEPS,
)
def _(t):
    labels = preference.parse_ranking(F.col("ranking"))
    return t.v_candidates.select("row_id", F.array_join(labels, ">").alias("labels"))


@query(
    "ranking_valid",
    "SELECT row_id, ranking FROM ranked WHERE labels IS NOT NULL",
    views=_CANDIDATES,
    steps=_RANK_STEPS,
)
def _(t):
    valid = preference.parse_ranking(F.col("ranking")).isNotNull()
    return t.v_candidates.where(valid).select("row_id", "ranking")


def _answer_sql(label: str) -> str:
    return f"CASE {label} WHEN 'A' THEN answer_a WHEN 'B' THEN answer_b ELSE answer_c END"


_HAS = "(len(options) > 0 AND NOT (len(options) = 1 AND options[1] = ''))"
_SECOND = f"{word(SEED, 'row_id')}::DOUBLE / 4294967296.0::DOUBLE < 0.9::DOUBLE"
_PAIR_STEPS = {
    **_RANK_STEPS,
    "paired": f"""SELECT row_id, CASE WHEN {_HAS} THEN prompt || chr(10) || 'Options:' || chr(10) || array_to_string(options, chr(10))
                              ELSE prompt END AS prompt,
                         {_answer_sql('labels[1]')} AS chosen,
                         {_answer_sql(f'CASE WHEN {_SECOND} THEN labels[2] ELSE labels[3] END')} AS rejected,
                         'distilled' AS source FROM ranked WHERE labels IS NOT NULL""",
}


@query("preference_pairs", "SELECT * FROM paired", views=_CANDIDATES, steps=_PAIR_STEPS)
def _(t):
    return preference.pairs(t.v_candidates, "row_id", COLUMNS)


def _signed(t):
    pairs = t.v_pair.join(nested_turns(t), F.col("doc_id") == F.col("conv_id"))
    return preference.from_sign(pairs, keep=("doc_id", "domain"))


_SIGN_STEPS = {
    **CHATS,
    "signed": """SELECT doc_id, domain, chat AS prompt,
                        CASE WHEN overall_preference < 0 THEN response1 ELSE response2 END AS chosen,
                        CASE WHEN overall_preference < 0 THEN response2 ELSE response1 END AS rejected, 'HelpSteer3' AS source
                 FROM v_pair JOIN chats ON doc_id = conv_id""",
}


@query("preference_from_sign", "SELECT * FROM signed", views=("v_pair",), steps=_SIGN_STEPS)
def _(t):
    return _signed(t)


@query(
    "preference_eval_table",
    """SELECT prompt, chosen, rejected, source, 'test' AS split FROM signed WHERE domain IN ('code', 'stem')
       UNION ALL SELECT lang, text, source, 'reward-bench', 'test' FROM documents""",
    views=("v_pair",),
    steps=_SIGN_STEPS,
)
def _(t):
    return adapters.union_by_name(list(_eval_sets(t).values())).withColumn("split", F.lit("test"))


def _eval_sets(t):
    bench = t.documents.selectExpr("lang AS prompt", "text AS chosen", "source AS rejected")
    return {
        "steering": preference.in_domains(_signed(t)).drop("doc_id", "domain"),
        "reward_bench": adapters.adapt(bench, adapters.REWARD_BENCH, fixed.SOURCE_TAGS["reward_bench"]),
    }


@query(
    "preference_eval_sets",
    """SELECT x.name, prompt, chosen, rejected, source, 'test' AS split
       FROM (SELECT 'steering' AS own, prompt, chosen, rejected, source FROM signed WHERE domain IN ('code', 'stem')
             UNION ALL SELECT 'reward_bench', lang, text, source, 'reward-bench' FROM documents) AS s
       CROSS JOIN (VALUES ('steering'), ('reward_bench'), ('merged')) AS x(name) WHERE x.name IN (own, 'merged')""",
    views=("v_pair",),
    steps=_SIGN_STEPS,
)
def _(t):
    """Every evaluation set as a table of its own, and all of them as one, written and read back."""
    path = shared_path(t.spark, "evaluation-sets")
    names = files.write_sets(_eval_sets(t), path)
    parts = [files.read_split(t.spark, f"{path}/{name}", "test").withColumn("name", F.lit(name)) for name in names]
    return adapters.union_by_name(parts)


_DATASET_STEPS = {
    **_PAIR_STEPS,
    "merged": """SELECT 4 * row_id AS pair_id, prompt, chosen, rejected, source FROM paired
                 UNION ALL SELECT 4 * doc_id + 1, lang, text, source, 'code-preference-pairs' FROM documents
                 UNION ALL SELECT 4 * doc_id + 2, source, text, lang, 'python-dpo' FROM documents
                 UNION ALL SELECT 4 * doc_id + 3, text, lang, source, 'math-dpo' FROM documents""",
}


@query(
    "preference_dataset",
    f"""SELECT *, CASE WHEN row_number() OVER (ORDER BY {hash_key(SEED, 'pair_id')}, pair_id)
                       <= ceil(0.1::DOUBLE * (SELECT count(*) FROM merged)) THEN 'validation' ELSE 'train' END AS split
        FROM merged""",
    views=_CANDIDATES,
    steps=_DATASET_STEPS,
)
def _(t):
    distilled = preference.pairs(t.v_candidates, "row_id", COLUMNS)
    docs, tags = t.documents, fixed.SOURCE_TAGS
    code = docs.selectExpr("4 * doc_id + 1 AS pair_id", "lang AS input", "text AS accepted", "source AS rejected")
    python = docs.selectExpr("4 * doc_id + 2 AS pair_id", "source AS prompt", "text AS chosen", "lang AS rejected")
    math = docs.selectExpr("4 * doc_id + 3 AS pair_id", "text AS question", "lang AS chosen", "source AS rejected")
    return preference.dataset(
        [
            distilled.withColumn("pair_id", 4 * F.col("row_id")).drop("row_id"),
            adapters.adapt(code, adapters.CODE_PAIRS, tags["code_pairs"], ("pair_id",)),
            adapters.adapt(python, adapters.PYTHON_PAIRS, tags["python_pairs"], ("pair_id",)),
            adapters.adapt(math, adapters.MATH_PAIRS, tags["math_pairs"], ("pair_id",)),
        ],
        "pair_id",
    )


_JUDGE_SQL = choose_sql(
    fixed.JUDGE_PROMPTS, answer_a="answer_a", answer_b="answer_b", answer_c="answer_c"
)
_JUDGE_STEPS = {"judged": f"SELECT row_id, {_JUDGE_SQL} AS prompt FROM v_candidates"}


@query(
    "judge_requests",
    f"SELECT row_id, prompt, {n_tokens('prompt')} AS n_tokens FROM judged",
    views=_CANDIDATES,
    steps=_JUDGE_STEPS,
)
def _(t):
    return preference.judge_requests(t.v_candidates, "row_id", COLUMNS)


@query(
    "answer_request_batches",
    f"""SELECT row_id, {choose_sql(fixed.EXPLAIN_PROMPTS)} AS prompt, row_number() OVER (ORDER BY row_id) AS position,
               (row_number() OVER (ORDER BY row_id) - 1) // 8 AS batch_id FROM v_distill""",
    views=("v_distill",),
)
def _(t):
    return preference.answer_requests(t.v_distill, "row_id", fixed.EXPLAIN_PROMPTS)


@query(
    "token_usage_batches",
    f"""SELECT doc_id, n_tokens, row_number() OVER (ORDER BY doc_id) AS position,
               CAST(sum(n_tokens) OVER (ORDER BY doc_id) AS BIGINT) AS used_tokens,
               (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS batch_id
        FROM (SELECT doc_id, {n_tokens('text')} AS n_tokens FROM documents) AS d""",
)
def _(t):
    requests = t.documents.select("doc_id", token_count(F.col("text")).cast("long").alias("n_tokens"))
    return preference.token_usage(requests, "doc_id")


@query(
    "rank_distribution",
    """SELECT 'answer_' || lower(label) AS model, place, count(*) AS n
       FROM (SELECT unnest(labels) AS label, unnest([1, 2, 3])::BIGINT AS place FROM ranked WHERE labels IS NOT NULL) AS r
       GROUP BY label, place""",
    views=_CANDIDATES,
    steps=_RANK_STEPS,
)
def _(t):
    return preference.rank_distribution(t.v_candidates, COLUMNS)
