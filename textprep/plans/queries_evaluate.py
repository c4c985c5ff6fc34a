"""Queries over rewards, answer checks and accuracies."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep import fixed_values as fixed
from textprep.functions import answers, rewards
from textprep.operators import evaluate
from textprep.plans.registry import lit, query, strip
from textprep.schemas import EVAL_RESULT
from textprep.session import shared_path
from textprep.sources import files

_ROLLOUTS = ("v_rollouts",)
_LINE1 = "string_split({}, chr(10))[1]"
_FORMAT = "CASE WHEN regexp_matches(completion, '[ABCDE]\\.\\n*[^\\n]') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
_CORRECT = f"""CASE WHEN {strip(_LINE1.format('completion'))} = {strip(_LINE1.format('final_answer'))}
                    THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"""


@query("reward_format", f"SELECT prompt_id, i, {_FORMAT} AS reward FROM v_rollouts", views=_ROLLOUTS)
def _(t):
    return t.v_rollouts.select("prompt_id", "i", rewards.format_reward(F.col("completion")).alias("reward"))


@query("reward_correctness", f"SELECT prompt_id, i, {_CORRECT} AS reward FROM v_rollouts", views=_ROLLOUTS)
def _(t):
    reward = rewards.correctness_reward(F.col("completion"), F.col("final_answer"))
    return t.v_rollouts.select("prompt_id", "i", reward.alias("reward"))


@query(
    "reward_group_advantage",
    """SELECT prompt_id, i, reward,
              round(avg(reward) OVER (PARTITION BY prompt_id), 6) AS group_mean,
              round((reward - avg(reward) OVER (PARTITION BY prompt_id))
                    / (coalesce(stddev_samp(reward) OVER (PARTITION BY prompt_id), 0) + 0.0001::DOUBLE), 6) + 0.0::DOUBLE AS advantage
       FROM rewarded""",
    views=_ROLLOUTS,
    steps={"rewarded": f"SELECT prompt_id, i, {_FORMAT} + {_CORRECT} AS reward FROM v_rollouts"},
)
def _(t):
    rows = evaluate.group_advantage(evaluate.with_rewards(t.v_rollouts), "prompt_id")
    return rows.select(
        "prompt_id",
        "i",
        "reward",
        F.round("group_mean", 6).alias("group_mean"),
        (F.round("advantage", 6) + F.lit(0.0)).alias("advantage"),
    )


@query(
    "answer_check",
    f"""SELECT prompt_id, i, string_split({strip('lower(completion)')}, chr(10))[1] = lower({strip('final_answer')}) AS correct
        FROM v_rollouts""",
    views=_ROLLOUTS,
)
def _(t):
    correct = evaluate.is_correct(F.col("completion"), F.col("final_answer"))
    return t.v_rollouts.select("prompt_id", "i", correct.alias("correct"))


@query(
    "answer_extract_think",
    f"""SELECT prompt_id, i, {strip("string_split(regexp_replace(completion, '<think>.*?</think>', '', 'gs'), 'answer: ')[-1]")} AS answer
        FROM v_rollouts""",
    views=_ROLLOUTS,
)
def _(t):
    return t.v_rollouts.select("prompt_id", "i", answers.without_think(F.col("completion")).alias("answer"))


_ECHO = "'Question: ' || final_answer || chr(10)"
_MARKED = f"CASE WHEN i % 2 = 0 THEN {_ECHO} || 'Answer:' || completion WHEN i = 5 THEN {_ECHO} ELSE {_ECHO} || completion END"
_GENERATED = f"""SELECT prompt_id, i, {_ECHO} AS prompt, {_MARKED} AS generated FROM v_rollouts"""


@query(
    "answer_extract_last",
    f"""SELECT prompt_id, i, coalesce(nullif({strip('line')}, ''), {lit(fixed.NO_CLEAR_ANSWER)}) AS answer FROM (
          SELECT prompt_id, i, string_split({strip("CASE WHEN contains(generated, 'Answer:') THEN string_split(generated, 'Answer:')[-1] ELSE substr(generated, length(prompt) + 1) END")}, chr(10))[1] AS line
          FROM generated) AS g""",
    views=_ROLLOUTS,
    steps={"generated": _GENERATED},
)
def _(t):
    rows = t.v_rollouts.selectExpr("prompt_id", "i", f"{_ECHO} AS prompt", f"{_MARKED} AS generated")
    answer = answers.after_last(F.col("generated"), F.col("prompt"))
    return rows.select("prompt_id", "i", answer.alias("answer"))


_RUN_STEPS = {
    "runs": """SELECT subject, config, run, avg(correct::DOUBLE) AS accuracy, sum(seconds) AS seconds
               FROM v_graded GROUP BY subject, config, run""",
    "results": """SELECT subject, config, avg(accuracy) AS mean_accuracy, stddev_pop(accuracy) AS std_accuracy,
                         avg(seconds) AS mean_time, list(accuracy ORDER BY run) AS runs FROM runs GROUP BY subject, config""",
}


def _results(t):
    return evaluate.accuracy_runs(t.v_graded, ["subject", "config"], "run", "correct", "seconds")


def _shown(df):
    return df.select(
        "subject",
        "config",
        *[F.round(c, 6).alias(c) for c in ("mean_accuracy", "std_accuracy", "mean_time")],
        F.size("runs").alias("n_runs"),
        *[F.round(F.get("runs", F.lit(i)), 6).alias(f"run_{i}") for i in range(5)],
    )


_SHOWN_SQL = """SELECT subject, config, round(mean_accuracy, 6) AS mean_accuracy, round(std_accuracy, 6) AS std_accuracy,
    round(mean_time, 6) AS mean_time, CAST(len(runs) AS BIGINT) AS n_runs, round(runs[1], 6) AS run_0, round(runs[2], 6) AS run_1,
    round(runs[3], 6) AS run_2, round(runs[4], 6) AS run_3, round(runs[5], 6) AS run_4 FROM results"""


@query("eval_accuracy_runs", _SHOWN_SQL, views=("v_graded",), steps=_RUN_STEPS)
def _(t):
    return _shown(_results(t))


@query("eval_result_json", _SHOWN_SQL, views=("v_graded",), steps=_RUN_STEPS)
def _(t):
    path = shared_path(t.spark, "results-json")
    files.write_json(_results(t), path)
    return _shown(files.read_json(t.spark, path, EVAL_RESULT))


@query(
    "eval_macro_summary",
    """SELECT config, round(avg(mean_accuracy), 6) AS macro_mean, round(stddev_pop(mean_accuracy), 6) AS macro_std,
              count(*) AS n_subjects FROM results GROUP BY config""",
    views=("v_graded",),
    steps=_RUN_STEPS,
)
def _(t):
    summary = evaluate.macro_summary(_results(t))
    return summary.select(
        "config", F.round("macro_mean", 6).alias("macro_mean"), F.round("macro_std", 6).alias("macro_std"), "n_subjects"
    )


_THINKING = "CASE config WHEN 'zero_shot' THEN 'thinking' ELSE 'no_thinking' END"


@query(
    "eval_macro_summary_compat",
    f"""SELECT name AS config, round(avg(mean_accuracy), 6) AS macro_mean, round(stddev_pop(mean_accuracy), 6) AS macro_std,
               count(*) AS n_subjects
        FROM (SELECT {_THINKING} AS config, mean_accuracy FROM results) AS r
        JOIN (VALUES ('thinking'), ('no_thinking')) AS names(name) ON contains(r.config, name) GROUP BY name""",
    views=("v_graded",),
    steps=_RUN_STEPS,
)
def _(t):
    """One name contains the other, so its line takes the rows of both."""
    summary = evaluate.macro_summary(_results(t).withColumn("config", F.expr(_THINKING)), compat=True)
    return summary.select(
        "config", F.round("macro_mean", 6).alias("macro_mean"), F.round("macro_std", 6).alias("macro_std"), "n_subjects"
    )


@query(
    "eval_loglik_acc",
    """SELECT count(*) AS n_items, round(avg((plain = gold)::INT::DOUBLE), 6) AS acc,
              round(avg((normalised = gold)::INT::DOUBLE), 6) AS acc_norm
       FROM (SELECT item, max(gold) AS gold, arg_max(choice, (score, -choice)) AS plain,
                    arg_max(choice, (score / (1 + choice), -choice)) AS normalised
             FROM (SELECT vec_id AS item, unnest([0, 1, 2, 3]) AS choice, label % 4 AS gold,
                          unnest(embedding[1:4])::DOUBLE AS score FROM embeddings) AS s GROUP BY item) AS b""",
)
def _(t):
    scores = t.embeddings.select(
        F.col("vec_id").alias("item"),
        F.posexplode(F.slice("embedding", 1, 4)).alias("choice", "score"),
        (F.col("label") % 4).alias("gold"),
    )
    scores = scores.withColumn("score", F.col("score").cast("double")).withColumn("length", F.col("choice") + 1)
    result = evaluate.loglik_accuracy(scores)
    return result.select("n_items", F.round("acc", 6).alias("acc"), F.round("acc_norm", 6).alias("acc_norm"))


@query(
    "eval_pair_accuracy",
    """SELECT coalesce(CAST(label % 2 AS VARCHAR), 'overall') AS source, count(*) AS n_pairs,
              round(avg((embedding[2] > embedding[3])::INT::DOUBLE), 6) AS accuracy
       FROM embeddings GROUP BY ROLLUP (label % 2)""",
)
def _(t):
    rows = t.embeddings.select(
        (F.col("label") % 2).alias("source"),
        F.get("embedding", F.lit(1)).alias("score_chosen"),
        F.get("embedding", F.lit(2)).alias("score_rejected"),
    )
    return evaluate.pair_accuracy(rows).withColumn("accuracy", F.round("accuracy", 6))
