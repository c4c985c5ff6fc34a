"""Answer checks, accuracies and rewards as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textprep.functions.rewards import REWARDS
from textprep.functions.text import first_line, strip


def is_correct(inferred: Column, correct: Column) -> Column:
    """Inferred: lower, strip, then first line.  Correct: all of its lines."""
    return first_line(strip(F.lower(inferred))) == F.lower(strip(correct))


def accuracy_runs(df: DataFrame, by: list[str], run: str, correct: str, seconds: str) -> DataFrame:
    """Accuracy and time of each run, then mean and population deviation over the runs."""
    per_run = df.groupBy(*by, run).agg(
        F.avg(F.col(correct).cast("double")).alias("accuracy"), F.sum(seconds).alias("seconds")
    )
    runs = F.transform(
        F.sort_array(F.collect_list(F.struct(run, "accuracy"))), lambda r: r["accuracy"]
    )
    return per_run.groupBy(*by).agg(
        F.avg("accuracy").alias("mean_accuracy"),
        F.stddev_pop("accuracy").alias("std_accuracy"),
        F.avg("seconds").alias("mean_time"),
        runs.alias("runs"),
    )


def macro_summary(results: DataFrame, config: str = "config", compat: bool = False) -> DataFrame:
    """Mean and population deviation over the subjects of each configuration.

    Compat takes a row for every configuration whose name its own name contains, as the original
    does: `thinking` then also takes the rows of `no_thinking`.
    """
    if compat:
        names = results.groupBy(F.col(config).alias("_name")).count().collect()  # the configurations: a handful
        every = F.array(*[F.lit(r["_name"]) for r in names if r["_name"] is not None]).cast("array<string>")
        held = F.filter(every, lambda n: F.contains(F.col(config), n))
        results = results.withColumn(config, F.explode(held))
    return results.groupBy(config).agg(
        F.avg("mean_accuracy").alias("macro_mean"),
        F.stddev_pop("mean_accuracy").alias("macro_std"),
        F.count(F.lit(1)).alias("n_subjects"),
    )


def loglik_accuracy(scores: DataFrame, item: str = "item") -> DataFrame:
    """Share of items whose best-scored choice is the gold one, plain and per character.

    `scores` is (item, choice, score, length, gold); ties go to the earlier choice.
    """

    def best(score: Column) -> Column:
        return F.max_by("choice", F.struct(score, -F.col("choice")))

    per_item = scores.groupBy(item).agg(
        best(F.col("score")).alias("plain"),
        best(F.col("score") / F.col("length")).alias("normalised"),
        F.max("gold").alias("gold"),
    )
    return per_item.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.avg((F.col("plain") == F.col("gold")).cast("double")).alias("acc"),
        F.avg((F.col("normalised") == F.col("gold")).cast("double")).alias("acc_norm"),
    )


def pair_accuracy(df: DataFrame, by: str = "source") -> DataFrame:
    """Share of pairs whose chosen text scores higher, overall and per set."""
    wins = (F.col("score_chosen") > F.col("score_rejected")).cast("double")
    return (
        df.rollup(by)
        .agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(wins).alias("accuracy"), F.grouping(by).alias("_all"))
        .select(
            F.when(F.col("_all") == 1, F.lit("overall")).otherwise(F.col(by).cast("string")).alias(by),
            "n_pairs",
            "accuracy",
        )
    )


def with_rewards(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Add one column per registered reward and their sum."""
    chosen = names or list(REWARDS)
    columns = {f"reward_{name}": REWARDS[name]({c: F.col(c) for c in df.columns}) for name in chosen}
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    return df.withColumns(columns).withColumn("reward", total)


def group_advantage(df: DataFrame, group: str, reward: str = "reward") -> DataFrame:
    """Reward relative to the mean and sample deviation of its group.

    Groups are reduced first and joined back, so a very large group is never sorted in one task.
    """
    stats = df.groupBy(group).agg(F.avg(reward).alias("group_mean"), F.stddev_samp(reward).alias("group_std"))
    spread = F.coalesce(F.col("group_std"), F.lit(0.0)) + F.lit(1e-4)
    stats = stats.withColumnRenamed(group, "_group")
    joined = df.join(stats, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")  # rows without a group are one
    return joined.withColumn("advantage", (F.col(reward) - F.col("group_mean")) / spread)


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
