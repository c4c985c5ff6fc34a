"""Model answers, judge rankings and preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textprep import fixed_values as fixed
from textprep.functions import answers, draws, prompts
from textprep.functions.text import Counter, strip, token_count
from textprep.operators.sampling import exact_split, running_totals, in_batches
from textprep.plans.barrier import computed_once
from textprep.sources.adapters import union_by_name

CLEANERS = {
    fixed.ANSWER_COLUMNS[0]: answers.after_think,
    fixed.ANSWER_COLUMNS[1]: answers.from_first_marker,
    fixed.ANSWER_COLUMNS[2]: answers.from_last_marker,
}


def answer_requests(df: DataFrame, id_col: str, templates: dict[str, str], batch_size: int = 8) -> DataFrame:
    """Request table of one model: prompt, its place in id order, and the batch it is sent in."""
    prompt = prompts.choose(templates, F.col("prompt"), F.col("options"), F.col("answer"))
    placed = running_totals(df.select(id_col, prompt.alias("prompt")), id_col, {})
    return in_batches(placed, batch_size)


def attach(
    requests: DataFrame, responses: DataFrame, key: str, models: list[str], clean=CLEANERS, arrival: str | None = None
) -> DataFrame:
    """One answer column per model, joined by key.

    `responses` is (key, model, response) and may have an `arrival` column: of several answers to one
    request the one that arrived last counts.  Without it the greatest text counts; `duplicated` lists
    such requests.  The models are combined in one aggregation on the key, which leaves the rows
    partitioned for the join that follows.
    """

    def one(model: str) -> Column:
        own, text = F.col("model") == model, clean.get(model, lambda c: c)(F.col("response"))
        if arrival is None:
            return F.max(F.when(own, text))
        return F.max_by(text, F.when(own, F.struct(F.col(arrival), F.col("response"))))

    columns = [one(model).alias(model) for model in models]
    return requests.join(responses.groupBy(key).agg(*columns), key, "left")


def missing(requests: DataFrame, responses: DataFrame, key: str, models: list[str]) -> DataFrame:
    """(key, model) pairs still without a response: what is left to do after an interruption."""
    wanted = requests.select(key, F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    return wanted.join(responses.select(key, "model"), [key, "model"], "left_anti")


def duplicated(responses: DataFrame, key: str) -> DataFrame:
    """(key, model) pairs that were answered more than once."""
    return responses.groupBy(key, "model").agg(F.count(F.lit(1)).alias("answers")).where("answers > 1")


def judge_requests(df: DataFrame, id_col: str, answer_columns: list[str], tok: Counter = token_count) -> DataFrame:
    """Judging prompt over three answers, with its token count."""
    three = {name: F.col(f"`{c}`") for name, c in zip(("answer_a", "answer_b", "answer_c"), answer_columns)}
    prompt = prompts.choose(
        fixed.JUDGE_PROMPTS, F.col("prompt"), F.col("options"), F.col("answer"), **three
    )
    return df.select(id_col, prompt.alias("prompt")).withColumn("n_tokens", tok(F.col("prompt")))


def token_usage(requests: DataFrame, id_col: str, batch_rows: int = fixed.JUDGE_BACKUP_ROWS) -> DataFrame:
    """Running token use in id order and the backup batch of each request."""
    return in_batches(running_totals(requests, id_col, {"used_tokens": "n_tokens"}), batch_rows)


def parse_ranking(c: Column, labels: list[str] = fixed.RANKING_LABELS) -> Column:
    """Labels best to worst, or NULL.

    Everything after the first mark must be exactly three known labels, trailing dots aside;
    duplicates pass, commentary does not.
    """
    start = F.instr(c, fixed.RANKING_MARK)
    tail = F.rtrim(strip(F.substr(c, start)), F.lit("."))
    ranked = F.transform(
        F.split(F.substr(tail, F.lit(len(fixed.RANKING_MARK) + 1)), ">"), lambda label: strip(label)
    )
    valid = (start > 0) & (F.size(ranked) == len(labels)) & F.forall(ranked, lambda x: x.isin(labels))
    return F.when(valid, ranked)


def _answer_of(label: Column, answer_columns: list[str]) -> Column:
    chosen = F.lit(None).cast("string")
    for name, column in zip(fixed.RANKING_LABELS, answer_columns):
        chosen = F.when(label == name, F.col(f"`{column}`")).otherwise(chosen)
    return chosen


def pairs(
    df: DataFrame,
    id_col: str,
    answer_columns: list[str],
    p_second: float = fixed.SECOND_LABEL_RATIO,
    seed: int = fixed.SEED,
    source: str = fixed.SOURCE_TAGS["distilled"],
) -> DataFrame:
    """Best answer against the second (or, for the remaining draws, the third)."""
    ranked = computed_once(df, "_labels", parse_ranking(F.col("ranking"))).where(F.col("_labels").isNotNull())
    loser = F.when(draws.unit(seed, F.col(id_col)) < p_second, F.get("_labels", F.lit(1))).otherwise(
        F.get("_labels", F.lit(2))
    )
    return ranked.select(
        id_col,
        prompts.with_options(F.col("prompt"), F.col("options")).alias("prompt"),
        _answer_of(F.get("_labels", F.lit(0)), answer_columns).alias("chosen"),
        _answer_of(loser, answer_columns).alias("rejected"),
        F.lit(source).alias("source"),
    )


def from_sign(df: DataFrame, source: str = fixed.SOURCE_TAGS["steering"], keep: tuple[str, ...] = ()) -> DataFrame:
    """Signed preference: below zero the first response wins, otherwise the second."""
    first_wins = F.col("overall_preference") < 0
    return df.select(
        *keep,
        prompts.chat(F.col("context")).alias("prompt"),
        F.when(first_wins, F.col("response1")).otherwise(F.col("response2")).alias("chosen"),
        F.when(first_wins, F.col("response2")).otherwise(F.col("response1")).alias("rejected"),
        F.lit(source).alias("source"),
    )


def in_domains(df: DataFrame, domains: tuple[str, ...] = ("code", "stem")) -> DataFrame:
    return df.where(F.col("domain").isin(*domains))


def dataset(parts: list[DataFrame], id_col: str, seed: int = fixed.SEED) -> DataFrame:
    """Union of pair tables with an exact train / validation split; `id_col` is a unique long."""
    return exact_split(union_by_name(parts), id_col, seed=seed)


def rank_distribution(df: DataFrame, answer_columns: list[str]) -> DataFrame:
    """How often each model is ranked best, middle and worst."""
    model = F.get(
        F.array(*[F.lit(c) for c in answer_columns]), F.ascii("label") - F.lit(65)
    )
    exploded = df.select(F.posexplode(parse_ranking(F.col("ranking"))).alias("place", "label"))
    return exploded.groupBy(model.alias("model"), (F.col("place") + 1).alias("place")).agg(
        F.count(F.lit(1)).alias("n")
    )
