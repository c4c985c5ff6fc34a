"""Rename-only adapters: which column of a source becomes which canonical column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from textprep import fixed_values as fixed
from textprep.functions import draws
from textprep.functions.text import present
from textprep.operators.sampling import first_n
from textprep.schemas import require_columns

# canonical column -> source column
GSM8K = {"question": "question", "answer": "answer"}
MATH_FORUM = {"question": "Q", "answer": "A"}
MATH_REASONING = {"question": "problem", "answer": "generated_solution"}
CODE_PAIRS = {"prompt": "input", "chosen": "accepted", "rejected": "rejected"}
PYTHON_PAIRS = {"prompt": "prompt", "chosen": "chosen", "rejected": "rejected"}
MATH_PAIRS = {"prompt": "question", "chosen": "chosen", "rejected": "rejected"}
REWARD_BENCH = PYTHON_PAIRS


def adapt(df: DataFrame, mapping: dict[str, str], source: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project to the canonical columns, tagged with the source."""
    require_columns(df, mapping.values())
    renamed = [F.col(old).alias(new) for new, old in mapping.items()]
    return df.select(*keep, *renamed, F.lit(source).alias("source"))


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    """Bag union of tables with the same columns in any order."""
    return reduce(DataFrame.unionByName, parts)


def distill_pool(
    mixed: DataFrame,
    science: DataFrame,
    math: DataFrame,
    mixed_source: str,
    seed: int = fixed.SEED,
    math_rows: int | None = None,
) -> DataFrame:
    """The question pool: mixed questions, four-option science questions, math prompts (the first `math_rows` if given).

    Each input carries a `row_id`; the output key is that id prefixed by the part it came from.
    """

    def row(part: str, prompt: Column, options: Column, answer: Column, source: str) -> list[Column]:
        return [
            F.concat(F.lit(f"{part}:"), F.col("row_id").cast("string")).alias("row_id"),
            prompt.alias("prompt"),
            options.alias("options"),
            answer.alias("answer"),
            F.lit(source).alias("source"),
        ]

    no_options = F.array().cast("array<string>")
    choices = F.array("correct_answer", "distractor1", "distractor2", "distractor3")
    order = draws.shuffled(seed, F.col("row_id"), choices)
    science = science.withColumn("_choices", F.transform(order, lambda s: s["item"]))
    mixed_part = mixed.select(
        *row(
            "mixed",
            F.col("question_body"),
            F.coalesce(F.col("question_options"), no_options),
            F.coalesce(F.col("question_answer"), F.lit("")),
            mixed_source,
        )
    )
    science_part = science.select(
        *row(
            "science",
            F.col("question"),
            F.col("_choices"),
            F.col("correct_answer"),
            fixed.SOURCE_TAGS["pool_sciq"],
        )
    )
    math = math if math_rows is None else first_n(math, math_rows, "row_id")
    math_part = math.select(
        *row("math", F.col("prompt"), F.array(F.lit("")), F.lit(""), fixed.SOURCE_TAGS["pool_math"])
    )
    return union_by_name([mixed_part, science_part, math_part])


def drop_source(df: DataFrame, source: str) -> DataFrame:
    """Every row whose source is not `source`; rows without a source stay."""
    return df.where(~F.col("source").eqNullSafe(source))


def answered(df: DataFrame) -> DataFrame:
    return df.where(present(F.col("question")) & present(F.col("answer")))
