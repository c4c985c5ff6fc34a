"""Reward functions of the reinforcement stage, as columns registered by name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from textprep.functions.text import first_line, strip

# An option letter, a dot, then at least one character that is not a newline.
OPTION_PATTERN = r"(?d)[ABCDE]\.\s*.+"


def format_reward(completion: Column) -> Column:
    return F.when(completion.rlike(OPTION_PATTERN), F.lit(0.5)).otherwise(F.lit(0.0))


def correctness_reward(completion: Column, final_answer: Column) -> Column:
    """+1 when the stripped first lines agree, else -1."""
    same = strip(first_line(completion)) == strip(first_line(final_answer))
    return F.when(same, F.lit(1.0)).otherwise(F.lit(-1.0))


REWARDS = {
    "correctness": lambda row: correctness_reward(row["completion"], row["final_answer"]),
    "format": lambda row: format_reward(row["completion"]),
}
