"""Cleaning of generated answers: column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from textprep import fixed_values as fixed
from textprep.functions.text import first_line, lstrip, strip


def _from(c: Column, position: Column) -> Column:
    """The text from a 1-based position to its end."""
    return F.substr(c, position.cast("int"))


def after_think(c: Column) -> Column:
    """Text after the first closing think tag, left-stripped; untouched without a tag."""
    at = F.instr(c, fixed.THINK_END)
    return F.when(at > 0, lstrip(_from(c, at + len(fixed.THINK_END)))).otherwise(c)


def _marker_positions(c: Column, markers: list[str], find) -> Column:
    return F.filter(F.array(*[find(c, m) for m in markers]), lambda p: p > 0)


def _last_instr(c: Column, marker: str) -> Column:
    """1-based position of the last occurrence, 0 if there is none."""
    tail = F.length(F.substring_index(c, marker, -1))
    return F.when(F.instr(c, marker) > 0, F.length(c) - tail - len(marker) + 1).otherwise(0)


def from_first_marker(c: Column, markers: list[str] = fixed.ANSWER_MARKERS) -> Column:
    """Text from the earliest marker on, without end-of-text marks."""
    start = F.array_min(_marker_positions(c, markers, lambda x, m: F.instr(x, m)))
    text = _from(c, F.coalesce(start, F.lit(1)))
    return strip(F.replace(text, F.lit(fixed.END_OF_TEXT), F.lit("")))


def from_last_marker(c: Column, markers: list[str] = fixed.ANSWER_MARKERS) -> Column:
    """Text from the latest-starting marker, then past the first "assistant" in any case."""
    start = F.array_max(_marker_positions(c, markers, _last_instr))
    text = _from(c, F.coalesce(start, F.lit(1)))
    assistant = F.instr(F.lower(text), fixed.ASSISTANT_MARK)
    skipped = _from(text, assistant + len(fixed.ASSISTANT_MARK))
    return strip(F.when(assistant > 0, skipped).otherwise(text))


def without_think(c: Column, marker: str = "answer: ") -> Column:
    """Drop think blocks, then keep what follows the last lower-case answer mark."""
    visible = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    return strip(F.substring_index(visible, marker, -1))


def after_last(
    c: Column,
    prompt: Column,
    marker: str = "Answer:",
    default: str = fixed.NO_CLEAR_ANSWER,
) -> Column:
    """First line after the last marker, or after the echoed prompt when no marker came back."""
    echoed = _from(c, F.length(prompt) + 1)
    tail = F.when(F.instr(c, marker) > 0, F.substring_index(c, marker, -1)).otherwise(echoed)
    line = strip(first_line(strip(tail)))
    return F.when(line == "", F.lit(default)).otherwise(line)
