"""Column expressions for text: stripping, token counts, letters, rendering.

All of them stay in the JVM.  `counter` is the one plug point for an external tokenizer.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

from textprep.fixed_values import UNICODE_WHITESPACE

# A token is a run of ASCII letters and digits, or one other character that is not ASCII whitespace.
# (The plain second branch matches twice as fast as a negated class of the same meaning.)
TOKEN_PATTERN = r"[A-Za-z0-9]+|\S"

Counter = Callable[[Column], Column]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(UNICODE_WHITESPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(UNICODE_WHITESPACE))


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def present(c: Column) -> Column:
    """True unless the text is NULL or empty."""
    return F.coalesce(c, F.lit("")) != ""


def letter(index: Column) -> Column:
    """0 -> A, 1 -> B, ..."""
    return F.char(index.cast("int") + F.lit(65))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), F.lit(0))


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TOKEN_PATTERN))


def counter(encode: Callable[[str], list]) -> Counter:
    """Wrap an external `encode(text) -> token list` as an Arrow-batched count column.

    A text the tokenizer rejects gets NULL, which every token limit excludes.
    """

    def count_one(value):
        if value is None:
            return None
        try:
            return len(encode(value))
        except Exception:  # noqa: BLE001 - any tokenizer failure excludes the row
            return None

    @F.pandas_udf("int")
    def count(batch: pd.Series) -> pd.Series:
        return batch.map(count_one).astype("Int32")

    return count


def truncate(c: Column, max_tokens: int) -> Column:
    """struct(text, token_count): the text itself if it fits, else its first tokens."""
    parts = tokens(c)
    count = F.size(parts)
    cut = F.array_join(F.slice(parts, 1, max_tokens), " ")
    return F.struct(
        F.when(count <= max_tokens, c).otherwise(cut).alias("text"),
        F.least(count, F.lit(max_tokens)).alias("token_count"),
    )


def token_ids(c: Column, vocabulary: int = 32_000) -> Column:
    """Token ids from a hashed vocabulary (the stand-in for a trained one)."""
    return F.transform(
        tokens(c),
        lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % vocabulary).cast("int"),
    )


def quoted_list(items: Column) -> Column:
    """`['a', 'b']` for an array of strings; double quotes where a text holds an apostrophe."""

    def quote(item: Column) -> Column:
        text = item
        for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            text = F.replace(text, F.lit(raw), F.lit(shown))
        plain = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'"))
        double = F.concat(F.lit('"'), text, F.lit('"'))
        return F.when(item.contains("'") & ~item.contains('"'), double).otherwise(plain)

    return F.concat(F.lit("["), F.array_join(F.transform(items, quote), ", "), F.lit("]"))


def render(template: str, **values: Column) -> Column:
    """Fill `{name}` places of a fixed template; one concat, so substituted texts are never rescanned."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [
        F.coalesce(values[piece].cast("string"), F.lit("")) if i % 2 else F.lit(piece)
        for i, piece in enumerate(pieces)
    ]
    return F.concat(*parts)


def lettered_lines(options: Column) -> Column:
    """Each option on its own line as `A. text`, with a leading newline."""
    return F.array_join(
        F.transform(options, lambda o, i: F.concat(F.lit("\n"), letter(i), F.lit(". "), o)), ""
    )
