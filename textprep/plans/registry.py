"""Registered queries and the SQL each result is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textprep.fixed_values import UNICODE_WHITESPACE
from textprep.plans.tables import Tables, check_ctes

BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Integers as long and reals as double, so that both engines report the same types."""
    wide = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    return df.select(*[F.col(f"`{c}`").cast(wide[t]).alias(c) if t in wide else F.col(f"`{c}`") for c, t in df.dtypes])


def query(
    name: str,
    sql: str | None = None,
    views: tuple[str, ...] = (),
    steps: dict[str, str] | None = None,
):
    """Register `build(tables) -> DataFrame`; `views` and `steps` become the WITH clause of the check."""

    def register(build: Callable[[Tables], DataFrame]):
        BUILDERS[name] = build
        QUERIES[name] = lambda spark, folder: _plain(build(Tables(spark, folder)))
        if sql is not None:
            ctes = {**check_ctes(views), **(steps or {})}
            with_clause = ",\n".join(f"{cte} AS ({body})" for cte, body in ctes.items())
            CHECKS[name] = f"WITH {with_clause}\n{sql}" if ctes else sql
        return build

    return register


# --- pieces of check SQL --------------------------------------------------------------------------


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = lit(UNICODE_WHITESPACE)
TOKENS = lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\x09-\x0D ]")


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def n_tokens(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {TOKENS})) AS BIGINT)"


def word(seed, *parts: str) -> str:
    """First eight hex digits of the md5 as a number."""
    joined = " || '|' || ".join([lit(str(seed)), *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"CAST('0x' || substr(md5({joined}), 1, 8) AS BIGINT)"


def hash_key(seed, *parts: str) -> str:
    joined = " || '|' || ".join([lit(str(seed)), *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"CAST('0x' || substr(md5({joined}), 1, 15) AS BIGINT)"


def render(template: str, **values: str) -> str:
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [f"coalesce({values[p]}, '')" if i % 2 else lit(p) for i, p in enumerate(pieces)]
    return "(" + " || ".join(parts) + ")"


def lettered(options: str) -> str:
    line = "chr(10) || chr(CAST(64 + i AS INT)) || '. ' || o"
    return f"coalesce(array_to_string(list_transform({options}, lambda o, i: {line}), ''), '')"
