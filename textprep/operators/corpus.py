"""The document corpus: tagged articles and question/answer texts under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textprep import fixed_values as fixed
from textprep.functions.text import Counter, present, strip, token_count
from textprep.operators.sampling import top_n, top_n_per_group
from textprep.plans.barrier import computed_once
from textprep.schemas import require_columns
from textprep.sources.adapters import union_by_name

WIKI_COLUMNS = ["page_title", "section_title", "breadcrumb", "text"]


def tagged(df: DataFrame, columns: list[str] = WIKI_COLUMNS, source: str = fixed.SOURCE_TAGS["wiki"],
           keep: tuple[str, ...] = ()) -> DataFrame:
    """Non-empty cells wrapped in tags of their column name, one per line."""
    require_columns(df, columns)
    parts = [
        F.when(present(F.col(c)), F.concat(F.lit(f"<{c}>"), F.col(c), F.lit(f"</{c}>"))) for c in columns
    ]
    return df.select(*keep, strip(F.concat_ws("\n", *parts)).alias("text"), F.lit(source).alias("source"))


def from_qa(df: DataFrame, default_source: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Question and answer as one text; empty texts are dropped."""
    require_columns(df, ["question", "answer"])
    cell = {c: F.coalesce(F.col(c), F.lit("")) for c in ("question", "answer")}
    text = strip(F.concat(cell["question"], F.lit("\n"), cell["answer"]))
    source = F.col("source") if "source" in df.columns else F.lit(default_source)
    return df.select(*keep, text.alias("text"), source.alias("source")).where(F.col("text") != "")


def with_tokens(df: DataFrame, tok: Counter = token_count) -> DataFrame:
    return computed_once(df, "token_count", tok(F.col("text")))


def limit_tokens(
    df: DataFrame,
    id_col: str,
    max_tokens: int = fixed.MAX_CHUNK_TOKENS,
    max_chunks: int | None = None,
    by: str | None = None,
    tok: Counter = token_count,
) -> DataFrame:
    """Texts of at most `max_tokens`, of them the longest `max_chunks` (per `by` if given)."""
    fitting = with_tokens(df, tok).where(F.col("token_count") <= max_tokens)
    if max_chunks is None:
        return fitting
    if by is None:
        return top_n(fitting, max_chunks, "token_count", id_col)
    return top_n_per_group(fitting, by, max_chunks, [F.desc("token_count"), F.asc(id_col)], id_col)


def build(
    parts: list[DataFrame],
    id_col: str,
    small: bool = True,
    max_chunks: int | None = None,
    max_tokens: int = fixed.MAX_CHUNK_TOKENS,
    tok: Counter = token_count,
) -> DataFrame:
    """Union of the parts; the small version drops long texts (and keeps the longest `max_chunks` of each part, if given), the full one only counts tokens."""
    if small:
        limited = [limit_tokens(p, id_col, max_tokens, max_chunks, tok=tok) for p in parts]
    else:
        limited = [with_tokens(p, tok) for p in parts]
    return union_by_name(limited)


def final_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, "text", "source")


def token_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("token_count").alias("avg_tokens"),
        F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"),
    )


def is_blank(c: Column) -> Column:
    """NULL, whitespace, or the words an exporter writes for a missing value."""
    return F.coalesce(F.lower(strip(c)).isin(fixed.BLANK_WORDS), F.lit(True))


def to_documents(df: DataFrame, id_col: str, text_col: str = "text", exported: bool = False) -> DataFrame:
    """Retrieval documents: text plus a map of every other column as text; blank texts are dropped.

    `exported` is for tables that went through a text export: texts are stripped, and the words an
    exporter writes for a missing value count as blank.
    """
    if exported:
        df = df.withColumn(text_col, strip(F.col(text_col))).where(~is_blank(F.col(text_col)))
    else:
        df = df.where(present(strip(F.col(text_col))))
    entries: list[Column] = []
    for name in df.columns:
        if name != text_col:
            entries += [F.lit(name), F.col(name).cast("string")]
    length = F.length(text_col).cast("string")
    metadata = F.create_map(*entries, F.lit("char_length"), length)
    return df.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.col("source"),
        F.length(text_col).alias("char_length"),
        metadata.alias("metadata"),
    )
