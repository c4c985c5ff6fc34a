"""File sources and sinks: JSON arrays, templates, CSV, stage tables, splits, results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from textprep.sources import json_splits
from textprep.sources.adapters import union_by_name

# Text cells hold newlines, quotes and commas; nothing is trimmed, "" and NULL are one value.
_CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_json_array(
    spark: SparkSession, path: str, schema: T.StructType | str, split_above: int = json_splits.SPLIT_ABOVE
) -> DataFrame:
    """Files that each hold one JSON array of records; a number in a text field arrives as text.

    A file of more than `split_above` bytes is read in ranges by many tasks, any other by one.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    large = json_splits.large_files(spark, path, split_above)
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    if not large:
        return whole.select(*schema.names)
    records = json_splits.array_records(spark, large).select(F.from_json("text", schema).alias("r")).select("r.*")
    listed = spark.createDataFrame([(p,) for p in large], "large_file string")
    rest = whole.withColumn("large_file", F.col("_metadata.file_path"))
    rest = rest.where(~F.col("large_file").isin(large)) if len(large) <= 1000 else rest.join(listed, "large_file", "left_anti")
    return rest.select(*schema.names).unionByName(records)


def write_json_arrays(
    df: DataFrame, path: str, id_col: str, per_file_rows: int = 10_000, per_file_bytes: int = 32 << 20
) -> None:
    """Write records as JSON arrays, one per file, of about `per_file_rows` records or `per_file_bytes` each.

    Files are filled by the hash of the id, so their size does not depend on how ids are spread.
    """
    record = F.to_json(F.struct(*[c for c in df.columns if c != id_col]), {"ignoreNullFields": "false"})
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(record)).alias("bytes")).first()
    files = max(1, math.ceil(size["rows"] / per_file_rows), math.ceil((size["bytes"] or 0) / per_file_bytes))
    keyed = df.select(record.alias("record"), F.pmod(F.xxhash64(id_col), F.lit(files)).alias("file"))
    arrays = keyed.groupBy("file").agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("record"), ",\n"), F.lit("]")).alias("value")
    )
    arrays.write.partitionBy("file").text(path)


def write_templates(templates: DataFrame, path: str, per_file_rows: int = 10_000) -> None:
    """Write the column `template` as JSON arrays of about `per_file_rows` texts, in order within and across files."""
    files = max(1, math.ceil(templates.count() / per_file_rows))
    ranged = templates.select("template").repartitionByRange(files, "template")
    filed = ranged.withColumn("file", F.format_string("%08d", F.spark_partition_id()))
    arrays = filed.groupBy("file").agg(F.to_json(F.sort_array(F.collect_list("template"))).alias("value"))
    arrays.write.partitionBy("file").text(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of prompt templates as rows (template_id, template), ids in the order of files and within them."""
    items = F.from_json(F.col("value"), "array<string>")
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), items.alias("items"))
    ahead = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)  # a row for each file
    sizes = read.groupBy("file").agg(F.sum(F.size("items")).alias("n"))
    first = sizes.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    exploded = read.select("file", F.posexplode("items").alias("place", "template")).join(F.broadcast(first), "file")
    return exploded.select((F.col("first") + F.col("place")).cast("int").alias("template_id"), "template")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(multiLine="true", **_CSV).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of CSV files, each with a header; `mode="append"` adds files to it."""
    df.write.mode(mode).options(**_CSV).csv(path)


def save_table(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split, so that reading a split prunes to its files."""
    df.write.partitionBy(split).parquet(path)


def write_sets(sets: dict[str, DataFrame], path: str, merged: str = "merged", split: str = "test") -> list[str]:
    """Every set as a table below `path`, all of one split, and their union beside them; returns the names.

    The union is read from the tables just written, so each set is evaluated once.
    """
    for name, rows in sets.items():
        write_splits(rows.withColumn("split", F.lit(split)), f"{path}/{name}")
    spark = next(iter(sets.values())).sparkSession
    written = [spark.read.parquet(f"{path}/{name}") for name in sets]
    write_splits(union_by_name(written), f"{path}/{merged}")
    return [*sets, merged]


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table if split is None else table.where(F.col("split") == split)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
