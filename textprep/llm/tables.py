"""Hand-off tables in the shared folder, and broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textprep.session import shared_path

# Rows of at most three numbers: a broadcast of this many stays below about 64 MB on every executor.
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20

_MADE = "_handoff_folder"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, and safe from the loss of executors."""
    path = shared_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.__dict__[_MADE] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove hand-offs that nothing reads any more, since what follows from them is written.

    Only what `written` returned itself can be removed; other DataFrames are left alone. Spark frees the shuffle files of
    finished jobs when the driver collects its garbage, which is asked for here, lest they pile up on the executors.
    """
    for table in tables:
        made = table.__dict__.pop(_MADE, None)
        if made is not None:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(made)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def small_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """`df` (narrow, already written) hinted for broadcast if it is small; otherwise Spark shuffles.

    Small are at most `max_rows` rows whose texts and bytes together have at most MAX_BROADCAST_BYTES.
    """
    lengths = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = F.coalesce(F.sum(sum(lengths, F.lit(0))), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"), size.alias("bytes")).first()
    return F.broadcast(df) if row["n"] <= max_rows and row["bytes"] <= MAX_BROADCAST_BYTES else df


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node of `edges` (a, b): the smallest node that can be reached.

    Alternating large and small stars; each step joins on node ids only and is written to the shared folder.
    A hub with very many edges is one key of a sort-merge join, which adaptive execution splits.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = written(edges, f"{name}-edges")

    def stars(df: DataFrame) -> bool:
        """Whether every node has one edge, to a node that has none: its component."""
        ends = df.select(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("led"))
        ends = ends.union(df.select("b", F.lit(0), F.lit(1))).groupBy("n").agg(F.sum("out").alias("out"), F.max("led").alias("led"))
        return ends.where("out > 1 OR (out = 1 AND led = 1)").isEmpty()

    while not stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours go to the least of the neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: smaller neighbours, and the node itself, go to the least of them
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        earlier, edges = edges, written(
            small.union(small_least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), f"{name}-edges"
        )
        discard(earlier)
    found = written(edges.select(F.col("a").alias("node"), F.col("b").alias("component")), name)
    discard(edges)
    return found
