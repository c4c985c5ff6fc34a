"""Row identity for tables that come without a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_COPIES_PER_TASK = 100_000


def with_row_id(df: DataFrame, key: str | None = None) -> DataFrame:
    """Add `row_id`: the source key as text, or the md5 of the row plus a number among its copies.

    Digests are counted; rows that are alone, usually nearly all, stay where they are. Identical rows are
    counted (partial aggregation first) and expanded again, so a group of copies that makes up a third of the
    table never meets in one sort. Large groups are expanded in pieces that are spread over tasks.
    """
    if key is not None:
        return df.withColumn("row_id", F.col(key).cast("string"))
    digest = F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    keyed = df.withColumn("_digest", digest)
    repeated = keyed.groupBy("_digest").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1").select("_digest")
    alone = keyed.join(repeated, "_digest", "left_anti")
    alone = alone.select(*df.columns, F.concat_ws("-", "_digest", F.lit("1")).alias("row_id"))
    counted = keyed.join(repeated, "_digest", "left_semi").groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    counted = counted.withColumn("_digest", digest)
    few = counted.where(F.col("_copies") <= _COPIES_PER_TASK).withColumn("_piece", F.lit(0).cast("long"))
    last_piece = F.floor((F.col("_copies") - 1) / _COPIES_PER_TASK)
    many = (
        counted.where(F.col("_copies") > _COPIES_PER_TASK)
        .withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), last_piece)))
        .repartition("_digest", "_piece")
    )
    first = F.col("_piece") * _COPIES_PER_TASK + 1
    last = F.least(F.col("_copies"), first + (_COPIES_PER_TASK - 1))
    expanded = few.unionByName(many).withColumn("_copy", F.explode(F.sequence(first, last)))
    row_id = F.concat_ws("-", F.col("_digest"), F.col("_copy").cast("string"))
    return alone.unionByName(expanded.select(*df.columns, row_id.alias("row_id")))
