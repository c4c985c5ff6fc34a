"""Ordering, first-n, sampling and exact splits without a one-partition window.

The n-th row of an order is found by narrowing histograms; the rows before it are then a plain
filter, so the payload is neither sorted nor shuffled.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textprep import fixed_values as fixed
from textprep.functions import draws
from textprep.functions.text import Counter, token_count
from textprep.plans.barrier import computed_once
from textprep.session import shared_path

_BINS = 4096
_DIRECT_ROWS = 10_000
_ROWS_PER_RANGE = 1_000_000
_RANGES = 1 << 16  # of the seeded shuffle
_MAX_SALTS = 256


def _extent(df: DataFrame, key: str) -> tuple[int, int, int]:
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("low"), F.max(key).alias("high")).first()
    return row["rows"], row["low"], row["high"]


def _nth(df: DataFrame, n: int) -> tuple[int, list[int]]:
    """(rows seen, values of the last of the first n rows); the whole input is at most `_DIRECT_ROWS`."""
    first = df.orderBy(*df.columns).limit(n)
    row = first.agg(F.count(F.lit(1)).alias("rows"), F.max(F.struct(*df.columns)).alias("last")).first()
    return row["rows"], list(row["last"] or [])


def _narrow(slim: DataFrame, n: int) -> list[int] | None:
    """Key by key, a pass counts at most `_BINS` bins on the executors and keeps the bin of row n.

    Once at most `_DIRECT_ROWS` rows are in question they are ordered directly, so no task ever gets
    the first rows of all the others.
    """
    names, cut, rest = slim.columns, [], slim
    rows, low, high = _extent(rest, names[0])
    if rows <= n:
        return None
    for place, name in enumerate(names):
        if place > 0:
            rows, low, high = _extent(rest, name)
        while low < high and rows > _DIRECT_ROWS:
            width = math.ceil((high - low + 1) / _BINS)
            offset = F.col(name) - F.lit(low)
            bins = (
                rest.where(F.col(name).between(low, high))
                .groupBy(((offset - F.pmod(offset, F.lit(width))) / width).cast("long").alias("bin"))
                .count()
                .collect()
            )
            for bin_, count in sorted((row["bin"], row["count"]) for row in bins):
                if n <= count:
                    low, high, rows = low + bin_ * width, min(high, low + bin_ * width + width - 1), count
                    break
                n -= count
        rest = rest.where(F.col(name).between(low, high))
        if rows <= _DIRECT_ROWS:
            return cut + _nth(rest.select(*names[place:]), n)[1]
        cut.append(low)
    return cut


def before_cut(df: DataFrame, n: int, keys: dict[str, Column]) -> Column | None:
    """Predicate that holds for the first `n` rows in the order of `keys` (None: all rows).

    `keys` are non-null integer columns, most significant first; together they identify a row.
    Only the keys are read to find the cut.  (A sort with a limit inside a larger plan would range
    partition and sort the whole payload.)
    """
    if n <= 0:
        return F.lit(False)
    slim = df.select(*[c.cast("long").alias(name) for name, c in keys.items()])
    slim = slim.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cut = _narrow(slim, n)
    finally:
        slim.unpersist()
    if cut is None:
        return None
    predicate = F.lit(True)
    for value, key in reversed(list(zip(cut, keys.values()))):
        predicate = (key.cast("long") < value) | ((key.cast("long") == value) & predicate)
    return predicate


def text_keys(df: DataFrame, column: str, descending: bool = False) -> dict[str, Column]:
    """Integer keys that order like the bytes of a short text column (names, codes): seven bytes each.

    There are as many as the longest value needs, so that no part of a value is left out.  NULL and
    "" are one value, the first; values must not hold NUL characters.
    """
    longest = df.agg(F.max(F.octet_length(column))).first()[0] or 1
    data = F.coalesce(F.col(column), F.lit("")).cast("binary")
    keys = {}
    for n in range(math.ceil(longest / 7)):
        digits = F.rpad(F.hex(F.substring(data, 1 + 7 * n, 7)), 14, "0")
        value = F.conv(digits, 16, 10).cast("long")
        keys[f"{column}_{n}"] = -value if descending else value
    return keys


def _first(df: DataFrame, n: int, keys: dict[str, Column]) -> DataFrame:
    predicate = before_cut(df, n, keys)
    return df if predicate is None else df.where(predicate)


def _shuffle_keys(df: DataFrame, seed: int, id_col: str) -> dict[str, Column]:
    """Hash first, then the id; a text id is replaced by a second hash, independent of the first."""
    is_text = dict(df.dtypes)[id_col] == "string"
    last = draws.hash_key(f"{seed}-id", F.col(id_col)) if is_text else F.col(id_col)
    return {"hash": draws.hash_key(seed, F.col(id_col)), "id": last}


def first_n(df: DataFrame, n: int, id_col: str) -> DataFrame:
    """The first n rows by id (an integer column)."""
    return _first(df, n, {"id": F.col(id_col)})


def sample_n(df: DataFrame, n: int, id_col: str, seed: int = fixed.SEED) -> DataFrame:
    """The first n rows of the seeded shuffle."""
    return _first(df, n, _shuffle_keys(df, seed, id_col))


def top_n(df: DataFrame, n: int, measure: str, id_col: str) -> DataFrame:
    """The n rows with the largest integer `measure`; ties go to the smaller id."""
    return _first(df, n, {"measure": -F.col(measure), "id": F.col(id_col)})


def exact_split(
    df: DataFrame,
    id_col: str,
    fraction: float = fixed.VALIDATION_FRACTION,
    seed: int = fixed.SEED,
    names: tuple[str, str] = ("train", "validation"),
) -> DataFrame:
    """Add `split`: exactly ceil(fraction * rows) rows, first in the seeded shuffle, are held out."""
    held_out = math.ceil(df.count() * fraction)
    predicate = before_cut(df, held_out, _shuffle_keys(df, seed, id_col))
    inside = F.lit(True) if predicate is None else predicate
    return df.withColumn("split", F.when(inside, F.lit(names[1])).otherwise(F.lit(names[0])))


def _running(df: DataFrame, bucket: list[str], order: list, sums: dict[str, str]) -> DataFrame:
    """Add `position` (1-based) and running sums over the whole order.

    The last column of `bucket` grows with the order and splits it into ranges; columns before it
    start a count of their own.  Each range is numbered by itself and shifted by the totals of the
    ranges before it: one row per bucket, a few thousand at most.
    """
    totals = df.groupBy(*bucket).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum_{out}") for out, c in sums.items()]
    )
    ahead = W.partitionBy(*bucket[:-1]).orderBy(bucket[-1]).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *bucket,
        F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_rows_before"),
        *[
            F.coalesce(F.sum(f"_sum_{out}").over(ahead), F.lit(0)).alias(f"_before_{out}")
            for out in sums
        ],
    )
    inside = W.partitionBy(*bucket).orderBy(*order)
    so_far = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    # One count: at most a few thousand rows, so broadcast.  A count per group: as many times that as
    # there are groups, so Spark decides; the join then shares its shuffle with the window.
    out = df.join(F.broadcast(offsets) if len(bucket) == 1 else offsets, bucket)
    columns = [(F.col("_rows_before") + F.row_number().over(inside)).alias("position")]
    for name, c in sums.items():
        columns.append((F.col(f"_before_{name}") + F.sum(c).over(so_far)).alias(name))
    return out.select(*[c for c in df.columns if c != bucket[-1]], *columns)


def shuffle_positions(df: DataFrame, id_col: str, seed: int = fixed.SEED, within: str | None = None) -> DataFrame:
    """Add `position`, the place of each row in the seeded shuffle (of its `within` group, e.g. the split).

    Buckets are the leading bits of the hash, hence even whatever the ids look like: `_RANGES` of them, so that
    a hundred billion rows make some million a bucket, and the rows need not be counted first.
    """
    keyed = df.withColumn("_hash", draws.hash_key(seed, F.col(id_col)))
    keyed = keyed.withColumn("_bucket", F.shiftright("_hash", draws.HASH_BITS - int(math.log2(_RANGES))))
    groups = [] if within is None else [within]
    return _running(keyed, [*groups, "_bucket"], ["_hash", id_col], {}).drop("_hash")


def running_totals(df: DataFrame, id_col: str, sums: dict[str, str], buckets: int | None = None) -> DataFrame:
    """Add `position` and running sums in the order of a unique numeric id; ranges come from its approximate quantiles.

    Only `buckets` quantiles (1,024, or one for a million rows if that is more) reach the driver, and
    any choice of them gives the same result. Ids and the columns to be summed are handed off once: a costly
    one, e.g. a token count, is evaluated once, and other columns are not sorted but joined to the sums.
    """
    path = shared_path(df.sparkSession, "running-keys")
    slim = df.select(id_col, *sorted(set(sums.values())))
    slim.write.parquet(path)
    slim = df.sparkSession.read.schema(slim.schema).parquet(path)
    buckets = buckets or max(1024, math.ceil(slim.count() / _ROWS_PER_RANGE))
    points = slim.approxQuantile(id_col, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))
    splits = [-math.inf, *sorted(set(points)), math.inf]
    if len(splits) > 2:
        keyed = slim.withColumn("_id", F.col(id_col).cast("double"))
        keyed = Bucketizer(splits=splits, inputCol="_id", outputCol="_bucket").transform(keyed).drop("_id")
    else:  # no rows, or one id: one range
        keyed = slim.withColumn("_bucket", F.lit(0.0))
    summed = _running(keyed, ["_bucket"], [id_col], sums)
    rest = [c for c in df.columns if c not in slim.columns]
    return df.select(id_col, *rest).join(summed, id_col).select(*df.columns, "position", *sums)


def in_batches(df: DataFrame, size: int, position: str = "position", name: str = "batch_id") -> DataFrame:
    """Number batches of `size` rows along a position column."""
    return df.withColumn(name, F.floor((F.col(position) - 1) / size).cast("long"))


def top_n_per_group(df: DataFrame, group: str, n: int, order: list, id_col: str, salts: int | None = None) -> DataFrame:
    """The first n rows of every group; `id_col` is unique.

    Two rounds: first per (group, salt), where Spark also prunes to n rows before the shuffle, then
    per group over at most n * salts survivors.  A group with a third of all rows is thus spread
    over `salts` tasks, and no row that belongs to the answer can get lost.  Only the id and what the order
    reads go through the shuffles; the rows themselves are picked by the ids that have won.
    """
    salts = salts or min(_MAX_SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(salts)))
    first = F.row_number().over(W.partitionBy(group, "_salt").orderBy(*order))
    survivors = salted.withColumn("_rank", first).where(F.col("_rank") <= n)
    second = F.row_number().over(W.partitionBy(group).orderBy(*order))
    winners = survivors.withColumn("_rank", second).where(F.col("_rank") <= n).select(F.col(id_col).alias("_winner"))
    return df.join(winners, df[id_col] == F.col("_winner"), "left_semi")


def within_pair_budget(df: DataFrame, first: str, second: str, max_length: int, tok: Counter = token_count) -> DataFrame:
    """Rows whose two token counts sum to strictly less than `max_length`."""
    counted = computed_once(df, "_tokens", tok(F.col(first)) + tok(F.col(second)))
    return counted.where(F.col("_tokens") < max_length).drop("_tokens")


def sft_view(df: DataFrame, tok: Counter = token_count, max_length: int = 200) -> DataFrame:
    """Trainer input of the supervised stage."""
    kept = within_pair_budget(df, "question", "answer", max_length, tok)
    return kept.withColumnsRenamed({"question": "prompt", "answer": "completion"})


def rl_view(
    df: DataFrame, id_col: str, tok: Counter = token_count, max_length: int = 200, seed: int = fixed.SEED
) -> DataFrame:
    """Trainer input of the reinforcement stage: shuffled position, prompt, final answer."""
    renamed = df.select(id_col, F.col("question").alias("prompt"), F.col("answer").alias("final_answer"))
    kept = within_pair_budget(renamed, "prompt", "final_answer", max_length, tok)
    return shuffle_positions(kept, id_col, seed)
