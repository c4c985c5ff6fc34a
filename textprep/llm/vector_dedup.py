"""Near-duplicate vectors of one label by tiles of principal components.

Vectors are scaled to unit length and turned onto their principal axes, strongest first. Within a label they lie in
blocks sorted by the leading coordinate. Two blocks meet only if the boxes around their leading coordinates are near
enough. A pair of blocks is compared in tiles: the leading components' products are summed first, the rest is
bounded by the product of the suffix norms, and a tile ends as soon as no pair in it can reach the threshold.
Pairs that are left are computed exactly, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textprep.llm.tables import components, small_broadcast, written
from textprep.llm.vectors import matrix

THRESHOLD = 0.98
BLOCK_BYTES = 32 << 20  # double components of one block
LEAST_BLOCK = 1024  # rows; smaller blocks would cost more to send around than to compare
BLOCKS_WANTED = 64  # of a table that is too small to fill BLOCK_BYTES
TILE = 1024
MOST_TASKS = 20_000
AXES = 8  # leading coordinates of a block's box, and components added between two looks at the bounds
FEW = 0.02  # share of a tile's pairs that is computed exactly instead of going on
_ROUNDING = 1e-9


def _unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length, by their largest component first, so that no square overflows or vanishes."""
    scaled = values / np.abs(values).max(axis=1, initial=0.0, keepdims=True).clip(1e-320)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _axes(classes: DataFrame) -> np.ndarray:
    """Principal axes of all unit vectors, strongest first, as columns; their sums of products reach the driver."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, 0))
        for batch in batches:
            values, _ = matrix(batch.column(0))
            if len(values):
                unit = _unit(values)
                grown = max(unit.shape[1], len(total))
                total = np.pad(total, ((0, grown - len(total)), (0, grown - len(total))))
                total[: unit.shape[1], : unit.shape[1]] += unit.T @ unit
        row, column = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int32()), pa.array(column, pa.int32()), pa.array(total[row, column])], ["i", "j", "v"]
        )

    parts = classes.select("embedding").mapInArrow(products, "i int, j int, v double")
    table = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    if not table.num_rows:
        return np.zeros((0, 0))
    i, j, v = (table[c].to_numpy() for c in ("i", "j", "v"))
    whole = np.zeros((int(j.max()) + 1,) * 2)
    whole[i, j] = v
    whole[j, i] = v
    return np.linalg.eigh(whole)[1][:, ::-1]


def _led(axes: np.ndarray):
    """Adds the first coordinate of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values, _ = matrix(batch.column("embedding"), len(axes))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(_unit(values) @ axes[:, 0])], [*batch.schema.names, "lead"]
                )

    return run


def _in_blocks(axes: np.ndarray, block_rows: int):
    """Numbers the blocks of a sorted partition: a label's rows there, in pieces of at most `block_rows`.

    The number holds the partition's, so it names a block of the table. Each row carries its leading coordinates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, piece, filled, before = TaskContext.get().partitionId() << 32, -1, 0, None
        for batch in batches:
            labels = batch.column("label").to_pylist()
            blocks = np.empty(len(labels), np.int64)
            for r, label in enumerate(labels):
                if label != before or filled == block_rows:
                    before, filled, piece = label, 0, piece + 1
                filled += 1
                blocks[r] = base + piece
            values, _ = matrix(batch.column("embedding"), len(axes))
            lead = _unit(values) @ axes[:, :AXES]
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(labels) + 1) * lead.shape[1], pa.int32()), pa.array(lead.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks), lists], [*batch.schema.names, "block", "leads"])

    return run


def _tile(x: dict, y: dict, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of x, row of y) of a tile's pairs whose cosine reaches the limit."""
    width = x["turned"].shape[1]
    partial, end = np.zeros((len(x["unit"]), len(y["unit"]))), 0
    while end < width:
        start, end = end, min(width, end + AXES)
        partial += x["turned"][:, start:end] @ y["turned"][:, start:end].T
        alive = partial + x["suffix"][:, end][:, None] * y["suffix"][:, end][None, :] >= limit - _ROUNDING
        n = int(np.count_nonzero(alive))
        if n <= FEW * alive.size:
            break
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.nonzero(alive)
    close = np.empty(len(i), bool)
    for first in range(0, len(i), 1 << 16):
        part = slice(first, first + (1 << 16))
        close[part] = np.einsum("ij,ij->i", x["unit"][i[part]], y["unit"][j[part]]) >= limit
    return i[close], j[close]


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row that links reach from each of `n` rows: labels sink along links and jump to their label's label."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        np.minimum.at(root, before[left], low)
        np.minimum.at(root, before[right], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    return root


def _compared(axes: np.ndarray, limit: float):
    """A pair of blocks: for every linked row its links there, weighted by copies, and the first row that links reach."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        values, _ = matrix(group["embedding"], len(axes))
        node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        side = group["side"].to_numpy()
        unit = _unit(values)
        turned = unit @ axes
        squares = np.cumsum(turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        suffix = np.sqrt(np.hstack([squares, np.zeros((len(unit), 1))]))
        sides = [np.flatnonzero(side == s) for s in (0, 1)]
        # neighbours on the leading axis lie in one tile, so that most tiles end early
        sides = [s[np.argsort(turned[s, 0], kind="stable")] for s in sides]
        same = not len(sides[1])
        first, second = sides[0], sides[0] if same else sides[1]

        def piece(rows: np.ndarray) -> dict:
            return {"unit": unit[rows], "turned": turned[rows], "suffix": suffix[rows]}

        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        for a in range(0, len(first), TILE):
            x_rows = first[a : a + TILE]
            x = piece(x_rows)
            for b in range(a if same else 0, len(second), TILE):
                y_rows = second[b : b + TILE]
                i, j = _tile(x, x if same and a == b else piece(y_rows), limit)
                if same and a == b:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    i, j = x_rows[i], y_rows[j]
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    root = _roots(len(node), np.concatenate([np.arange(len(node)), i]), np.concatenate([root, j]))
        linked = np.flatnonzero(links)
        return pa.table(
            {
                "node": pa.array(node[linked], pa.int64()),
                "links": pa.array(links[linked], pa.int64()),
                "root": pa.array(node[root[linked]], pa.int64()),
            }
        )

    return run


def _near(one: str, other: str, limit: float):
    """Whether the boxes (low, high) of two blocks are near enough to hold a pair of unit vectors of that cosine."""
    gap = F.zip_with(f"{one}.low", f"{other}.high", lambda low, high: F.greatest(low - high, F.lit(0.0)))
    back = F.zip_with(f"{other}.low", f"{one}.high", lambda low, high: F.greatest(low - high, F.lit(0.0)))
    square = F.aggregate(F.zip_with(gap, back, lambda x, y: (x + y) * (x + y)), F.lit(0.0), lambda s, x: s + x)
    return square <= F.lit(2 - 2 * limit + _ROUNDING)


def _links(classes: DataFrame, threshold: float, block_rows: int | None) -> DataFrame:
    """(node, links, root) of every pair of blocks in which a class has links."""
    axes = _axes(classes)
    rows = classes.count()
    most = max(1, BLOCK_BYTES // (8 * max(1, len(axes))))
    block_rows = block_rows or min(most, max(LEAST_BLOCK, math.ceil(rows / BLOCKS_WANTED)))
    slim = classes.select("node", "copies", "label", "embedding")
    kept = f"node bigint, copies bigint, label string, embedding {slim.schema['embedding'].dataType.simpleString()}"
    led = slim.mapInArrow(_led(axes), f"{kept}, lead double")
    ranged = led.repartitionByRange(max(1, math.ceil(rows / block_rows)), "label", "lead", "node")
    ranged = ranged.sortWithinPartitions("label", "lead", "node")
    placed = ranged.mapInArrow(_in_blocks(axes, block_rows), f"{kept}, lead double, block bigint, leads array<double>")
    placed = written(placed.drop("lead"), "tile-blocks")
    boxes = placed.select("label", "block", F.posexplode("leads").alias("axis", "x"))
    boxes = boxes.groupBy("label", "block", "axis").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    ordered = F.sort_array(F.collect_list(F.struct("axis", "low", "high")))
    boxes = boxes.groupBy("label", "block").agg(ordered.alias("box"))  # AXES entries
    boxes = boxes.select("label", "block", F.struct(F.col("box.low").alias("low"), F.col("box.high").alias("high")).alias("box"))
    boxes = written(boxes, "tile-boxes")
    one = boxes.select("label", F.col("block").alias("a"), F.col("box").alias("box_a"))
    other = boxes.select("label", F.col("block").alias("b"), F.col("box").alias("box_b"))
    pairs = one.join(other, "label").where((F.col("a") <= F.col("b")) & _near("box_a", "box_b", threshold))
    pairs = written(pairs.select("a", "b"), "tile-pairs")
    ends = pairs.select(F.col("a").alias("block"), "a", "b", F.lit(0).alias("side"))
    ends = ends.union(pairs.where("a < b").select(F.col("b").alias("block"), "a", "b", F.lit(1).alias("side")))
    ends = written(ends, "tile-ends")
    sent = placed.select("block", "node", "copies", "embedding").join(small_broadcast(ends), "block")
    # a number of its own, so that pairs of blocks, dear to compare, are not packed into few tasks by their bytes
    sent = sent.repartition(min(MOST_TASKS, max(1, pairs.count())), "a", "b")
    found = sent.groupBy("a", "b").applyInArrow(_compared(axes, threshold), "node bigint, links bigint, root bigint")
    return written(found, "tile-links")


def vector_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    `vectors` has vec_id, label and embedding; other columns are not read. Rows of one label are linked if the cosine of
    their vectors, in double precision, is at least `threshold`; n_links counts the other rows linked directly,
    component_id is the smallest vec_id that links reach. A row links with nothing if its label, vector or vec_id
    is null, or its vector is zero, empty or holds a null or non-finite component; it is its own component (none
    without vec_id, and kept). Shorter vectors count as filled up with zeros. Rows that repeat a vec_id are vectors of their own.
    Equal vectors of a label are one class that is compared once and counted by its rows, so that a label may
    hold most rows and a class a third of them. An empty table gives an empty result.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast(kind).alias("embedding"),
    )
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    directed = F.exists("embedding", lambda x: x != 0) & ~bad
    usable = F.coalesce(directed & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.lit(False))
    rows = rows.withColumn("usable", usable)
    key = [F.xxhash64(F.lit(n), "label", "embedding").alias(f"set_{n}") for n in (1, 2)]
    keyed = rows.where("usable").select("vec_id", "label", "embedding", *key)
    classes = keyed.groupBy("set_1", "set_2").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("label", "embedding")).alias("v")
    )
    classes = classes.select("set_1", "set_2", "least", "copies", "v.label", "v.embedding")
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "tile-classes")
    links = _links(classes, threshold, block_rows)
    parts = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), "tile-components")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    slim = classes.select("node", "set_1", "set_2", "least", "copies")
    of_class = slim.join(counts, "node", "left").join(parts, "node", "left")
    of_class = of_class.withColumn("part", F.coalesce("component", "node")).where("copies > 1 OR links IS NOT NULL")
    of_class = written(of_class.select("set_1", "set_2", "least", "copies", "links", "part"), "tile-found")
    least = of_class.groupBy("part").agg(F.min("least").alias("component_id"))
    found = of_class.join(least, "part").select(
        "set_1", "set_2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    found = written(found, "tile-verdicts")
    marks = [F.when(F.col("usable"), F.xxhash64(F.lit(n), "label", "embedding")).alias(f"set_{n}") for n in (1, 2)]
    judged = rows.select("vec_id", *marks).join(small_broadcast(found), ["set_1", "set_2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return judged.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
