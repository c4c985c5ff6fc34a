"""The trie of conversation prefixes, by Spark SQL's ROLLUP over positional columns of turn ids.

A conversation is laid out in blocks of WIDTH positional columns; a block's row carries the key of the node in which the
block before it ended. One GROUP BY key, ROLLUP(t1, ..., tWIDTH) counts all prefixes of all blocks together, and
grouping_id tells how many of the columns a row has, hence its depth. A second ROLLUP, over the nodes, sums the
subtrees inside blocks; totals of later blocks reach the earlier ones in as many steps as the logarithm of the blocks.

A node is named by 128 bits: the exclusive or, over its blocks, of a hash of the block's number and turn ids. So the key of a
block follows from the blocks before it by aggregation, and every parent's name from its child's columns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textprep.llm.tables import small_broadcast, written

WIDTH = 8  # positional columns of a block
SEGMENT = 1024  # blocks whose keys are summed in one window
ROWS_PER_RANGE = 1_000_000
PIECE_BYTES = 1 << 20  # of the ids of conversations that end in one node
_COLUMNS = [f"t{n}" for n in range(1, WIDTH + 1)]


def _ranges(df: DataFrame) -> int:
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(df.count() / ROWS_PER_RANGE))


def turn_id() -> Column:
    """20 bytes: md5 of role and text, and the code points of the text. Null role or text counts as empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return F.concat(digest, F.unhex(F.lpad(F.hex(F.length(text)), 8, "0")))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the rows of each conversation in a sorted partition."""
    from pyspark import TaskContext

    part, before, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        starts = np.flatnonzero(np.concatenate([[conv[0] != before], conv[1:] != conv[:-1]]))
        first = np.zeros(len(conv), np.int64)
        first[starts] = starts
        nth = np.arange(len(conv)) - np.maximum.accumulate(first) + 1
        nth[: starts[0] if len(starts) else len(conv)] += seen
        before, seen = conv[-1], int(nth[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(np.full(len(conv), part), pa.int32()), pa.array(nth), batch.column("id")],
            ["conv_id", "part", "nth", "id"],
        )


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, place, id), (conversations: conv_id, n_turns).

    Places start at 1, in the order of `turn` (null first); equal turns go by their id. Rows are sorted in ranges,
    and a conversation that several ranges share is counted on from one to the next, so none need fit a task.
    Rows without conv_id belong to no conversation.
    """
    rows = conversations.where(F.col("conv_id").isNotNull())
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", turn_id().alias("id"))
    order = ["conv_id", "turn", "id"]
    ranged = rows.repartitionByRange(_ranges(rows), *order).sortWithinPartitions(*order).select("conv_id", "id")
    turns = written(ranged.mapInArrow(_numbered, "conv_id bigint, part int, nth bigint, id binary"), "trie-turns")
    parts = turns.groupBy("conv_id", "part").agg(F.max("nth").alias("n"))
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.count(F.lit(1)).alias("parts"))
    convs = written(convs, "trie-conversations")
    shared = convs.where("parts > 1").select("conv_id")  # two at most for each range
    ahead = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shift = parts.join(F.broadcast(shared), "conv_id").select("conv_id", "part", F.sum("n").over(ahead).alias("shift"))
    shift = written(shift.where("shift IS NOT NULL"), "trie-shifts")
    turns = turns.join(F.broadcast(shift), ["conv_id", "part"], "left")
    place = (F.col("nth") + F.coalesce("shift", F.lit(0))).alias("place")
    return turns.select("conv_id", place, "id"), convs.select("conv_id", "n_turns")


def with_shared_heads(
    turns: DataFrame, convs: DataFrame, head_of: Column, n_head: Column, most: int
) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first `n_head` turns are those of the conversation `head_of`, and then their own after as many.

    Both columns are functions of conv_id; `n_head` is at most `most`. A head that is shorter is taken whole, one that is
    absent is empty.
    """
    named = turns.withColumn("head_of", head_of)
    heads = named.where((F.col("conv_id") == F.col("head_of")) & (F.col("place") <= most)).groupBy("head_of")
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("head"))  # at most `most` turns
    heads = written(heads.select("head_of", F.col("head.id").alias("head")), "trie-heads")
    given = small_broadcast(heads, 100_000)
    taken = F.slice(F.coalesce("head", F.expr("cast(array() as array<binary>)")), F.lit(1), F.col("n_head"))
    own = named.withColumn("n_head", n_head.cast("int")).where("place > n_head").join(given, "head_of", "left")
    own = own.select("conv_id", (F.col("place") - F.col("n_head") + F.size(taken)).alias("place"), "id")
    asked = convs.withColumn("head_of", head_of).withColumn("n_head", n_head.cast("int")).join(given, "head_of", "left")
    asked = asked.withColumn("taken", taken)
    first = asked.select("conv_id", F.posexplode("taken").alias("at", "id"))
    first = first.select("conv_id", (F.col("at") + 1).cast("bigint").alias("place"), "id")
    left = F.greatest(F.col("n_turns") - F.col("n_head"), F.lit(0))
    return first.unionByName(own), asked.select("conv_id", (left + F.size("taken")).alias("n_turns"))


def _name(columns: list) -> list[Column]:
    """Two hashes of a block's number and its turn ids; nulls, which are always the last columns, do not count."""
    return [F.xxhash64(F.lit(n), "block", *columns) for n in (1, 2)]


def _blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each block of each conversation: block, k1, k2 (node before it), t1.., n (turns in it), ends (here)."""
    place = F.col("place") - 1
    slots = turns.select("conv_id", F.floor(place / WIDTH).alias("block"), F.pmod(place, F.lit(WIDTH)).alias("slot"), "id")
    columns = [F.max(F.when(F.col("slot") == n, F.col("id"))).alias(c) for n, c in enumerate(_COLUMNS)]
    rows = slots.groupBy("conv_id", "block").agg(*columns, F.count(F.lit(1)).cast("int").alias("n"))
    rows = written(rows, "trie-rows")
    zero = F.lit(0).cast("bigint")
    none = [F.lit(None).cast("binary").alias(c) for c in _COLUMNS]
    empty = convs.where("n_turns = 0").select(
        "conv_id", zero.alias("block"), *none, F.lit(0).alias("n"), zero.alias("k1"), zero.alias("k2"), F.lit(True).alias("ends")
    )
    short = rows.where(f"block = 0 AND n < {WIDTH}").select("*", zero.alias("k1"), zero.alias("k2"), F.lit(True).alias("ends"))
    # only conversations that fill their first block can have more
    x1, x2 = _name(_COLUMNS)
    full = rows.where(f"block > 0 OR n = {WIDTH}").withColumns(
        {"x1": x1, "x2": x2, "segment": F.floor(F.col("block") / SEGMENT)}
    )
    segments = full.groupBy("conv_id", "segment").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    segments = written(segments, "trie-segments")
    several = segments.where("segment > 0").select("conv_id").distinct()
    of_conv = W.partitionBy("conv_id").orderBy("segment")
    before = of_conv.rowsBetween(W.unboundedPreceding, -1)
    shift = segments.join(several, "conv_id", "left_semi").select(
        "conv_id", "segment", F.bit_xor("x1").over(before).alias("s1"), F.bit_xor("x2").over(before).alias("s2"),
        F.lead("segment").over(of_conv).isNotNull().alias("goes_on"),
    )
    shift = written(shift, "trie-segment-shifts")
    inside = W.partitionBy("conv_id", "segment").orderBy("block")
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    full = full.withColumns(
        {"p1": F.bit_xor("x1").over(before), "p2": F.bit_xor("x2").over(before), "last": F.lead("block").over(inside).isNull()}
    ).join(small_broadcast(shift, 100_000), ["conv_id", "segment"], "left")
    keys = [F.coalesce(f"s{n}", F.lit(0)).bitwiseXOR(F.coalesce(f"p{n}", F.lit(0))).alias(f"k{n}") for n in (1, 2)]
    full = full.select(*rows.columns, *keys, (F.col("last") & ~F.coalesce("goes_on", F.lit(False))).alias("ends"))
    return written(short.unionByName(full).unionByName(empty), "trie-blocks")


def _rolled(rows: DataFrame, measures: str) -> DataFrame:
    """Rows of all prefixes in all blocks: x1, x2 (their name), level (columns in use) and the measures."""
    listed = ", ".join(_COLUMNS)
    rolled = rows.sparkSession.sql(
        f"SELECT block, k1, k2, {listed}, {WIDTH} - bit_count(grouping_id()) AS level, {measures} "
        f"FROM {{rows}} GROUP BY block, k1, k2, ROLLUP({listed})",
        rows=rows,
    )
    # a prefix ends in a turn; without any it is the root, or the node in which the block before ended
    last = F.element_at(F.array(F.lit(b""), *_COLUMNS), F.col("level").cast("int") + 1)
    rolled = rolled.where(last.isNotNull() & ((F.col("level") > 0) | (F.col("block") == 0)))
    names = [F.col(f"k{n}").bitwiseXOR(x).alias(f"x{n}") for n, x in enumerate(_name(_COLUMNS), 1)]
    return rolled.select("*", *names, last.alias("last"))


def _totals_below(nodes: DataFrame) -> DataFrame | None:
    """(x1, x2, saved, leaves) summed over all blocks below each node that ends a block; None if no block has another below.

    Each block's own total is known; then every block adds the totals of those 1, 2, 4, ... blocks below it.
    """
    own = nodes.where("block > 0").groupBy("k1", "k2").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"))
    own = written(own.withColumnsRenamed({"k1": "x1", "k2": "x2"}), "trie-below")
    if own.isEmpty():
        return None
    inner = F.col("block") > 0
    ups = nodes.where(F.col("level") == WIDTH).select(
        "x1", "x2", F.when(inner, F.col("k1")).alias("u1"), F.when(inner, F.col("k2")).alias("u2")
    )
    table = written(own.join(ups, ["x1", "x2"]), "trie-below")
    while not table.where("u1 IS NOT NULL").isEmpty():
        added = table.where("u1 IS NOT NULL").groupBy(F.col("u1").alias("x1"), F.col("u2").alias("x2"))
        added = added.agg(F.sum("saved").alias("more"), F.sum("leaves").alias("more_leaves"))
        above = table.select(F.col("x1").alias("u1"), F.col("x2").alias("u2"), F.col("u1").alias("v1"), F.col("u2").alias("v2"))
        table = table.join(added, ["x1", "x2"], "left").join(above, ["u1", "u2"], "left").select(
            "x1", "x2", (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"),
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), F.col("v1").alias("u1"), F.col("v2").alias("u2"),
        )
        table = written(table, "trie-below")
    return table.select("x1", "x2", F.col("saved").alias("deep_saved"), F.col("leaves").alias("deep_leaves"))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the comma-joined ids of each node in a sorted partition.

    A node at the partition's border, or with many ids, is given out in pieces of text instead, to be joined later.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    rows: list[tuple] = []
    node, text, held, piece, whole = None, [], 0, 0, False

    def pieces() -> None:
        nonlocal text, held, piece
        rows.append((*node, piece, ",".join(text).encode(), None))
        text, held, piece = [], 0, piece + 1

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        names = ["x1", "x2", "piece", "text", "sha"]
        rows.clear()
        return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(arrays[0]), part), pa.int32())], [*names, "part"])

    for batch in batches:
        for x1, x2, conv in zip(*(batch.column(c).to_pylist() for c in ("x1", "x2", "conv_id")), strict=True):
            if (x1, x2) != node:
                if node is not None and whole and not piece:
                    rows.append((*node, 0, None, hashlib.sha256(",".join(text).encode()).hexdigest()))
                elif node is not None:
                    pieces()
                whole = node is not None  # the partition's first node may have begun before it
                node, text, held, piece = (x1, x2), [], 0, 0
            elif held >= PIECE_BYTES:
                pieces()
            text.append(str(conv))
            held += len(text[-1]) + 1
        yield out()
    if node is not None:
        pieces()
        yield out()


def _hashed_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's pieces, in their order."""
    node, state, found = None, None, []
    for batch in batches:
        for x1, x2, text in zip(*(batch.column(c).to_pylist() for c in ("x1", "x2", "text")), strict=True):
            if (x1, x2) != node:
                if node is not None:
                    found.append((*node, state.hexdigest()))
                node, state = (x1, x2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(text)
    if node is not None:
        found.append((*node, state.hexdigest()))
    columns = list(zip(*found, strict=True)) if found else [[]] * 3
    kinds = (pa.int64(), pa.int64(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["x1", "x2", "sha"])


def _end_digests(ends: DataFrame) -> DataFrame:
    """(x1, x2, sha) of the nodes in which conversations end.

    Ids are sorted and joined to text in ranges. SHA-256 has no parts that could be computed apart, so the text of a
    node with very many ids passes one task, piece by piece; no task holds more than some pieces.
    """
    order = ["x1", "x2", "conv_id"]
    ranged = ends.repartitionByRange(_ranges(ends), *order).sortWithinPartitions(*order)
    schema = "x1 bigint, x2 bigint, piece int, text binary, sha string, part int"
    found = written(ranged.mapInArrow(_joined_ids, schema), "trie-ends")
    border = found.where("sha IS NULL").repartition("x1", "x2").sortWithinPartitions("x1", "x2", "part", "piece")
    border = border.mapInArrow(_hashed_pieces, "x1 bigint, x2 bigint, sha string")
    return found.where("sha IS NOT NULL").select("x1", "x2", "sha").unionByName(border)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations; a node is a distinct sequence of first turns (role and text).

    `turns` has conv_id, place and id, as `numbered_turns` and `with_shared_heads` give them, `convs` conv_id and n_turns, also of
    conversations without turns. Columns: conv_id (smallest member), depth (0 for the root), parent_conv_id (null for the
    root), n_convs (members), n_children, n_leaves (childless nodes of the subtree, itself included), saved_tokens
    (over the subtree, (n_convs - 1) times the code points of the node's last text), ends_sha256 (of the ids
    of members that end in the node, ascending, joined by commas). No conversation, no node. A common prefix is
    counted by partial aggregation, so it may belong to any share of the conversations.
    """
    blocks = _blocks(turns, convs)
    rolled = _rolled(blocks, f"min(conv_id) AS conv_id, count(1) AS n_convs, max(if(ends, n, {WIDTH + 1})) AS reach")
    upper = [F.when(F.col("level") > n, F.col(c)) for n, c in enumerate(_COLUMNS, 1)]
    first = (F.col("level") == 1) & (F.col("block") > 0)
    root = (F.col("level") == 0) & (F.col("block") == 0)
    parents = {
        f"p{n}": F.when(root, None).when(first, F.col(f"k{n}")).otherwise(F.col(f"k{n}").bitwiseXOR(x))
        for n, x in enumerate(_name(upper), 1)
    }
    length = F.conv(F.hex(F.substring("last", 17, 4)), 16, 10).cast("bigint")
    nodes = rolled.withColumns(parents).select(
        "block", "k1", "k2", *_COLUMNS, "level", "x1", "x2", "p1", "p2", "conv_id", "n_convs",
        F.when(F.col("level") == 0, 0).otherwise((F.col("n_convs") - 1) * length).cast("bigint").alias("saved"),
        (F.col("reach") == F.col("level")).cast("bigint").alias("leaf"),
    )
    nodes = written(nodes, "trie-nodes")
    deeper = _totals_below(nodes)
    summed = nodes.select("block", "k1", "k2", *_COLUMNS, "x1", "x2", "saved", "leaf")
    if deeper is not None:
        summed = summed.join(small_broadcast(deeper, 100_000), ["x1", "x2"], "left").withColumns(
            {"saved": F.col("saved") + F.coalesce("deep_saved", F.lit(0)), "leaf": F.col("leaf") + F.coalesce("deep_leaves", F.lit(0))}
        )
    sums = _rolled(summed, "sum(saved) AS saved, sum(leaf) AS leaves").select("x1", "x2", "saved", "leaves")
    children = nodes.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2"))
    children = children.agg(F.count(F.lit(1)).alias("children"))
    name = [F.col(f"k{n}").bitwiseXOR(x).alias(f"x{n}") for n, x in enumerate(_name(_COLUMNS), 1)]
    ends = _end_digests(blocks.where("ends").select(*name, "conv_id"))
    depth = (F.col("block") * WIDTH + F.col("level")).alias("depth")
    facts = nodes.select("x1", "x2", "p1", "p2", "conv_id", depth, "n_convs")
    for more in (sums, children, ends):
        facts = facts.unionByName(more, allowMissingColumns=True)
    facts = facts.groupBy("x1", "x2").agg(*[F.max(c).alias(c) for c in facts.columns if c not in ("x1", "x2")])
    facts = written(facts, "trie-facts")
    above = facts.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return facts.join(above, ["p1", "p2"], "left").select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs",
        F.coalesce("children", F.lit(0)).cast("bigint").alias("n_children"), F.col("leaves").cast("bigint").alias("n_leaves"),
        F.col("saved").cast("bigint").alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
