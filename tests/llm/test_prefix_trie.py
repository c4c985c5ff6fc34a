"""The trie of conversations against plain prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from textprep.llm import prefix_trie as trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, id string, place int, block int, level string, k1 int, n_convs int"


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest() + len(text).to_bytes(4, "big")
            own[conv].append((turn is not None, turn or 0, mark, (role, text)))
    turns = {c: [t[3] for t in sorted(x, key=lambda t: t[:3])] for c, x in own.items()}
    whole = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        whole[c] = tuple(turns.get(head, [])[:h] + x[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
            if d:
                children[whole[c][: d - 1]].add(whole[c][:d])
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
            leaves[node[:d]] += not children[node]
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in convs if whole[c] == node)
        parent = members[node[:-1]][0] if node else None
        out.append(
            (convs[0], len(node), parent, len(convs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "i", 1, 2, "l", 3, 4) for r in rows], SCHEMA)
    turns, convs = trie.numbered_turns(df)
    head, shared = F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string")) % 6
    got = trie.prefix_trie(*trie.with_shared_heads(turns, convs, head, shared, most=5))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got.columns == names and {t for _, t in got.dtypes[:-1]} == {"bigint"}
    return sorted(map(tuple, got.collect()), key=str)


def test_random_conversations(spark):
    draw = random.Random(1)
    rows = [
        (c, t, draw.choice(("user", "assistant")), draw.choice(("a", "bb", "é漢🙂")))
        for c in range(0, 400, 3)
        for t in range(draw.randrange(1, 12))
    ]
    draw.shuffle(rows)
    assert found(spark, rows) == plain(rows)


def test_blocks_and_segments_continue(spark, monkeypatch):
    """Conversations of many blocks that part in the middle of one, at its border, and that end there."""
    monkeypatch.setattr(trie, "SEGMENT", 2)
    rows = []
    for c, (shared, total) in enumerate([(0, 100), (100, 100), (50, 60), (48, 49), (48, 48), (47, 70), (8, 8), (8, 9), (7, 30), (16, 16), (16, 90)]):
        rows += [(100 * c, t, "r", f"turn {t}" if t < shared or c == 0 else f"turn {t} of {c}") for t in range(total)]
        rows += [(100 * c + 7, t, "r", f"turn {t}" if t < shared else "x") for t in range(total)]
    assert found(spark, rows) == plain(rows)


def test_many_equal_conversations(spark):
    """More than one range holds the ids that end in one node."""
    rows = [(c, 0, "u", "same") for c in range(5_000)] + [(10_000 + c, t, "u", f"{c}") for c in range(50) for t in range(3)]
    assert found(spark, rows) == plain(rows)


def test_one_conversation_holds_most_turns(spark):
    rows = [(100, t, "u", f"{t % 10}") for t in range(3_000)] + [(c, t, "u", "x") for c in range(101, 130) for t in range(6)]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "u", "nobody's"), (None, None, None, None), (1, None, "u", "null turn first"), (1, 0, None, "no role"), (1, 1, "u", None),
        (2, 0, "u", ""), (2, 0, None, None), (2, 0, "u", ""), (3, 5, "a", "bc"), (3, 5, "ab", "c"), (4, -1, "u", "w " * 200_000),
        (-7, 0, "u", "minus"), (-100, 0, "u", "head"), (-107, 0, "u", "x"), (-107, 1, "u", "y"), (905, 0, "u", "no head, few turns"),
        (905, 1, "u", "z"), (200, 0, "u", "one"), (201, 0, "u", "a"), (201, 1, "u", "b"), (201, 9, "u", "c"),
    ]
    assert found(spark, rows) == plain(rows)


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "u", "x")]) == []


def test_rollup_is_the_plan(spark):
    df = spark.createDataFrame([(1, t, "u", f"{t}", "i", 1, 2, "l", 3, 4) for t in range(20)], SCHEMA)
    turns, convs = trie.numbered_turns(df)
    rolled = trie._rolled(trie._blocks(turns, convs), "count(1) AS n")
    assert "Expand" in rolled._jdf.queryExecution().executedPlan().toString() and rolled.count() == 21
