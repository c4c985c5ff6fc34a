"""Near-duplicate vectors against plain cosines of all pairs."""

import math
import random

import numpy as np
import pytest

from textprep.llm import vector_dedup as dedup

SCHEMA = "vec_id bigint, embedding array<float>, label int, node string, links int, a int, b int, component_id string"


def plain(rows, threshold=0.98):
    """(vec_id, n_links, component_id, kept) of each row, one after another."""
    usable = []
    for vec, vector, label in rows:
        bad = vec is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector)
        usable.append(not bad and any(vector))
    width = max([len(v) for _, v, _ in rows if v], default=0)
    unit = {}
    for i, (_, vector, _) in enumerate(rows):
        if usable[i]:
            x = np.array(list(vector) + [0.0] * (width - len(vector)))
            unit[i] = x / np.linalg.norm(x)
    links = {i: [j for j in unit if j != i and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= threshold] for i in unit}
    out = []
    for i, (vec, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen), default=None) if i in unit else vec
        out.append((vec, len(links.get(i, [])), least, vec is None or vec == least))
    return sorted(out, key=str)


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, label, "x", 1, 1, 1, "c") for i, v, label in rows], SCHEMA)
    got = dedup.vector_duplicates(df, **kw)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, got.collect()), key=str)


def stored(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def families(seed, groups, size, noise, width=12):
    """Groups around a centre each; with this noise some members are linked directly, some only through others."""
    draw, rows = random.Random(seed), []
    for g in range(groups):
        centre = [draw.gauss(0, 1) for _ in range(width)]
        for _ in range(size):
            rows.append((len(rows), [x + draw.gauss(0, noise) for x in centre], g % 2))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_rows", [None, 40, 9])
def test_same_as_all_pairs(spark, block_rows):
    rows = stored(families(1, 12, 14, 0.13))
    want = plain(rows)
    assert 0 < sum(n for _, n, _, _ in want) < 12 * 14 * 13
    assert found(spark, rows, block_rows=block_rows) == want


def test_a_chain_through_blocks_and_a_third_of_copies(spark):
    rows = [(i, [math.cos(i * 0.19), math.sin(i * 0.19), 0.0], 1) for i in range(30)]  # neighbours at 0.982, next ones below
    rows += [(100 + i, [0.5, 0.25, 0.75], 1) for i in range(60)] + [(200 + i, [0.5, 0.25, 0.75 + i / 1e4], 2) for i in range(60)]
    rows += [(300, [1.0, 0.5, 1.5], 1)]  # the same direction, another length
    rows = stored(rows)
    want = plain(rows)
    assert max(n for _, n, _, _ in want) >= 60
    assert found(spark, rows, block_rows=7) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = families(2, 5, 6, 0.1)
    rows += [(None, [1.0] * 12, 1), (900, None, 1), (901, [1.0] * 12, None), (902, [1.0] * 11 + [None], 0), (None, None, None)]
    rows += [(903, [nan] + [1.0] * 11, 0), (904, [inf] + [1.0] * 11, 0), (905, [], 1), (906, [0.5, 0.5], 1), (907, [0.5, 0.5, 0.0], 1)]
    rows += [(908, [0.0] * 12, 1), (909, [0.0] * 12, 1), (910, [1e-30] * 12, 0), (911, [3e38] * 12, 0), rows[0], rows[0]]
    rows += [(rows[1][0], [1.0] + [0.0] * 11, 1)]
    rows = stored(rows)
    assert found(spark, rows, block_rows=5) == plain(rows)


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, 1), (2, [0.0], 1)]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_a_tile_of_fast_decaying_components():
    draw = np.random.default_rng(1)
    unit = dedup._unit(draw.normal(size=(50, 64)) * 2.0 ** -np.arange(64))
    suffix = np.sqrt(np.hstack([np.cumsum(unit[:, ::-1] ** 2, axis=1)[:, ::-1], np.zeros((50, 1))]))
    x = {"unit": unit, "turned": unit, "suffix": suffix}

    i, j = dedup._tile(x, {"unit": -unit, "turned": -unit, "suffix": suffix}, 0.98)
    want = [(a, b) for a in range(50) for b in range(50) if -unit[a] @ unit[b] >= 0.98]
    assert sorted(zip(i.tolist(), j.tolist())) == want
