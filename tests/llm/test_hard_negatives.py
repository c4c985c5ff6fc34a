"""Hard negatives against plain products of all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textprep.llm import hard_negatives as hard

SCHEMA = "vec_id bigint, embedding array<float>, label int, anchor_id string, rank int, `window` double, score string"


def plain(rows, every=5, n_positives=5, n_negatives=3, scale=256.0):
    usable = {}
    for vec, vector, label in rows:
        if vec is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable[vec] = min(usable.get(vec, (str(label), vector)), (str(label), vector))
    v = {i: (label, [math.floor(scale * x) for x in vector]) for i, (label, vector) in usable.items()}
    out = []
    for a in sorted(v):
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v[a][1], v[b][1])), b) for b in v if b != a)
        for score, p in [(s, b) for s, b in scored if v[b][0] == v[a][0]][:n_positives]:
            window = [(s, b) for s, b in scored if v[b][0] != v[a][0] and 50 * -score <= 100 * -s <= 95 * -score]
            out += [(a, p, k, b, -score, -s) for k, (s, b) in enumerate(window[:n_negatives], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 0.5, "y") for i, v, label in rows], SCHEMA)


def found(spark, rows, **kw):
    df = hard.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0, **kw)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


def gaussian(seed, n, width=16, labels=3):
    draw = random.Random(seed)
    return [(i, [float(f"{draw.gauss(0, 0.25):.3f}") for _ in range(width)], draw.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("chunk", [1 << 20, 2_000])
def test_same_as_all_pairs(spark, chunk):
    rows = gaussian(1, 300)
    assert found(spark, rows, chunk_bytes=chunk) == plain(rows)


def test_windows_without_enough_rows_and_small_labels(spark):
    draw = random.Random(2)
    # labels of one, two and many rows; few directions, so that most windows stay short and scores tie
    rows = [(i, [float(draw.choice((0, 1))), float(draw.choice((0, 1, 2))), 0.0], min(i, 4) if i < 6 else 7 + i % 2) for i in range(60)]
    assert found(spark, rows, scale=1.0) == plain(rows, scale=1.0)


def test_copies_and_decaying_components(spark):
    draw = random.Random(3)
    base = [draw.gauss(0, 1) / (1 + j) for j in range(24)]
    rows = [(i, [float(f"{x + draw.gauss(0, 0.001):.4f}") for x in base], 1) for i in range(150)]
    rows += [(1000 + i, [float(f"{0.8 * x + draw.gauss(0, 0.1) / (1 + j):.4f}") for j, x in enumerate(base)], i % 3) for i in range(150)]
    rows += [(2000 + i, list(rows[0][1]), 2) for i in range(40)]
    rounded = [(i, spark.createDataFrame([(v,)], "v array<float>").first()[0] if i == 0 else v, label) for i, v, label in rows]
    stored = [tuple(r) for r in frame(spark, rounded).select("vec_id", "embedding", "label").collect()]
    assert found(spark, rows) == plain(stored)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = gaussian(4, 80)
    rows += [(None, [1.0] * 16, 1), (500, None, 1), (505, [1.0] * 16, None), (510, [1.0] * 15 + [None], 0), (None, None, None)]
    rows += [(515, [nan] + [1.0] * 15, 0), (520, [inf] + [1.0] * 15, 0), (525, [], 1), (530, [0.5, 0.5], 2), (535, [0.0] * 16, 1)]
    rows += [rows[0], rows[0], (10, [0.25] * 16, 1), (10, [0.5] * 16, 0), (15, rows[15][1], rows[15][2])]
    stored = [tuple(r) for r in frame(spark, rows).select("vec_id", "embedding", "label").collect()]
    assert found(spark, rows) == plain(stored)


def test_no_rows_and_no_anchors(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 0), (2, [1.0], 1), (None, None, None)]) == []
