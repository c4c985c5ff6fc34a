"""Exact cuts, splits and running totals against plain Python."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from textprep.operators import sampling


@pytest.fixture
def narrow_always(monkeypatch):
    """Force the histogram path on small data."""
    monkeypatch.setattr(sampling, "_DIRECT_ROWS", 3)
    monkeypatch.setattr(sampling, "_BINS", 4)


def first_ids(data, n):
    return sorted(i for _, i in sorted(data)[:n])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(st.integers(-50, 50) | st.just(7), min_size=1, max_size=60),
    share=st.floats(0, 1),
)
def test_cut_is_exact_under_ties(spark, narrow_always, values, share):
    data = [(v, i * 1_000_003) for i, v in enumerate(values)]
    n = max(1, int(len(values) * share))
    df = spark.createDataFrame(data, "k long, id long")
    keep = sampling.before_cut(df, n, {"k": F.col("k"), "id": F.col("id")})
    kept = df if keep is None else df.where(keep)
    assert sorted(r["id"] for r in kept.collect()) == first_ids(data, n)


def test_cut_of_a_hot_value(spark, narrow_always):
    data = [(1, i) for i in range(300)] + [(0, 1000 + i) for i in range(20)] + [(2, 5000)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "k long, id long").repartition(5)
    for n in (1, 20, 21, 150, 320, 321):
        keep = sampling.before_cut(df, n, {"k": F.col("k"), "id": F.col("id")})
        kept = df if keep is None else df.where(keep)
        assert sorted(r["id"] for r in kept.collect()) == first_ids(data, n)


def test_both_paths_agree(spark, monkeypatch):
    df = spark.range(500).withColumn("m", F.col("id") % 9)
    ordered = {r["id"] for r in sampling.top_n(df, 123, "m", "id").collect()}
    monkeypatch.setattr(sampling, "_DIRECT_ROWS", 5)
    monkeypatch.setattr(sampling, "_BINS", 8)
    assert {r["id"] for r in sampling.top_n(df, 123, "m", "id").collect()} == ordered
    sample = {r["id"] for r in sampling.sample_n(df, 77, "id").collect()}
    monkeypatch.setattr(sampling, "_DIRECT_ROWS", 10_000)
    assert {r["id"] for r in sampling.sample_n(df, 77, "id").collect()} == sample


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 30, 101])
def test_split_sizes(spark, n):
    split = sampling.exact_split(spark.range(n), "id")
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    held = math.ceil(n * 0.1)
    assert sizes.get("validation", 0) == held and sizes.get("train", 0) == n - held


def test_split_does_not_depend_on_partitioning(spark):
    results = set()
    for parts in (1, 7, 16):
        split = sampling.exact_split(spark.range(200).repartition(parts), "id")
        results.add(tuple(sorted(r["id"] for r in split.where("split = 'validation'").collect())))
    assert len(results) == 1


@pytest.mark.parametrize("parts", [1, 7, 16])
def test_positions_are_a_permutation(spark, parts):
    df = spark.range(333).repartition(parts)
    got = [(r["position"], r["id"]) for r in sampling.shuffle_positions(df, "id").collect()]
    assert sorted(p for p, _ in got) == list(range(1, 334))
    order = [i for _, i in sorted(got)]
    assert order != sorted(order)


def test_running_totals_of_clumped_ids(spark):
    ids = list(range(200)) + [10**12 + i for i in range(50)] + [-(10**9)]
    df = spark.createDataFrame([(i, i % 7) for i in ids], "id long, n long").repartition(6)
    got = sampling.in_batches(sampling.running_totals(df, "id", {"total": "n"}, buckets=16), 10).orderBy("id").collect()
    total = 0
    for place, (row, i) in enumerate(zip(got, sorted(ids)), start=1):
        total += i % 7
        assert (row["id"], row["position"], row["total"], row["batch_id"]) == (i, place, total, (place - 1) // 10)


@pytest.mark.parametrize("salts", [1, 3, 8])
def test_top_n_per_group_with_a_hot_group(spark, salts):
    data = [("hot", i, i % 13) for i in range(400)] + [("a", 1000 + i, i) for i in range(5)] + [("b", 2000, 1)]
    df = spark.createDataFrame(data, "g string, id long, m long").repartition(6)
    top = sampling.top_n_per_group(df, "g", 7, [F.desc("m"), F.asc("id")], "id", salts=salts)
    got = sorted((r["g"], r["id"]) for r in top.collect())
    want = []
    for g in ("hot", "a", "b"):
        mine = sorted(((-m, i) for gg, i, m in data if gg == g))[:7]
        want += [(g, i) for _, i in mine]
    assert got == sorted(want)


def test_first_n_of_large_n_is_a_filter(spark, monkeypatch):
    monkeypatch.setattr(sampling, "_DIRECT_ROWS", 10)
    df = spark.range(1000).withColumn("payload", F.lit("x"))
    plan = sampling.first_n(df, 100, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert sampling.first_n(df, 100, "id").count() == 100


def test_text_ids_split_exactly(spark):
    df = spark.range(57).select(F.concat(F.lit("row-"), "id").alias("id"))
    assert sampling.exact_split(df, "id").where("split = 'validation'").count() == 6
    assert sampling.sample_n(df, 20, "id").count() == 20


def test_first_n_does_not_sort_the_payload(spark):
    df = spark.range(1000).withColumn("payload", F.lit("x"))
    kept = sampling.first_n(df, 10, "id").selectExpr("payload || 'y'")
    text = kept._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in text and "Exchange" not in text and kept.count() == 10


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "id long, n long")
    assert sampling.running_totals(empty, "id", {"used": "n"}).count() == 0
    assert sampling.shuffle_positions(empty, "id").count() == 0
    assert sampling.first_n(empty, 3, "id").count() == 0 and sampling.exact_split(empty, "id").count() == 0
    one = spark.createDataFrame([(7, 2)], "id long, n long")
    assert [tuple(r) for r in sampling.running_totals(one, "id", {"used": "n"}).collect()] == [(7, 2, 1, 2)]


def test_no_task_sorts_the_first_rows_of_all_others(spark, monkeypatch):
    """Only the rows in question are ordered directly, however small n is."""
    seen = []
    plain = sampling._nth
    monkeypatch.setattr(sampling, "_DIRECT_ROWS", 50)
    monkeypatch.setattr(sampling, "_nth", lambda df, n: (seen.append(df.count()), plain(df, n))[1])
    assert sampling.first_n(spark.range(20_000), 3, "id").count() == 3
    assert seen and max(seen) <= 50
