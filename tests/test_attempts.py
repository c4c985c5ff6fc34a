"""Leases of request attempts, and de-duplication in stream state."""

from pyspark.sql import functions as F

from textprep.operators import attempts
from textprep.session import shared_path
from textprep.streaming import stateful


def at(minute):
    return F.lit(f"2024-01-01 00:{minute:02d}:00").cast("timestamp")


def listed(df):
    return sorted(tuple(r) for r in df.collect())


def test_an_interrupted_run_goes_on(spark):
    path, requests = shared_path(spark, "attempts"), attempts.pairs(spark.range(3).toDF("id"), "id", ["a", "b"])
    first = attempts.claim(requests, path, at(0), "10 minutes", "one")
    assert listed(first) == [(k, m, 1) for k in range(3) for m in "ab"]
    attempts.settle(first.where("key = 0"), path, at(1), "one")
    attempts.settle(first.where("key = 1 AND model = 'a'"), path, at(1), "one", attempts.FAILED)
    # within the lease another runner gets what has failed, and nothing that is under way
    assert listed(attempts.claim(requests, path, at(5), "10 minutes", "two")) == [(1, "a", 2)]
    # the first runner, started again, still holds its own
    assert listed(attempts.claim(requests, path, at(6), "10 minutes", "one")) == [(1, "b", 1), (2, "a", 1), (2, "b", 1)]
    # its lease ends: whoever asks next gets them, and the late answer of an earlier attempt settles a request all the same
    later = attempts.claim(requests, path, at(11), "10 minutes", "three")
    assert listed(later) == [(1, "b", 2), (2, "a", 2), (2, "b", 2)]
    attempts.settle(first.where("key = 2 AND model = 'a'"), path, at(12), "one")
    assert listed(attempts.claim(requests, path, at(30), "1 minute", "four")) == [(1, "a", 3), (1, "b", 3), (2, "b", 3)]
    log = attempts.read_log(spark, path)
    assert listed(attempts.exhausted(requests, log, at(59), max_attempts=3)) == [(1, "a"), (1, "b"), (2, "b")]
    assert attempts.open_requests(requests, log, at(59), max_attempts=3).count() == 0


def test_runners_that_claim_at_once(spark):
    """Both have read the log before either has written to it: one of them keeps each claim."""
    path, requests = shared_path(spark, "attempts"), attempts.pairs(spark.range(4).toDF("id"), "id", ["a"])
    wanted = attempts.open_requests(requests, attempts.read_log(spark, path), at(0))
    for runner in ("one", "two"):
        rows = attempts._event(wanted, attempts.CLAIMED, at(0), runner, at(9))
        rows.write.mode("append").parquet(path)
    held = [listed(attempts.claim(requests, path, at(1), "9 minutes", runner)) for runner in ("one", "two")]
    assert held == [[(k, "a", 1) for k in range(4)], []]


def test_state_de_duplicates_over_restarts(spark):
    arrivals, sink, state = (shared_path(spark, n) for n in ("in", "out", "state"))
    schema = "id long, at timestamp, v string"

    def arrive(rows):
        frame = spark.createDataFrame(rows, "id long, day int, v string")
        frame = frame.select("id", F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)).alias("at"), "v")
        frame.coalesce(1).write.mode("append").parquet(arrivals)
        stateful.run(spark, arrivals, schema, sink, state, "id", "at", keep_for="5 days", files_per_batch=1)
        return sorted((r["id"], r["v"]) for r in spark.read.parquet(sink).collect())

    assert arrive([(1, 1, "a"), (1, 1, "a"), (2, 1, "b")]) == [(1, "a"), (2, "b")]
    assert arrive([(2, 2, "later"), (3, 2, "c")]) == [(1, "a"), (2, "b"), (3, "c")]
    stateful.run(spark, arrivals, schema, sink, state, "id", "at", keep_for="5 days")  # nothing new
    assert arrive([(1, 3, "x"), (2, 3, "x"), (3, 3, "x"), (4, 3, "d")]) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert arrive([(9, 20, "e")])[-1] == (9, "e")
    assert arrive([(1, 20, "again"), (9, 20, "x")]) == [(1, "a"), (1, "again"), (2, "b"), (3, "c"), (4, "d"), (9, "e")]
