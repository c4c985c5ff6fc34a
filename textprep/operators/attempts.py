"""A log of request attempts with leases, so that interrupted runs of models and judges can be resumed.

The log is a table that is only added to: (key, model, attempt, event, at, runner, lease_end). An attempt is claimed by a
runner until its lease ends, and then answered or failed; a claim whose lease has ended without either is expired.
A request is sent only by the runner that holds its claim, so never twice within a lease.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CLAIMED, ANSWERED, FAILED, EXPIRED = "claimed", "answered", "failed", "expired"
MAX_ATTEMPTS = 5


def _schema(key_type: str) -> str:
    return f"key {key_type}, model string, attempt int, event string, at timestamp, runner string, lease_end timestamp"


def read_log(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """All events; none while the log does not exist."""
    try:
        return spark.read.schema(_schema(key_type)).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _schema(key_type))


def states(log: DataFrame, now: Column) -> DataFrame:
    """(key, model, attempt, state, runner): where the latest attempt of each request stands.

    If an attempt was claimed by several runners the one whose claim came first, and among equals the one with the
    least name, holds it. An answer of any attempt settles the request; of one attempt an answer outweighs a failure.
    """
    claim = F.when(F.col("event") == CLAIMED, F.struct("at", "runner", "lease_end"))
    by_attempt = log.groupBy("key", "model", "attempt").agg(
        F.min(claim).alias("claim"),
        F.max(F.col("event") == ANSWERED).alias("answered"),
        F.max(F.col("event") == FAILED).alias("failed"),
    )
    state = (
        F.when(F.col("answered"), ANSWERED)
        .when(F.col("failed"), FAILED)
        .when(F.col("claim.lease_end") <= now, EXPIRED)
        .otherwise(CLAIMED)
    )
    last = F.struct("answered", "attempt", state.alias("state"), F.col("claim.runner").alias("runner"))
    latest = by_attempt.groupBy("key", "model").agg(F.max(last).alias("last"))
    return latest.select("key", "model", "last.attempt", "last.state", "last.runner")


def open_requests(requests: DataFrame, log: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(key, model, attempt) that may be claimed: never tried, failed or expired, with attempts left.

    `requests` is (key, model). The next attempt's number is part of the claim, so a claim repeated after a crash is the same.
    """
    known = states(log, now)
    tried = requests.select("key", "model").distinct().join(known, ["key", "model"], "left")
    ready = F.col("state").isNull() | F.col("state").isin(FAILED, EXPIRED)
    following = (F.coalesce("attempt", F.lit(0)) + 1).alias("attempt")
    return tried.where(ready).select("key", "model", following).where(F.col("attempt") <= max_attempts)


def _event(rows: DataFrame, event: str, now: Column, runner: str, lease_end: Column) -> DataFrame:
    return rows.select(
        "key", "model", F.col("attempt").cast("int").alias("attempt"), F.lit(event).alias("event"), now.alias("at"),
        F.lit(runner).alias("runner"), lease_end.cast("timestamp").alias("lease_end"),
    )


def claim(
    requests: DataFrame, path: str, now: Column, lease: str, runner: str | None = None, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """Claim what is open and return the claims that this runner holds: (key, model, attempt).

    `lease` is an interval such as "10 minutes", `now` a timestamp that all runners share. Runners that claim the same attempt
    at once see both claims when they read the log again, and only one of them keeps it. A runner that repeats its
    name gets its own running claims back, e.g. after a restart within the lease.
    """
    spark, runner = requests.sparkSession, runner or uuid.uuid4().hex
    kind = requests.schema["key"].dataType.simpleString()
    wanted = open_requests(requests, read_log(spark, path, kind), now, max_attempts)
    _event(wanted, CLAIMED, now, runner, now + F.expr(f"INTERVAL {lease}")).write.mode("append").parquet(path)
    held = states(read_log(spark, path, kind), now).where((F.col("state") == CLAIMED) & (F.col("runner") == runner))
    return held.join(requests.select("key", "model").distinct(), ["key", "model"], "left_semi").select("key", "model", "attempt")


def settle(claims: DataFrame, path: str, now: Column, runner: str, event: str = ANSWERED) -> None:
    """Note that attempts (key, model, attempt) were answered, or failed. Noting it twice changes nothing."""
    if event not in (ANSWERED, FAILED):
        raise ValueError(f"an attempt is {ANSWERED} or {FAILED}, not {event}")
    _event(claims, event, now, runner, F.lit(None)).write.mode("append").parquet(path)


def exhausted(requests: DataFrame, log: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(key, model) without an answer whose attempts are used up: for a person to look at."""
    known = states(log, now).where(F.col("state").isin(FAILED, EXPIRED) & (F.col("attempt") >= max_attempts))
    return requests.select("key", "model").distinct().join(known, ["key", "model"], "left_semi")


def pairs(requests: DataFrame, key: str, models: Iterable[str]) -> DataFrame:
    """A request for each key and model."""
    listed = F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    return requests.select(F.col(key).alias("key"), listed)
