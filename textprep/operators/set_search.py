"""Exact top-k search of token sets by Jaccard similarity, as joins over an inverted index.

A query's tokens are ordered rare first. A document that reaches similarity t with a query of n tokens shares at least
a = t / (1 + t) * (n + size) of them, and never less than t * n. So the ceil(t * n) - 1 most frequent tokens need
not be looked up: of the others a document must hold a - skipped at least, and those that do are the candidates,
whose whole sets are compared. The bound t is a k-th similarity that a first look into the shortest lists has found.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window as W, functions as F

from textprep.functions.text import tokens
from textprep.plans.sizing import broadcast_if_small
from textprep.session import shared_path

SEED_POSTINGS = 2_000  # entries of a query's shortest lists that give its first bound
SEED_CANDIDATES = 4  # times k of them are compared
SALT_MATCHES = 1_000_000  # postings times queries of a token, beyond which its list is divided
ROUND = 6
_SLACK = 1e-6


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sets(df: DataFrame, key: str) -> DataFrame:
    words = F.array_distinct(tokens(F.coalesce("text", F.lit(""))))
    return _written(df.select(F.col(key).cast("long").alias(key), words.alias("words")), "token-sets")


def _scored(pairs: DataFrame, asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of pairs that share a token, the score negative so that smaller is better."""
    ids, _ = broadcast_if_small(pairs.select("doc_id").distinct())
    held = docs.join(ids, "doc_id", "left_semi").select("doc_id", F.col("words").alias("held"))
    both = F.size(F.array_intersect("words", "held"))
    joined = pairs.select("query_id", "doc_id").join(held, "doc_id").join(asked.select("query_id", "words"), "query_id")
    joined = joined.select("query_id", "doc_id", both.alias("both"), (F.size("words") + F.size("held") - both).alias("either"))
    score = -F.round(F.col("both") / F.col("either"), ROUND)
    return joined.where("both > 0").select("query_id", "doc_id", score.alias("score"))


def _terms(asked: DataFrame, postings: DataFrame, salt_matches: int) -> DataFrame:
    """Tokens of each query, rare first: query_id, n (its tokens), place (from 0), token, df, before (postings of rarer ones), salts."""
    exploded = asked.select("query_id", F.size("words").alias("n"), F.explode("words").alias("token"))
    held = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    of_token = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("qf")).join(held, "token")
    salts = F.greatest(F.lit(1), F.ceil(F.col("df") * F.col("qf") / salt_matches)).cast("int").alias("salts")
    of_token = _written(of_token.select("token", "df", salts), "token-lists")
    small, _ = broadcast_if_small(of_token)
    known = exploded.join(small, "token")
    ahead = W.partitionBy("query_id").orderBy("df", "token")
    # tokens that no document holds are the rarest: they count, but have no list
    place = F.col("n") - F.count(F.lit(1)).over(W.partitionBy("query_id")) + F.row_number().over(ahead) - 1
    before = F.coalesce(F.sum("df").over(ahead.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return _written(known.select("query_id", "n", place.alias("place"), "token", "df", before.alias("before"), "salts"), "token-terms")


def _matches(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """A row for each shared token of a query and a document; a long list is divided among as many tasks as it has salts."""
    lists = terms.groupBy("token").agg(F.max("salts").alias("salts"))
    lists, _ = broadcast_if_small(lists)
    salted = postings.join(lists, "token").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).drop("salts")
    asking = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return asking.join(salted, ["token", "salt"])


def candidates(terms: DataFrame, postings: DataFrame, bounds: DataFrame) -> DataFrame:
    """(query_id, doc_id) of all pairs that may reach the bound of their query (query_id, bound)."""
    bounded = terms.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    skipped = F.greatest(F.ceil(F.col("bound") * F.col("n") - _SLACK) - 1, F.lit(0))
    looked = bounded.withColumn("skipped", skipped).where(F.col("place") < F.col("n") - F.col("skipped"))
    size, n, bound = F.col("size"), F.col("n"), F.col("bound")
    fits = (size >= bound * n - _SLACK) & (size * bound <= n + _SLACK)
    least = bound / (1 + bound) * (n + size) - F.col("skipped") - _SLACK
    found = _matches(looked, postings).where(fits).groupBy("query_id", "doc_id").agg(
        F.count(F.lit(1)).alias("shared"), F.first(least).alias("least")
    )
    return found.where("shared >= least").select("query_id", "doc_id")


def knn_jaccard(
    queries: DataFrame, corpus: DataFrame, k: int, seed_postings: int = SEED_POSTINGS, salt_matches: int = SALT_MATCHES
) -> DataFrame:
    """The k documents with the largest Jaccard similarity of token sets, of those that share a token.

    `queries` is (query_id, text), `corpus` (doc_id, text), with one row per id: (query_id, rank, doc_id, score). A null text
    has no token. Ties go to the smaller id. The result is exact whatever the first look finds; a better bound
    leaves fewer candidates. Both tables are split into tokens once.
    """
    asked, docs = _sets(queries, "query_id"), _sets(corpus, "doc_id")
    wanted, _ = broadcast_if_small(asked.select(F.explode("words").alias("token")).distinct())
    postings = docs.select("doc_id", F.size("words").alias("size"), F.explode("words").alias("token"))
    postings = _written(postings.join(wanted, "token", "left_semi"), "postings")
    terms = _terms(asked, postings, salt_matches)

    def best(scored: DataFrame, n: int) -> DataFrame:
        place = F.row_number().over(W.partitionBy("query_id").orderBy("score", "doc_id"))
        return scored.withColumn("rank", place).where(F.col("rank") <= n)

    short = terms.where((F.col("before") + F.col("df") <= seed_postings) | (F.col("before") == 0))
    guess = -F.count(F.lit(1)) / (F.first("n") + F.first("size") - F.count(F.lit(1)))
    seeds = best(_matches(short, postings).groupBy("query_id", "doc_id").agg(guess.alias("score")), SEED_CANDIDATES * k)
    seeds = best(_scored(_written(seeds.select("query_id", "doc_id"), "seeds"), asked, docs), k)
    worst = -F.max("score") - _SLACK  # scores are rounded, and equal ones are ranked by id
    bounds = seeds.groupBy("query_id").agg(F.max("rank").alias("found"), F.greatest(worst, F.lit(0.0)).alias("bound"))
    bounds = _written(bounds.where(F.col("found") == k).select("query_id", "bound"), "bounds")
    pairs = _written(candidates(terms, postings, bounds), "candidates")
    found = best(_scored(pairs, asked, docs), k)
    return found.select("query_id", "rank", "doc_id", (-F.col("score")).alias("score"))
