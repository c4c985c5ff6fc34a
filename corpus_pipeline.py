"""A training-corpus pipeline: each stage takes all that its predecessor kept, as a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textprep.llm import byte_bpe, decontaminate, near_dedup, passages, quality
from textprep.llm.annotate import free_name
from textprep.llm.queries import byte_vocabulary
from textprep.session import shared_path


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of low quality go; the model is fitted to the labelled documents of the folder."""
    source, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return quality.drop_low_quality(spark, docs, source, labels)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return near_dedup.drop_near_duplicates(docs)


def _suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds are cut out; every document stays."""
    return passages.drop_repeated_passages(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least one word in 20 stands in a window of the benchmark go."""
    return decontaminate.drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, beside all columns of its document, with digests of the ids and of the bytes decoded from them.

    Where the table has a column of such a name (in any case), the stage's own has underscores appended.
    """
    # workers that have run four stages before this one remember fewer chunks
    coded, name = byte_bpe.encoded(spark, docs, *byte_vocabulary(), remembered=150_000)
    wanted = ("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    return coded.select(*docs.columns, *[F.col(f"{name}.{c}").alias(free_name(docs, c)) for c in wanted])


STAGES = [
    ("neighbour_quality", _quality),
    ("minhash_near_dedup", _near_dedup),
    ("suffix_array_dedup", _suffix_dedup),
    ("decontamination", _decontaminate),
    ("byte_bpe", _byte_bpe),
]

# A trained model, verified similarity and byte-pair encoding: not expressible in SQL, tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
