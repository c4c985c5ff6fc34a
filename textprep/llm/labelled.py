"""Labelled texts: all of them as a table, or a bounded sample for models that are fitted on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from textprep.llm.tables import small_broadcast, written


def held_out(parts: int, rest: int) -> Column:
    """Whether crc32(doc_id as text) mod `parts` is `rest`; a row without doc_id counts as held out."""
    place = F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts
    return F.coalesce(place == rest, F.lit(True))


def _given(labels: DataFrame, label: str, learned: Column) -> DataFrame:
    """(doc_id, 0/1 label): repeated labels of a document count once (the largest), null labels do not count."""
    given = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(learned)
    return given.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learned: Column) -> DataFrame:
    """All labelled texts as a table in the shared folder: doc_id, text, label and `draw`, a fixed number of 40 bits by doc_id.

    Repeated rows of a document count once for each of its texts; null texts do not count.
    """
    ids = written(_given(labels, label, learned), "label-ids")
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(small_broadcast(ids), "doc_id").dropDuplicates(["doc_id", "text"])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("draw")), F.lit(1 << 40))
    return written(rows.select("doc_id", "text", "label", draw.alias("draw")), "labelled-texts")


def sample(
    docs: DataFrame, labels: DataFrame, label: str, learned: Column, rows_per_class: int, bytes_per_class: int
) -> tuple[list[bytes], np.ndarray]:
    """(texts, 0/1 labels): of each class about `rows_per_class` rows and `bytes_per_class` bytes at most.

    Rows are drawn by the hash of doc_id, so the sample is the same for any partitioning, and every labelled row is as
    likely as another of its class. Repeated labels of a document count once (the largest); null labels and
    texts do not count. Only the sample itself reaches the driver.
    """
    given = _given(labels, label, learned)
    sizes = docs.where("text IS NOT NULL").select("doc_id", F.octet_length("text").alias("size"))
    known = written(sizes.join(given, "doc_id").groupBy("doc_id").agg(F.max("size").alias("size"), F.max("label").alias("label")), "labelled")
    totals = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()
    chosen = F.lit(False)
    for row in totals:
        share = min(1.0, rows_per_class / row["n"], bytes_per_class / max(1, row["size"]))
        draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
        chosen = chosen | ((F.col("label") == row["label"]) & (draw < share))
    ids = known.where(chosen).select("doc_id", "label")  # bounded, so it may be broadcast
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "text"])
    found = sorted((r["doc_id"], r["text"], r["label"]) for r in rows.collect())
    return [t.encode() for _, t, _ in found], np.array([y for _, _, y in found], np.int64)


def flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one byte array and offsets."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), offsets
