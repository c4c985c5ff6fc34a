"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's features are hashed words, hashed word shapes (letters, capitals, digits and marks, runs as one), pairs of
neighbouring shapes, and repetitions of a word soon after itself. Logarithmic counts times inverse document frequencies are
projected on the leading right singular vectors of the labelled sample. The sample's vectors are broadcast; every document
gets its exact cosines with all of them, block by block, and the labels of the nearest vote with the cosine as weight.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from textprep.llm.annotate import annotated, free_name
from textprep.llm.batches import LOWER, SPACED_WORD, Words, fingerprints
from textprep.llm.labelled import flat, held_out, sample

WORD_BUCKETS, SHAPE_BUCKETS, PAIR_BUCKETS = 2048, 1024, 1024
LAGS = 8
DIMENSIONS = 64
NEIGHBOURS = 15
SHARPNESS = 8  # the weight of a neighbour is its cosine to this power
THRESHOLD = 0.3
WORD_SHARE = 0.5  # of a vector's length before projection, against 1 for shapes and pairs
# The bound of the labelled sample, per class.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 16 << 20
PIECE_BYTES = 1 << 20
BLOCK_ROWS = 256

_ALL = np.arange(256)
_CLASS = np.select(
    [(_ALL >= 65) & (_ALL <= 90), (_ALL >= 97) & (_ALL <= 122) | (_ALL >= 128), (_ALL >= 48) & (_ALL <= 57)], [65, 97, 48], _ALL
).astype(np.uint8)
_SIZES = (WORD_BUCKETS, SHAPE_BUCKETS, PAIR_BUCKETS, LAGS + 1)
_FIRST = np.concatenate([[0], np.cumsum(_SIZES)])
FEATURES = int(_FIRST[-1])


def _shapes(data: np.ndarray, words: Words) -> np.ndarray:
    kinds = _CLASS[data]
    at = np.ones(len(words) and int(words.length.sum()), bool)
    inside = kinds[SPACED_WORD[data]]
    at[1:] = inside[1:] != inside[:-1]
    firsts = np.cumsum(words.length) - words.length
    at[firsts] = True
    if not len(words):
        return np.zeros(0, np.uint64)
    return fingerprints(inside[at], np.add.reduceat(at.astype(np.int64), firsts))


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts x FEATURES) counts of the features of whole texts."""
    words = Words(data, offsets, SPACED_WORD, LOWER)
    n, texts = len(words), len(words.counts)
    owner = np.repeat(np.arange(texts), words.counts)
    shapes = _shapes(data, words)
    together = owner[1:] == owner[:-1]
    pair = (shapes[:-1] * np.uint64(0x9E3779B97F4A7C15) + shapes[1:]) >> np.uint64(20)
    found = [
        (owner, words.hash % np.uint64(WORD_BUCKETS), 0),
        (owner, shapes % np.uint64(SHAPE_BUCKETS), 1),
        (owner[1:][together], (pair % np.uint64(PAIR_BUCKETS))[together], 2),
    ]
    for lag in range(1, LAGS + 1):
        again = np.flatnonzero((words.hash[lag:] == words.hash[:-lag]) & (owner[lag:] == owner[:-lag])) if n > lag else np.zeros(0, int)
        found.append((owner[again], np.full(len(again), lag, np.uint64), 3))
    total = np.zeros(texts * FEATURES, np.float32)
    for rows, buckets, kind in found:
        place = rows * FEATURES + _FIRST[kind] + buckets.astype(np.int64)
        total += np.bincount(place, minlength=texts * FEATURES)
    total = total.reshape(texts, FEATURES)
    total[:, _FIRST[3]] = words.counts  # how long a text is
    return total


@dataclass
class Model:
    idf: np.ndarray
    projection: np.ndarray  # features x dimensions
    vectors: np.ndarray  # labelled rows x dimensions, of unit length
    labels: np.ndarray
    prior: float

    def weighted(self, counted: np.ndarray) -> np.ndarray:
        return _weighted(counted) * self.idf

    def latent(self, counted: np.ndarray) -> np.ndarray:
        return _unit(self.weighted(counted) @ self.projection)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Share of label 1 in the vote of the nearest labelled vectors."""
        texts = len(offsets) - 1
        found = np.full(texts, self.prior)
        if not len(self.labels):
            return found
        for a in range(0, texts, BLOCK_ROWS):
            b = min(a + BLOCK_ROWS, texts)
            own = offsets[a : b + 1]
            counted = counts(data[own[0] : own[-1]], own - own[0])
            cosines = self.latent(counted) @ self.vectors.T
            k = min(NEIGHBOURS, len(self.labels))
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            last = np.take_along_axis(cosines, near, 1).min(1)
            for row in np.flatnonzero((cosines >= last[:, None]).sum(1) > k):  # equally near ones: in the order of the labelled rows
                near[row] = np.argsort(-cosines[row], kind="stable")[:k]
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** SHARPNESS
            total = weight.sum(1)
            vote = (weight * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
            found[a:b] = np.where((total > 0) & (counted[:, _FIRST[3]] > 0), vote, self.prior)
        return found


def _weighted(counted: np.ndarray) -> np.ndarray:
    """Logarithmic counts relative to the text's length; words weigh less than form."""
    length = np.maximum(counted[:, _FIRST[3] : _FIRST[3] + 1], 1)
    scaled = np.log1p(counted * (100 / length))
    scaled[:, _FIRST[3]] = np.log1p(counted[:, _FIRST[3]]) / 2
    for kind, share in ((0, WORD_SHARE), (1, 1.0), (2, 1.0)):
        part = scaled[:, _FIRST[kind] : _FIRST[kind + 1]]
        part *= share / np.maximum(np.sqrt((part**2).sum(1, keepdims=True)), 1e-6)
    scaled[:, _FIRST[3] :] /= 8
    return scaled


def _unit(rows: np.ndarray) -> np.ndarray:
    return (rows / np.maximum(np.sqrt((rows**2).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 9) -> Model:
    """Singular vectors of the sample by a randomised range finder, and the sample's own vectors."""
    if not len(labels):
        return Model(np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros((0, 1), np.float32), labels, 0.5)
    counted = np.concatenate([counts(*flat(texts[i : i + BLOCK_ROWS])) for i in range(0, len(texts), BLOCK_ROWS)])
    idf = np.log((1 + len(texts)) / (1 + (counted > 0).sum(0))).astype(np.float32) / 4 + 0.5
    matrix = _weighted(counted) * idf
    random = np.random.default_rng(seed)
    rank = min(DIMENSIONS, len(texts))
    basis = random.normal(size=(FEATURES, min(rank + 8, len(texts)))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(matrix.T @ (matrix @ basis))
    _, _, right = np.linalg.svd(matrix @ basis, full_matrices=False)
    projection = (basis @ right[:rank].T).astype(np.float32)
    return Model(idf, projection, _unit(matrix @ projection), labels.astype(np.float64), float(labels.mean()))


_WORKER: dict[str, Model] = {}


def scored(spark: SparkSession, docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """(`docs` with a struct column, its name): score and predicted of every whole text.

    Null, empty and blank texts, and texts unlike every labelled one, get the sample's share of label 1, as
    does every text without labels (then 0.5). The broadcast is bounded by the sample and fixed dimensions.
    """
    sent, key, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex, free_name(docs, "quality")

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = sent.value
        score = _WORKER[key].scores(data, offsets).round(6)  # the last bits depend on what else is in the batch
        return [score, (score >= THRESHOLD).astype(np.int32)]

    return annotated(docs, name, "score double, predicted int", work, PIECE_BYTES), name


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    given = labels.select("doc_id", "quality")
    return train(*sample(slim, given, "quality", ~held_out(5, 0), SAMPLE_ROWS, SAMPLE_BYTES))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; learned from rows that are not held out.

    Of equally near labelled rows those that come first in the sample vote. Rows that repeat a doc_id are scored each by
    its own text.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found, name = scored(spark, slim, fit(docs, labels))
    return found.select("doc_id", held_out(5, 0).alias("held_out"), f"{name}.score", f"{name}.predicted")


def drop_low_quality(spark: SparkSession, docs: DataFrame, source: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without documents predicted 0; the model is fitted to labelled rows of `source`."""
    found, name = scored(spark, docs, fit(source, labels))
    return found.where(F.col(f"{name}.predicted") == 1).select(*docs.columns)
