"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams per language come from a bounded sample of labelled rows and are summed by Spark; the driver gets
a matrix of languages x buckets for each 256 languages, takes logarithms and broadcasts it. Scoring hashes the n-grams
of a batch of texts and sums the log-probabilities of those that occur, a sparse product in numpy.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textprep.llm.annotate import annotated, free_name
from textprep.llm.batches import in_pieces, stream
from textprep.llm.labelled import held_out
from textprep.llm.tables import small_broadcast, written

GRAMS = (1, 2, 3)
BUCKET_BITS = 15
SMOOTHING = 0.5
# The bound of the sample: about this many rows of each language are counted, all their text.
SAMPLE_PER_LANGUAGE = 3000
LANGUAGES_AT_ONCE = 256  # of a model; any number is learned, in as many models as it takes
HELD_LANGUAGES = 64  # whose counters a task holds, 256 KB each; then it gives them out and begins anew
UNKNOWN = "und"
PIECE_BYTES = 1 << 19

_WEIGHTS = stream(31, max(GRAMS)) | np.uint64(1)
_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For every code point whether it is a letter; filled once in a worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text, has a letter): the hashed n-grams of lower-cased texts; runs of non-letters are one space."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in lowered], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = _is_letter()[points]
    lettered = np.zeros(len(texts), bool)
    lettered[owner[letter]] = True
    clean = np.where(letter, points, np.uint32(32)).astype(np.uint64)
    keep = np.ones(len(clean), bool)
    if len(clean):
        keep[1:] = letter[1:] | letter[:-1] | (owner[1:] != owner[:-1])
    clean, owner = clean[keep], owner[keep]
    buckets, owners = [], []
    for n in GRAMS:
        count = len(clean) - n + 1
        if count <= 0:
            continue
        value = clean[:count] * _WEIGHTS[0]
        for k in range(1, n):
            value = (value ^ (value >> np.uint64(29))) + clean[k : k + count] * _WEIGHTS[k]
        value *= np.uint64(0x9E3779B97F4A7C15)
        inside = owner[:count] == owner[n - 1 :]  # an n-gram never spans two texts
        buckets.append((value >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)[inside])
        owners.append(owner[:count][inside])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), lettered
    return np.concatenate(buckets), np.concatenate(owners), lettered


def _texts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    body = data.tobytes()
    return [body[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # languages x buckets, log-probabilities
    prior: np.ndarray

    def judged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the likeliest language, its logarithm, the sum of all relative to it, and whether there is a letter."""
        bucket, owner, lettered = grams(texts)
        totals = np.tile(self.prior[:, None], (1, len(texts)))
        for row, weights in zip(totals, self.weights, strict=True):
            row += np.bincount(owner, weights=weights[bucket], minlength=len(texts))
        if not self.languages:
            return np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.ones(len(texts)), np.zeros(len(texts), bool)
        best = totals.argmax(0)  # of equal ones the first in alphabetical order
        top = totals.max(0)
        return np.array(self.languages, object)[best], top, np.exp(totals - top).sum(0), lettered


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for rows, data, offsets in in_pieces(batch, "text", PIECE_BYTES):
            bucket, owner, _ = grams(_texts(data, offsets))
            names = np.array(rows.column("lang").to_pylist(), object)
            language = {name: i for i, name in enumerate(dict.fromkeys(names.tolist()))}
            numbers = np.array([language[x] for x in names.tolist()], np.int64)[owner]
            order = np.argsort(numbers, kind="stable")
            ends = np.searchsorted(numbers[order], np.arange(len(language) + 1))
            for name, i in language.items():
                found = bucket[order[ends[i] : ends[i + 1]]]
                if name not in totals and len(totals) >= HELD_LANGUAGES:
                    yield from _given_out(totals)
                    totals.clear()
                own = totals.setdefault(name, np.zeros(1 << BUCKET_BITS, np.int64))
                if len(found) > len(own) // 8:
                    own += np.bincount(found, minlength=len(own))
                else:
                    np.add.at(own, found, 1)
    yield from _given_out(totals)


def _given_out(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, own in totals.items():
        used = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(own[used], pa.int64())],
            ["lang", "bucket", "n"],
        )


def fit(docs: DataFrame, learned: Column) -> Iterator[Model]:
    """Models of LANGUAGES_AT_ONCE languages each, in alphabetical order, from the rows where `learned` holds.

    `docs` has the columns doc_id, text and lang. Priors are those among all languages; without any there is one empty model.
    """
    rows = docs.where(learned & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    of_language = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows")), "language-rows")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.join(small_broadcast(of_language), "lang").where(draw < SAMPLE_PER_LANGUAGE / F.col("n_rows")).select("text", "lang")
    counted = sample.mapInArrow(_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = written(counted, "language-counts")
    used = of_language.join(counted.select("lang").distinct(), "lang", "left_semi")
    sizes = {r["lang"]: r["n_rows"] for r in used.collect()}
    names, total = sorted(sizes), max(1, sum(sizes.values()))
    for first in range(0, max(1, len(names)), LANGUAGES_AT_ONCE):
        languages = names[first : first + LANGUAGES_AT_ONCE]
        counts = np.full((len(languages), 1 << BUCKET_BITS), SMOOTHING)
        if languages:
            table = counted.where(F.col("lang").between(languages[0], languages[-1])).toArrow()  # at most languages x buckets
            at = pc.index_in(table.column("lang"), value_set=pa.array(languages)).to_numpy()
            counts[at, table.column("bucket").to_numpy()] += table.column("n").to_numpy()
        prior = np.log(np.array([sizes[x] for x in languages], float) / total)
        yield Model(languages, np.log(counts / counts.sum(1, keepdims=True)), prior)


_MODELS: dict[str, Model] = {}


def _identified(spark: SparkSession, docs: DataFrame, model: Model, earlier: str | None) -> tuple[DataFrame, str]:
    """`docs` with the judgement of `model`, joined with that of the models before it in the column `earlier`."""
    sent, key, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex, free_name(docs, "language")

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list:
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = sent.value
        names, top, rest, lettered = _MODELS[key].judged(_texts(data, offsets))
        if earlier is not None:
            old_names, _, old_top, old_rest = rows.column(earlier).flatten()
            old_names, old_top, old_rest = np.array(old_names.to_pylist(), object), old_top.to_numpy(), old_rest.to_numpy()
            both = np.maximum(top, old_top)
            rest = rest * np.exp(top - both) + old_rest * np.exp(old_top - both)
            names, top = np.where(top > old_top, names, old_names), both
        return [pa.array(np.where(lettered, names, UNKNOWN), pa.string()), np.where(lettered, 1 / rest, 0.0), top, rest]

    found = annotated(docs, name, "lang_pred string, score double, top double, rest double", work, PIECE_BYTES)
    return (found if earlier is None else found.drop(earlier)), name


def identify(spark: SparkSession, docs: DataFrame, models: Iterator[Model]) -> tuple[DataFrame, str]:
    """(`docs` with a struct column, its name): lang_pred and score of each whole text.

    A null, empty or letterless text is `und` with score 0, as is every text when nothing was learned. Ties go to
    the first language in alphabetical order. The score is the posterior probability of the prediction among the languages
    of all models. Each model after the first is a pass over a written table, so a worker holds one model.
    """
    found, name = docs, None
    for model in models:
        if name is not None:
            found = written(found, "languages")
        found, name = _identified(spark, found, model, name)
    return found.withColumn(name, F.struct(f"{name}.lang_pred", f"{name}.score")), name


def predicted_languages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learned from rows that are not held out."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    named, name = identify(spark, docs.select("doc_id", "text"), fit(docs, ~held_out(3, 1)))
    return named.select("doc_id", held_out(3, 1).alias("held_out"), f"{name}.lang_pred", f"{name}.score")
