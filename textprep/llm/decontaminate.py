"""Benchmark decontamination: suffix arrays over shards of the training texts, searched for every test suffix.

A shard is a piece of about a megabyte of documents. Of its suffixes (word positions) the array keeps those whose
first two words stand side by side somewhere in the benchmark: no other suffix can start a match of two words. They
are sorted by their first 13 words; each test suffix is then found by binary search, and matches that continue one
another (the same distance between item and document position) join to the longest verbatim match.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from textprep.llm.annotate import annotated, free_name
from textprep.llm.batches import ALNUM_WORD, LOWER, Words, mixed, spans, text_bytes
from textprep.llm.tables import written

WINDOW = 13
PERCENT_PARTS = 20  # a document is contaminated when at least one word in 20 is hit
SHARD_BYTES = 1 << 20
# The benchmark is sent to all tasks in blocks of at most this many bytes of text.
BLOCK_BYTES = 32 << 20

_FOUND = "array<struct<item_id:bigint,item_word:int,doc_word:int,n_words:int>>"


class TestSuffixes:
    """The suffixes of a block of benchmark items as numbers, for searching."""

    def __init__(self, item_ids: list, texts: list):
        known = [(i, t) for i, t in zip(item_ids, texts, strict=True) if i is not None]
        self.ids = np.array([i for i, _ in known], np.int64)
        words = Words(*text_bytes(pa.array([t for _, t in known], pa.string())), ALNUM_WORD, LOWER)
        self.vocabulary = np.unique(words.hash)
        codes = np.searchsorted(self.vocabulary, words.hash) + 1
        counts = words.counts
        length = np.minimum(counts, WINDOW)  # of the item's windows
        room = np.where(counts > 0, counts - length + 1, 0)
        starts = spans(words.offsets[:-1], room)
        self.item = np.repeat(np.arange(len(counts)), room)
        self.place = starts - words.offsets[self.item]
        self.length = length[self.item]
        inside = np.arange(WINDOW)[None, :] < self.length[:, None]
        padded = np.append(codes, np.zeros(WINDOW, codes.dtype))
        rows = np.where(inside, padded[starts[:, None] + np.arange(WINDOW)], 0) if len(starts) else np.zeros((0, WINDOW), int)
        # equal suffixes are searched once
        distinct, self.row = np.unique(rows, axis=0, return_inverse=True)
        self.row = self.row.ravel()
        self.distinct_length = (distinct > 0).sum(1)
        self.low = _as_bytes(distinct)
        self.high = _as_bytes(np.where(distinct > 0, distinct, 2**32 - 1))
        two = self.length >= 2
        self.pairs = np.unique(_pair(rows[two, 0], rows[two, 1])) if len(rows) else np.zeros(0, np.uint64)
        self.singles = np.unique(rows[~two, 0]) if len(rows) else np.zeros(0, int)
        self._filter = np.zeros(1 << 20, bool)
        self._filter[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        self._pair_filter = np.zeros(1 << 22, bool)
        self._pair_filter[(self.pairs >> np.uint64(42)).astype(np.int64)] = True

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """1 + place in the vocabulary, or 0 for a word that the benchmark has not."""
        codes = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self._filter[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        same = self.vocabulary[at] == hashes[maybe] if len(self.vocabulary) else np.zeros(0, bool)
        codes[maybe[same]] = at[same] + 1
        return codes

    def _retained(self, codes: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Positions whose suffix can start a match."""
        at = np.flatnonzero(codes[:-1] * codes[1:]) if len(codes) > 1 else np.zeros(0, np.int64)
        at = at[at + 1 < end[at]]
        pair = _pair(codes[at], codes[at + 1])
        near = self._pair_filter[(pair >> np.uint64(42)).astype(np.int64)]
        at = at[near][np.isin(pair[near], self.pairs)]
        if len(self.singles):
            at = np.union1d(at, np.flatnonzero(np.isin(codes, self.singles)))
        return at

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(test suffix, position, words): every occurrence of a window in the shard."""
        none = np.zeros(0, np.int64)
        if not len(self.row) or not len(words):
            return none, none, none
        codes = self.codes(words.hash)
        end = np.repeat(words.offsets[1:], words.counts)
        at = self._retained(codes, end)
        if not len(at):
            return none, none, none
        padded = np.append(codes, np.zeros(WINDOW, np.int64))
        rows = padded[at[:, None] + np.arange(WINDOW)]
        rows[at[:, None] + np.arange(WINDOW) >= end[at][:, None]] = 0
        keys = _as_bytes(rows)
        order = np.argsort(keys, kind="stable")
        array, at = keys[order], at[order]
        low = np.searchsorted(array, self.low, side="left")
        high = np.searchsorted(array, self.high, side="right")
        counts = np.maximum(high - low, 0)[self.row]
        suffix = np.repeat(np.arange(len(self.row)), counts)
        place = at[spans(low[self.row], counts)]
        return suffix, place, self.length[suffix]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed((a.astype(np.uint64) << np.uint64(32)) + b.astype(np.uint64))


def _as_bytes(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort alike."""
    flat = np.ascontiguousarray(rows.astype(">u4"))
    return flat.view(f"S{4 * WINDOW}").ravel()


def _search(tests: TestSuffixes, words: Words) -> tuple[np.ndarray, ...]:
    """Longest matches (document row, item row, item word, document word, words), sorted by row."""
    suffix, place, length = tests.matches(words)
    text = np.searchsorted(words.offsets, place, side="right") - 1
    item, item_word, doc_word = tests.item[suffix], tests.place[suffix], place - words.offsets[text]
    order = np.lexsort((doc_word, doc_word - item_word, item, text))
    text, item, item_word, doc_word, length = (x[order] for x in (text, item, item_word, doc_word, length))
    if not len(text):
        return text, item, item_word, doc_word, length
    new = np.ones(len(text), bool)
    same = (text[1:] == text[:-1]) & (item[1:] == item[:-1])
    new[1:] = ~(same & (doc_word[1:] == doc_word[:-1] + 1) & (item_word[1:] == item_word[:-1] + 1))
    firsts = np.flatnonzero(new)
    runs = np.diff(np.append(firsts, len(text)))
    return text[firsts], item[firsts], item_word[firsts], doc_word[firsts], length[firsts] + runs - 1


def benchmark_blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark's items in blocks of at most about BLOCK_BYTES of text, by the hash of the item."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    place = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    return [benchmark.where(place == n) if blocks > 1 else benchmark for n in range(blocks)]


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, str]:
    """(`docs` with one more column, its name): a struct of the contamination of each text.

    Its fields: n_words; n_hit, the words inside an occurrence of a window; item_ids, the sorted distinct ids of
    items with occurring windows; contaminated (n_hit > 0 and 20 * n_hit >= n_words); longest, the words of the longest match;
    found, the longest matches themselves (item_id, item_word, doc_word, n_words).

    A window is 13 consecutive words of an item, or all words of a shorter one. A null, empty or wordless text has
    no words and no hit; so has a wordless item. Items without id are not searched; items that repeat an id
    count as one. Without items nothing is contaminated. Rows stay as they are, repeated ones too.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks, name = benchmark_blocks(items), free_name(docs, "contamination")
    for n, block in enumerate(blocks):
        rows = block.collect()  # at most BLOCK_BYTES of text
        tests = spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))
        before = name if n else None
        if n:  # a later block: go on from what earlier ones found, computed once
            docs = written(docs, f"contamination-{n}").withColumnRenamed(name, free_name(docs, "earlier"))
            before = docs.columns[-1]
        docs = annotated(
            docs, name,
            f"n_words bigint, n_hit bigint, item_ids array<bigint>, contaminated boolean, longest int, found {_FOUND}",
            _worker(tests, before), SHARD_BYTES,
        )
        if before:
            docs = docs.drop(before)
    return docs, name


_PREPARED: dict[str, TestSuffixes] = {}  # of this Python worker, for its tasks


def _worker(tests, before: str | None):
    key = uuid.uuid4().hex

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list:
        if key not in _PREPARED:
            _PREPARED.clear()
            _PREPARED[key] = TestSuffixes(*tests.value)
        suffixes = _PREPARED[key]
        words = Words(data, offsets, ALNUM_WORD, LOWER)
        text, item, item_word, doc_word, length = _search(suffixes, words)
        ids = suffixes.ids[item] if len(item) else item
        if before:
            earlier = rows.column(before).field("found")
            counts = pc.list_value_length(earlier).to_numpy(zero_copy_only=False)
            flat = earlier.flatten()
            old = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(4)]
            text = np.concatenate([text, np.repeat(np.arange(len(counts)), counts)])
            order = np.argsort(text, kind="stable")
            text = text[order]
            ids, item_word, doc_word, length = (
                np.concatenate([a, b])[order] for a, b in zip((ids, item_word, doc_word, length), old, strict=True)
            )
        n = len(words.counts)
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, words.offsets[text] + doc_word, 1)
        np.add.at(change, words.offsets[text] + doc_word + length, -1)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
        n_hit = hit[words.offsets[1:]] - hit[words.offsets[:-1]]
        lists = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, text, length)
        own = [sorted({int(i) for i in ids[a:b]}) for a, b in zip(lists[:-1], lists[1:], strict=True)]
        found = pa.StructArray.from_arrays(
            [pa.array(ids, pa.int64()), *(pa.array(x, pa.int32()) for x in (item_word, doc_word, length))],
            names=["item_id", "item_word", "doc_word", "n_words"],
        )
        contaminated = (n_hit > 0) & (PERCENT_PARTS * n_hit >= words.counts)
        return [words.counts, n_hit, own, contaminated, longest, pa.ListArray.from_arrays(lists, found)]

    return work


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, found."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found, name = matches(spark, slim, benchmark)
    listed = F.array_join(F.array_sort(F.transform(F.col(f"{name}.item_ids"), lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        f"{name}.n_words",
        f"{name}.n_hit",
        F.size(f"{name}.item_ids").cast("bigint").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        f"{name}.contaminated",
        f"{name}.longest",
        f"{name}.found",
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without contaminated documents; all columns and all other rows stay as they are."""
    found, name = matches(spark, docs, benchmark)
    return found.where(~F.col(f"{name}.contaminated")).select(*docs.columns)
