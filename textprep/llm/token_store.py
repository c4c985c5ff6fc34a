"""Token ids in directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the low chunk of every id and a bitmap that says whether the
id goes on; level 1 holds the next chunk of those that do, and so on. A rank directory (the number of set bits before every
512th bit) finds an id's place on the next level, so that any token is read without decoding a block.

Segment: b"DAC1", then little-endian u32 documents, u64 tokens, u32 levels; i64 document ids, u8 marks of
null ids, u64 ends (tokens up to and with each document); per level u64 codes, the chunk bytes, the bitmap (bit i of byte
i // 8, from the low end), the u64 ranks; u32 crc of all before. Segments are rows of Parquet files, in ascending order of document.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from textprep.llm.batches import LOWER, SPACED_WORD, in_pieces
from textprep.llm.chunk_store import ChunkStore, chunks_at, letter_edges
from textprep.session import shared_path

END_ID = 2
SEGMENT_BYTES = 4 << 20  # of text
RANK_STEP = 512
MAGIC = b"DAC1"
_SEGMENT = "part int, segment int, first_doc bigint, last_doc bigint, start_in_part bigint, n_tokens bigint, codes binary"


# -- the code -------------------------------------------------------------------------------------------------------


def _level(codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bytes of one level, the rest of the ids that go on)."""
    more = codes > 0xFF
    bits = np.packbits(more, bitorder="little")
    padded = np.zeros(-(-len(more) // RANK_STEP) * RANK_STEP, bool)
    padded[: len(more)] = more
    per_step = padded.reshape(-1, RANK_STEP).sum(1)
    ranks = (np.cumsum(per_step) - per_step).astype("<u8")
    body = struct.pack("<Q", len(codes)) + (codes & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes()
    return body, codes[more] >> 8


def encode_segment(doc_ids: list, ends: np.ndarray, ids: np.ndarray) -> bytes:
    levels, rest = [], np.asarray(ids, np.uint32)
    while len(rest):
        body, rest = _level(rest)
        levels.append(body)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    head = MAGIC + struct.pack("<IQI", len(doc_ids), len(ids), len(levels))
    body = b"".join([head, known.tobytes(), nulls.tobytes(), np.asarray(ends, "<u8").tobytes(), *levels])
    return body + struct.pack("<I", zlib.crc32(body))


class Segment:
    """A segment read back: all ids of a document, or any single token."""

    def __init__(self, codes: bytes):
        if codes[:4] != MAGIC or zlib.crc32(codes[:-4]) != struct.unpack("<I", codes[-4:])[0]:
            raise ValueError("not a segment, or a damaged one")
        docs, self.n_tokens, levels = struct.unpack_from("<IQI", codes, 4)
        at = 20
        known = np.frombuffer(codes, "<i8", docs, at).tolist()
        nulls = np.frombuffer(codes, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if gone else d for d, gone in zip(known, nulls, strict=True)]
        self.ends = np.frombuffer(codes, "<u8", docs, at + 9 * docs).astype(np.int64)
        at += 17 * docs
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", codes, at)
            at += 8
            chunks = np.frombuffer(codes, np.uint8, n, at)
            bits = np.frombuffer(codes, np.uint8, -(-n // 8), at + n)
            steps = -(-n // RANK_STEP)
            ranks = np.frombuffer(codes, "<u8", steps, at + n + len(bits))
            at += n + len(bits) + 8 * steps
            self.levels.append((chunks, bits, ranks))

    def token(self, i: int) -> int:
        """The i-th token of the segment, by one look at each level."""
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            step = i // RANK_STEP
            before = bits[step * (RANK_STEP // 8) : i >> 3]
            i = int(ranks[step]) + int(np.bitwise_count(before).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            shift += 8
        return value

    def ids(self) -> np.ndarray:
        """All ids of the segment."""
        values: np.ndarray | None = None
        for chunks, bits, _ in reversed(self.levels):
            own = chunks.astype(np.uint32)
            if values is not None:
                more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
                own[more] |= values << np.uint32(8)
            values = own
        return np.zeros(0, np.uint32) if values is None else values


# -- tokens ---------------------------------------------------------------------------------------------------------


def _packed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(the runs without ASCII white space, cut where letters and marks meet, and how many each text has).

    Upper-case ASCII letters are folded, as the tokenizer does. Neither is done where "<|" may begin an added token.
    """
    plain = b"<|" not in data.tobytes()
    if plain:
        data = LOWER[data]
    inside = SPACED_WORD[data]
    cut = letter_edges(data) if plain else np.zeros(len(data), bool)
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    padded = np.zeros(len(data) + 2, bool)
    padded[1:-1] = inside
    before, here = padded[:-1], padded[1:]
    cut = np.append(cut, True)
    start = np.flatnonzero(here & (~before | cut))
    end = np.flatnonzero(before & (~here | cut))
    length = end - start
    return chunks_at(data[inside], np.cumsum(length) - length), np.diff(np.searchsorted(start, offsets))


class WordTokens:
    """Ids of texts under a tokenizer for which no token crosses ASCII white space; a word is encoded once.

    Many words are encoded in one call, with an added token of the tokenizer between them, which is cut out again.
    """

    PER_CALL = 512

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(definition)
        added = json.loads(definition).get("added_tokens") or []
        self._mark = next((t for t in added if not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])), None)
        self._store = ChunkStore(self._encode_words)

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in words]
        if self._mark is None or any("<|" in t or self._mark["content"] in t for t in texts):
            marked = self._mark is None
            odd = np.array([marked or "<|" in t or self._mark["content"] in t for t in texts])
            counts, parts = np.zeros(len(texts), np.int64), {}
            plain = np.flatnonzero(~odd)
            if len(plain):
                ids, n = self._joined([texts[i] for i in plain])
                counts[plain] = n
                parts |= dict(zip(plain.tolist(), np.split(ids, np.cumsum(n)[:-1]), strict=True))
            for i in np.flatnonzero(odd):
                one = np.array(self._tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
                counts[i], parts[int(i)] = len(one), one
            return np.concatenate([parts[i] for i in range(len(texts))]), counts
        return self._joined(texts)

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        content, mark = self._mark["content"], self._mark["id"]
        calls = [content.join(texts[i : i + self.PER_CALL]) + content for i in range(0, len(texts), self.PER_CALL)]
        found = self._tokenizer.encode_batch_fast(calls, add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        marks = np.flatnonzero(flat == mark)
        return flat[flat != mark], np.diff(marks, prepend=-1) - 1

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with END_ID after each, ends)."""
        words, per_text = _packed_words(data, offsets)
        ids, counts = self._store.ids(words)
        running = np.concatenate([[0], np.cumsum(counts)])
        texts = np.concatenate([[0], np.cumsum(per_text)])
        ends = running[texts[1:]] + np.arange(1, len(offsets))
        out = np.full(len(ids) + len(per_text), END_ID, np.uint32)
        body = np.ones(len(out), bool)
        body[ends - 1] = False
        out[body] = ids
        return out, ends


_TOKENS: dict[str, WordTokens] = {}


# -- files ----------------------------------------------------------------------------------------------------------


def white_space_splits(definition: str) -> bool:
    """Whether the tokenizer drops white space and case, so that words can be encoded one by one."""
    steps = json.loads(definition).get("pre_tokenizer") or {}
    if "Lowercase" not in json.dumps(json.loads(definition).get("normalizer")):
        return False
    steps = steps.get("pretokenizers", [steps])
    first = steps[0] if steps else {}
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and "\\s" in json.dumps(first)


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, path: str) -> None:
    """Write the ids of every whole text, in ascending doc_id order, as segments below `path`.

    `tokenizer` is the file of a tokenizer that drops white space. Null texts are empty; rows without doc_id come first;
    rows that repeat a doc_id are ordered by the hash of their text. Documents are range-partitioned by
    doc_id: a partition is one run of the order, a segment a few megabytes of it.
    """
    with open(tokenizer, encoding="utf-8") as file:
        definition = file.read()
    if not white_space_splits(definition):
        raise ValueError("the tokenizer keeps white space: its words can't be encoded one by one")
    sent, key = spark.sparkContext.broadcast(definition), uuid.uuid4().hex

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, start = TaskContext.get().partitionId(), 0, 0
        if key not in _TOKENS:
            _TOKENS.clear()
            _TOKENS[key] = WordTokens(sent.value)
        for batch in batches:
            for rows, data, offsets in in_pieces(batch, "text", SEGMENT_BYTES):
                ids, ends = _TOKENS[key].encode(data, offsets)
                doc_ids = rows.column("doc_id").to_pylist()
                row = (part, segment, doc_ids[0], doc_ids[-1], start, len(ids), encode_segment(doc_ids, ends, ids))
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = [f.split()[0] for f in _SEGMENT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)
                segment, start = segment + 1, start + len(ids)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(encode, _SEGMENT).write.option("compression", "none").parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with `start`, the number of tokens before each.

    The running total is over one row per written partition; within a partition the writer has kept it.
    """
    rows = spark.read.schema(_SEGMENT).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("part").alias("of_part"), F.coalesce(before, F.lit(0)).alias("before"))
    joined = rows.join(F.broadcast(parts), F.col("part") == F.col("of_part"))  # a row per partition
    return joined.withColumn("start", F.col("before") + F.col("start_in_part")).drop("of_part", "before")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian u32) of every document in the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, codes in zip(batch.column("start").to_pylist(), batch.column("codes"), strict=True):
                segment = Segment(codes.as_py())
                ids = segment.ids().astype("<u4")
                firsts = np.concatenate([[0], segment.ends[:-1]])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(firsts, segment.ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(segment.doc_ids, pa.int64()),
                        pa.array(start + firsts, pa.int64()),
                        pa.array(segment.ends - firsts, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = segments(spark, path).select("start", "codes")
    return rows.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_tokens(spark: SparkSession, path: str, first: int, count: int) -> list[int]:
    """`count` tokens of the corpus from the token number `first` on: only their segments are fetched."""
    end = first + count
    rows = segments(spark, path).where((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > first))
    found: list[int] = []
    for row in rows.orderBy("start").toLocalIterator():
        segment = Segment(bytes(row["codes"]))
        found += [segment.token(i - row["start"]) for i in range(max(first, row["start"]), min(end, row["start"] + row["n_tokens"]))]
    return found


def stored_documents(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files of `docs` to a new folder in the shared one, and read them back."""
    path = shared_path(spark, "llm-tokens")
    write_tokens(spark, docs, tokenizer, path)
    return read_documents(spark, path)
