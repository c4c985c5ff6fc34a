"""Byte-level BPE by a monoid tree: halves are encoded recursively, neighbours joined at their boundary.

Join: the last i tokens of the left part and the first j of the right are encoded anew as one window. If its first
token is the left part's token at that place (or the left part is used up) and its last token the right part's, the window and
what lies outside form the encoding of the whole: a token sequence is the BPE encoding of its bytes exactly
if every two neighbouring tokens are that of theirs, inside the window they are by construction, and across its edges
the two tokens stood side by side before. Otherwise the unstable side of the window grows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from textprep.llm.annotate import annotated, free_name
from textprep.llm.batches import spans
from textprep.llm.chunk_store import ChunkStore, chunks_at, letter_edges

PIECE_BYTES = 1 << 20
# How many encoded chunks a worker remembers: some 200 bytes each; fewer take less memory and more time.
REMEMBERED = 400_000
_NONE = 1 << 62  # the rank of a pair that never merges
_SHORT = 24  # bytes: windows up to this are merged by plain search


class TreeEncoder:
    """Encodes byte strings under ranks (bytes to id, lower merges first)."""

    def __init__(self, ranks: dict[bytes, int], remembered: int = 200_000):
        self.ranks, self.remembered = ranks, remembered
        self._halves: dict[bytes, tuple[bytes, ...]] = {}
        self._windows: dict[bytes, tuple[bytes, ...]] = {}

    def _window(self, piece: bytes) -> tuple[bytes, ...]:
        """The tokens of a window; short ones recur at many boundaries and are remembered."""
        known = self._windows.get(piece)
        if known is None:
            known = tuple(self._merged(piece))
            if len(piece) <= _SHORT:
                if len(self._windows) >= self.remembered:
                    self._windows.clear()
                self._windows[piece] = known
        return known

    def _merged(self, piece: bytes) -> list[bytes]:
        """The lowest-ranked neighbours merge first, the leftmost of equals."""
        rank = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > _SHORT:
            return self._merged_long(parts)
        pairs = [rank(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
        while pairs and (best := min(pairs)) < _NONE:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], _NONE)
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], _NONE)
        return parts

    def _merged_long(self, parts: list[bytes]) -> list[bytes]:
        """As above with a queue of candidate pairs, n log n for a window that had to grow far."""
        n = len(parts)
        following, leading = [*range(1, n), -1], [*range(-1, n - 1)]
        current: list[bytes | None] = list(parts)
        queue = []

        def offer(i: int) -> None:
            j = following[i]
            if j >= 0:
                pair = current[i] + current[j]
                if (rank := self.ranks.get(pair)) is not None:
                    heapq.heappush(queue, (rank, i, len(pair)))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, size = heapq.heappop(queue)
            if current[i] is None or (j := following[i]) < 0 or len(current[i]) + len(current[j]) != size:
                continue
            current[i] += current[j]
            current[j] = None
            following[i] = following[j]
            if following[j] >= 0:
                leading[following[j]] = i
            offer(i)
            if leading[i] >= 0:
                offer(leading[i])
        return [p for p in current if p is not None]

    def join(self, left: tuple[bytes, ...], right: tuple[bytes, ...]) -> tuple[bytes, ...]:
        i = j = 1
        while True:
            window = self._window(left[-1] + right[0] if i == j == 1 else b"".join(left[-i:] + right[:j]))
            left_holds = i == len(left) or window[0] == left[-i]
            right_holds = j == len(right) or window[-1] == right[j - 1]
            if left_holds and right_holds:
                return left[:-i] + window + right[j:]
            if not left_holds:
                i = min(2 * i, len(left))
            if not right_holds:
                j = min(2 * j, len(right))

    def tokens(self, piece: bytes) -> tuple[bytes, ...]:
        """The token byte strings of a piece."""
        if len(piece) < 2:
            return (piece,) if piece else ()
        known = self._halves.get(piece)
        if known is None:
            if piece in self.ranks and len(piece) <= _SHORT:  # a leaf: as a rule one token
                return self._window(piece)
            half = len(piece) // 2
            known = self.join(self.tokens(piece[:half]), self.tokens(piece[half:]))
            if len(piece) <= 16:  # short halves recur in many words
                if len(self._halves) >= self.remembered:
                    self._halves.clear()
                self._halves[piece] = known
        return known

    def ids(self, piece: bytes) -> list[int]:
        return [self.ranks[t] for t in self.tokens(piece)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of chunks: every text, edges of letters, and every single blank between characters that are no white space.

    Before such a blank no match of the pattern can go on, and one starts at it, so chunks are matched separately. A
    byte that may belong to a wider white space character counts as white space: it only makes a chunk longer.
    """
    blank = data == 32
    before = np.zeros((3, len(data)), np.uint8)
    for k in range(3):
        before[k, k + 1 :] = data[: len(data) - k - 1] if len(data) > k + 1 else 0
    after = np.zeros(len(data), np.uint8)
    after[:-1] = data[1:]
    wide = _WIDE[before[2]] | (before[1] == 0xC2)  # the last byte of a character of two or three bytes
    safe = blank & ~_SPACE[before[0]] & ~((before[0] >= 0x80) & wide) & ~_SPACE[after] & ~_WIDE[after] & (after != 0xC2)
    safe |= letter_edges(data)
    safe[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(safe)


_SPACE = np.isin(np.arange(256), [0, 9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
_WIDE = np.isin(np.arange(256), [0xE1, 0xE2, 0xE3])


class _Tokens:
    """Encoder and decoder of a worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.encoder, self.pattern = TreeEncoder(ranks, remembered * 2 // 5), regex.compile(pattern)
        self.store = ChunkStore(self._encode_chunks, remembered)
        tokens = sorted(ranks, key=ranks.get)
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        sizes, order = np.array([len(t) for t in tokens], np.int64), np.array(sorted(ranks.values()))
        self.byte_start, self.byte_count = np.zeros(order[-1] + 1, np.int64), np.zeros(order[-1] + 1, np.int64)
        self.byte_start[order], self.byte_count[order] = np.cumsum(sizes) - sizes, sizes

    def _encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each match of the pattern is encoded separately, by the tree."""
        flat, counts = array("I"), []
        find, encode = self.pattern.findall, self.encoder.ids
        for chunk in chunks:
            before = len(flat)
            for match in find(chunk.decode("utf-8", "replace")):
                flat.extend(encode(match.encode()))
            counts.append(len(flat) - before)
        return np.array(flat, np.uint32), np.array(counts, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ends)."""
        starts = _cuts(data, offsets)
        ids, counts = self.store.ids(chunks_at(data, starts))
        running = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return ids, running[np.searchsorted(starts, offsets[1:])]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids one after another, how many each has): concatenation, the tree's other operation."""
        counts = self.byte_count[ids]
        return self.token_bytes[spans(self.byte_start[ids], counts)], counts


_WORKER: dict[str, _Tokens] = {}


def encoded(
    spark: SparkSession, docs: DataFrame, vocabulary: str, pattern: str, remembered: int = REMEMBERED
) -> tuple[DataFrame, str]:
    """(`docs` with a struct column, its name): ids, their number and sha256, and that of the decoded bytes.

    `vocabulary` is a file of ranks, read by the driver and broadcast (its size does not depend on the data). Null texts are
    empty and have no ids; every row is encoded, whatever it repeats. A match of any length is encoded by the tree.
    """
    sent, key, name = spark.sparkContext.broadcast(read_ranks(vocabulary)), uuid.uuid4().hex, free_name(docs, "tokens")

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = _Tokens(sent.value, pattern, remembered)
        tokens = _WORKER[key]
        ids, ends = tokens.encode(data, offsets)
        firsts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        plain, counts = tokens.decode(ids)
        reached = np.concatenate([[0], np.cumsum(counts)])
        flat, raw = ids.astype("<u4"), plain.data
        of_ids = [hashlib.sha256(flat[a:b].data).hexdigest() for a, b in zip(firsts, ends, strict=True)]
        of_text = [hashlib.sha256(raw[reached[a] : reached[b]]).hexdigest() for a, b in zip(firsts, ends, strict=True)]
        lists = pa.ListArray.from_arrays(np.append(firsts, len(ids)).astype(np.int32), pa.array(ids.astype(np.int32)))
        return [ends - firsts, of_ids, of_text, lists]

    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids array<int>"
    return annotated(docs, name, fields, work, PIECE_BYTES), name


def token_digests(spark: SparkSession, docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """One row per document, repeated rows included: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    coded, name = encoded(spark, slim, vocabulary, pattern)
    return coded.select("doc_id", f"{name}.n_tokens", f"{name}.ids_sha256", f"{name}.decoded_sha256")
