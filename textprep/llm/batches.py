"""Arrow batches as flat numpy arrays: words, fingerprints and ragged gathers, without a loop over characters.

Texts are handled as UTF-8 bytes. Every separator of the word rules is an ASCII byte, so words found on bytes
are the words found on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Texts are worked on in pieces of about this many bytes (one text is never cut), so that a task's memory is
# a small multiple of it plus the longest text.
CHUNK_BYTES = 1 << 19

_U = np.uint64
_MIX_1, _MIX_2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit generator: spreads every input bit over the word."""
    x = np.asarray(x, dtype=_U)
    x = (x ^ (x >> _U(30))) * _MIX_1
    x = (x ^ (x >> _U(27))) * _MIX_2
    return x ^ (x >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """`n` fixed 64-bit values of a seed, by the rule mixed(seed + i * golden ratio)."""
    with np.errstate(over="ignore"):
        start = _U(seed * 0x9E3779B97F4A7C15 % 2**64)
        return mixed(start + (np.arange(1, n + 1, dtype=_U)) * _U(0x9E3779B97F4A7C15))


_BYTE_VALUES = stream(1, 256)
_POWERS = np.ones(64, dtype=_U)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS)), _U(0x2545F4914F6CDD1D))
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


_POWERS = _powers(256)

_ALL = np.arange(256)
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)  # A-Z only
SPACED_WORD = ~((_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13)))  # [^\x20\x09-\x0D]
# [^\x00-\x2F\x3A-\x60\x7B-\x7F], to be used on lower-cased bytes
ALNUM_WORD = ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 128)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; at least one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def in_pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """(rows of the batch, bytes, offsets) for each piece of a batch."""
    data, offsets = text_bytes(batch.column(column))
    for first, last in pieces(offsets, limit):
        own = offsets[first : last + 1]
        yield batch.slice(first, last - first), data[own[0] : own[-1]], own - own[0]
    pa.default_memory_pool().release_unused()  # workers live on for the next stage


class Words:
    """Words of some texts: `hash`, `start` and `end` byte of each, and `offsets` into them for each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None = None):
        if fold is not None:
            data = fold[data]
        self.data = data
        inside = is_word[data]
        n = len(data)
        first_byte = np.zeros(n + 1, dtype=bool)
        first_byte[offsets] = True
        padded = np.zeros(n + 2, dtype=bool)
        padded[1:-1] = inside
        before, here = padded[:-1], padded[1:]
        self.start = np.flatnonzero(here & (~before | first_byte))
        self.end = np.flatnonzero(before & (~here | first_byte))
        self.offsets = np.searchsorted(self.start, offsets, side="left")
        self.length = self.end - self.start
        self.hash = fingerprints(data[inside], self.length)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def fingerprints(packed: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of byte strings that lie one after another in `packed`; none is empty."""
    if not len(lengths):
        return np.zeros(0, _U)
    firsts = np.cumsum(lengths) - lengths
    inner = np.arange(len(packed)) - np.repeat(firsts, lengths)
    values = _BYTE_VALUES[packed] * _powers(int(lengths.max()))[inner]
    return mixed(np.add.reduceat(values, firsts) + lengths.astype(_U))


def windows(hashes: np.ndarray, width: int, seed: int = 7) -> np.ndarray:
    """Fingerprint of the `width` values from each position on; `len - width + 1` of them, over all texts alike."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    weights = stream(seed, width) | _U(1)
    total = np.zeros(n, _U)
    for k in range(width):
        total += hashes[k : k + n] * weights[k]
    return mixed(total)


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... (counts[i] of them) for all i, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return np.arange(total) + shift


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit values as Spark's signed long."""
    return np.ascontiguousarray(x).view(np.int64)
