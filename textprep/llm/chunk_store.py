"""Encodes texts chunk by chunk, each distinct chunk once as long as it is remembered."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from textprep.llm.batches import spans


class ChunkStore:
    """Ids of chunks (byte strings); `encode(chunks)` gives (ids of all, how many each has) for unknown ones.

    When the store holds `limit` chunks, only those in use just then stay, so its size does not follow the data.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 500_000):
        self._encode, self._limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self._place: dict[bytes, int] = {}
        self._ids = np.zeros(1 << 16, np.uint32)
        self._starts, self._counts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self._used = 0

    def _learn(self, chunks: list[bytes]) -> None:
        self._add(chunks, *self._encode(chunks))

    def _add(self, chunks: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        first, last = len(self._place), len(self._place) + len(chunks)
        while last > len(self._starts):
            self._starts = np.resize(self._starts, 2 * len(self._starts))
            self._counts = np.resize(self._counts, 2 * len(self._counts))
        while self._used + len(ids) > len(self._ids):
            self._ids = np.resize(self._ids, 2 * len(self._ids))
        self._ids[self._used : self._used + len(ids)] = ids
        self._starts[first:last] = self._used + np.cumsum(counts) - counts
        self._counts[first:last] = counts
        self._place.update(zip(chunks, range(first, last), strict=True))
        self._used += len(ids)

    def _shrink(self, used: list[bytes]) -> None:
        stay = [c for c in used if c in self._place]
        place = np.fromiter(map(self._place.__getitem__, stay), np.int64, len(stay))
        counts = self._counts[place].astype(np.int64)
        ids = self._ids[spans(self._starts[place], counts)]
        self._clear()
        if stay:
            self._add(stay, ids, counts)

    def ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks one after another, how many each has)."""
        if not len(chunks):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self._place) + len(distinct) > self._limit:
            self._shrink(distinct)
        known = self._place
        fresh = [c for c in distinct if c not in known]
        if fresh:
            self._learn(fresh)
        place = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        place = place[coded.indices.to_numpy(zero_copy_only=False)]
        counts = self._counts[place].astype(np.int64)
        return self._ids[spans(self._starts[place], counts)], counts


_ALL = np.arange(256)
_LETTER = ((_ALL >= 65) & (_ALL <= 90)) | ((_ALL >= 97) & (_ALL <= 122))
_MARK = ((_ALL >= 33) & (_ALL <= 64)) | ((_ALL >= 91) & (_ALL <= 96)) | ((_ALL >= 123) & (_ALL <= 126))  # marks, digits
_MARK_CUT = _MARK & (_ALL != 39)  # an apostrophe may belong to the letters after it


def letter_edges(data: np.ndarray) -> np.ndarray:
    """Where an ASCII letter follows a mark (no apostrophe) or the reverse: patterns of letters, of digits and of marks end there."""
    edges = np.zeros(len(data), bool)
    if len(data) > 1:
        before, here = data[:-1], data[1:]
        edges[1:] = (_LETTER[before] & _MARK[here]) | (_MARK_CUT[before] & _LETTER[here])
    return edges


def chunks_at(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes from each start to the next (the last to the end)."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    )
