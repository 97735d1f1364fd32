"""Array helpers shared by the text operators: Arrow string columns seen as byte and word arrays.

Everything here works on one bounded chunk of one Arrow batch inside a Spark task; Spark partitions the work.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Bytes of text that are turned into arrays at once; a longer document is a chunk of its own.
CHUNK_BYTES = 400_000
CHUNK_ROWS = 4096

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_GRAM_FACTORS = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def released(work: Work) -> Work:
    """The same work over a task's batches; freed memory goes back to the system at the task's end, since the worker stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit hashes (a bijection), so that high and low bits depend on all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as (all bytes, offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch at row borders: (first row, end row, bytes, offsets), each of ``limit`` bytes and CHUNK_ROWS rows at most,
    or of one row."""
    raw, off = byte_view(batch.column(batch.schema.get_field_index(text)))
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, side="right")) - 1)
        end = min(end, row + CHUNK_ROWS)
        yield row, end, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def run_hashes(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of bytes at these places.

    Eight bytes at a time are scrambled together with their place in the run and summed up, so no swap or repeat of
    parts leaves the sum as it was.
    """
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    parts = (length + 7) >> 3
    begin = np.cumsum(parts) - parts
    place = np.arange(int(parts.sum()), dtype=np.int64) - np.repeat(begin, parts)
    rest = np.minimum(np.repeat(length, parts) - 8 * place, 8)
    value = eight[np.repeat(start, parts) + 8 * place] & _FIRST_BYTES[rest]
    part = mix(value ^ mix((place + 1).astype(np.uint64) * _BASE))
    return mix(np.add.reduceat(part, begin) + length.astype(np.uint64) * _BASE)


class Words:
    """Words of a chunk: maximal runs of bytes outside 0x20 and 0x09-0x0D, which never cross documents.

    ``start`` and ``length`` in bytes, ``doc`` is the row in the chunk, ``hash`` 64 bits of the word's bytes,
    ``first`` the index of each document's first word (one more entry at the end).
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        n_docs = len(off) - 1
        if not len(raw):
            empty = np.zeros(0, np.int64)
            self.start = self.length = self.doc = empty
            self.hash = np.zeros(0, np.uint64)
            self.inside = np.zeros(0, bool)
            self.first = np.zeros(n_docs + 1, np.int64)
            return
        inside = ~_SPACE[raw]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        cuts = off[:-1]
        before[cuts[cuts < len(raw)]] = False
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        cuts = off[1:] - 1
        after[cuts[cuts >= 0]] = False
        self.inside = inside
        self.start = np.flatnonzero(inside & ~before)
        self.length = np.flatnonzero(inside & ~after) - self.start + 1
        self.first = np.searchsorted(self.start, off).astype(np.int64)
        self.doc = np.repeat(np.arange(n_docs), np.diff(self.first))
        if not len(self.start):
            self.hash = np.zeros(0, np.uint64)
            return
        self.hash = run_hashes(raw, self.start, self.length)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and documents of all windows of n words; windows never cross documents."""
        if len(self.hash) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        size = len(self.hash) - n + 1
        h = self.hash[:size] * _GRAM_FACTORS[0]
        for i in range(1, n):
            h = h + self.hash[i : i + size] * _GRAM_FACTORS[i]
        whole = self.doc[:size] == self.doc[n - 1 :]
        return mix(h)[whole], self.doc[:size][whole]
