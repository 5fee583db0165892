"""Whole batches of texts as numpy arrays: words, their hashes and sums by document.

A batch is cut into chunks of whole documents; within a chunk every step is one numpy call over all bytes or words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_K = np.uint64(0x9E3779B97F4A7C15)

#: True for the bytes that end a word: space and tab to carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def members(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Murmur's 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes, in order."""
    return mix(a * _K + (b ^ (b >> np.uint64(29))))


class Chunk:
    """Documents first..first+n of a batch: data holds their UTF-8 bytes, offsets where each begins and ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int = 0):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1
        self.padded = np.concatenate([data, np.zeros(16, np.uint8)])

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Of a flag by byte, for each document."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def words(self, ends_word: np.ndarray = WHITE) -> Words:
        return Words(self, ends_word)

    def loads(self) -> np.ndarray:
        """The eight bytes from each position, as a little-endian number."""
        return np.ndarray((len(self.padded) - 7,), "<u8", self.padded, strides=(1,))


class Words:
    """The words of a chunk: where each starts and ends, and by document the first word and the one after the last."""

    def __init__(self, chunk: Chunk, ends_word: np.ndarray):
        self.chunk, data, offsets = chunk, chunk.data, chunk.offsets
        white = ends_word[data]
        before = np.empty(len(data) + 1, bool)
        before[1:] = white
        before[offsets] = True
        after = np.empty(len(data) + 1, bool)
        after[:-1] = white
        after[offsets] = True
        self.white = white
        self.starts = np.flatnonzero(~white & before[:-1])
        self.ends = np.flatnonzero(~white & after[1:]) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(self.chunk.n), self.counts)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of a value by word, for each document."""
        total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every process."""
        loads, lengths = self.chunk.loads(), self.ends - self.starts
        h = mix(lengths.astype(np.uint64) * _K + np.uint64(1))
        left, at, active = lengths, self.starts, slice(None)
        while len(left):
            got = loads[at]
            short = left < 8
            got[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            h[active] = joined(h[active], got)
            more = np.flatnonzero(left > 8)
            active = more if isinstance(active, slice) else active[more]
            left, at = left[more] - 8, at[more] + 8
        return h

    def windows(self, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each window of that many words of one document begins, and its hash."""
        if len(h) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        out, done = None, 0
        part, width = h, 1
        while True:
            if size & width:
                here = part[done:]
                out = here if out is None else joined(out[: len(here)], here[: len(out)])
                done += width
            if done == size:
                break
            part = joined(part[:-width], part[width:])
            width *= 2
        out = out[: len(h) - size + 1]
        left = np.repeat(self.bounds[1:], self.counts)[: len(out)] - np.arange(len(out))
        at = np.flatnonzero(left >= size)
        return at, out[at]


def covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Flags of the n positions within width of one in at."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + width, n), -1)
    return np.cumsum(step[:-1]) > 0


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string or binary column into chunks of whole values; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield Chunk(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], at)
        at = end
    pa.default_memory_pool().release_unused()
