"""Arrow text columns as byte blocks, and hashes of byte ranges, vectorised with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: About the bytes of text that one numpy pass covers; a longer single text makes a block of its own.
BLOCK_BYTES = 1 << 20

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E6C63D0876A9A35 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def splitmix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public SplitMix64 generator."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUE = splitmix64(np.arange(256, dtype=U64) * U64(0x632BE59BD9B4E019) + U64(77))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, BLOCK_BYTES + 1)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=U64))
        return cls.up[:n], cls.down[:n]


class RangeHash:
    """64-bit hashes of any byte ranges of one block in constant time each, equal for equal bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _Powers.get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_VALUE[data] * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return splitmix64(raw ^ ((end - start).astype(U64) << U64(48)))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The named column as strings without nulls (null counts as empty)."""
    column = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def byte_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their UTF-8 bytes, offsets of the rows in these) with about ``limit`` bytes each."""
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def strings_at(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow binary array, copied; ranges ascend and don't overlap."""
    lengths = end - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    take = np.zeros(len(data) + 1, np.int8)
    full = lengths > 0
    np.add.at(take, start[full], 1)
    np.add.at(take, end[full], -1)
    own = data[np.cumsum(take[:-1], dtype=np.int8) > 0]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(own))])


def numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Of each byte range the number of its content, equal exactly where the bytes are equal, and the contents by number."""
    coded = strings_at(data, start, end).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and of each row the index of its first word (one more at the end)."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~SPACE[data]
    begins = solid[1:-1] & ~solid[:-2]
    stops = solid[1:-1] & ~solid[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = solid[1:-1][inner]
    stops[inner - 1] = solid[1:-1][inner - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(stops) + 1, np.searchsorted(start, offsets)


def tally(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` within each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
