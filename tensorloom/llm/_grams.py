"""Texts as lower-case letters and single spaces, and hashed byte n-grams of these."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tensorloom.llm._blocks import U64, splitmix64

#: ASCII letters and all bytes above ASCII stay; every other byte becomes a space.
_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
_PLAIN[0x80:] = np.arange(0x80, 0x100)
_SEED = splitmix64(np.arange(256, dtype=U64) + U64(1 << 33))


def lowered(texts: pa.Array) -> pa.Array:
    """Lower-cased, with a space before and after each text."""
    blank = pa.scalar(" ", pa.large_string())
    return pc.binary_join_element_wise(blank, pc.utf8_lower(texts), blank, pa.scalar("", pa.large_string()))


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with runs of spaces made one space; every row begins with a space and has another at its end if it has letters."""
    data = _PLAIN[data]
    blank = data == 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    inner = offsets[:-1]
    keep[inner[inner < len(data)]] = True
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=sums[1:])
    return data[keep], sums[offsets]


def rolling(data: np.ndarray, lengths: tuple[int, ...]):
    """For each length n: hashes of the n bytes from each place; the last n-1 places hold hashes of fewer bytes."""
    h = np.zeros(len(data), U64)
    for n in range(1, max(lengths) + 1):
        # h[i] covers n bytes from i: prepend is impossible in place, so extend by the byte at i+n-1.
        tail = np.zeros(len(data), U64)
        if len(data) >= n:
            tail[: len(data) - n + 1] = _SEED[data[n - 1 :]]
        h = (h + tail) * U64(0x9FB21C651E98DF25)
        h ^= h >> U64(32)
        if n in lengths:
            yield n, h
