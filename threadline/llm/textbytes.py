"""Words, lines and hashes of many texts at once, as numpy arrays over the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

ODD = np.uint64(0x9E3779B97F4A7C15)
ODD2 = np.uint64(0xD6E8FEB86659FD93)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_utf8())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(32))) * ODD
    h = (h ^ (h >> np.uint64(29))) * ODD2
    return h ^ (h >> np.uint64(32))


_INVERSE = pow(int(ODD), -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1, modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out


class Spans:
    """Hashes of byte ranges of data: equal for equal bytes, from one pass over the data."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up = powers(int(ODD), n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(np.arange(256, dtype=np.uint64) + np.uint64(1))[data] * up, out=self.sums[1:])
        self.down = powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * ODD2)


#: Bytes of text that are hashed at once.
HASHED = 1 << 18


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What Spans(data).of(start, end) gives, for ranges that follow each other, in memory of a slice and not of all of data."""
    at = np.empty(2 * len(start), np.int64)
    at[0::2], at[1::2] = start, end
    sums = np.zeros(len(at), np.uint64)
    code, up, down = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1)), powers(int(ODD), min(HASHED, len(data))), powers(_INVERSE, min(HASHED, len(data) + 1))
    carry, lo = np.zeros(1, np.uint64), int(np.searchsorted(at, 1))
    first = np.zeros(len(start), np.uint64)
    for a in range(0, len(data), HASHED):
        part = np.cumsum(code[data[a : a + HASHED]] * up[: len(data) - a], dtype=np.uint64) * np.uint64(pow(int(ODD), a, 1 << 64)) + carry
        hi = int(np.searchsorted(at, a + len(part) + 1))
        sums[lo:hi] = part[at[lo:hi] - a - 1]
        x, y = np.searchsorted(start, [a, a + HASHED])
        first[x:y] = down[start[x:y] - a] * np.uint64(pow(_INVERSE, a, 1 << 64))
        carry, lo = part[-1:].copy(), hi
    return mixed((sums[1::2] - sums[0::2]) * first + (end - start).astype(np.uint64) * ODD2)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest ranges where inside holds, which never cross a row's border."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | border[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | border[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def table(pattern: str) -> np.ndarray:
    """Whether each byte value is in the character class, as bytes of UTF-8; all bytes of other characters count as in it."""
    import re

    one = re.compile(pattern)
    return np.array([b >= 128 or bool(one.fullmatch(chr(b))) for b in range(256)])


def chunks(batch: pa.RecordBatch, text: str, most: int = 4 << 20):
    """Slices of a batch with about `most` bytes of text each; one long text makes a slice of its own."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.zeros(len(column), np.int64)
    _, offsets = text_bytes(column)
    sizes = np.diff(offsets)
    if not len(sizes):
        return
    group = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        yield batch.slice(a, b - a)
