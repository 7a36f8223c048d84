"""Words of Arrow batches, hashed in bulk: the parts that several operators share.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Texts stay as the UTF-8 bytes of the Arrow buffer; no Python string is
made for a word. The hash of a word is a polynomial over its bytes modulo 2^64, mixed; it doesn't depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.cumprod(np.full(1024, _BASE, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row begins (one more at the end). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) else column.cast(kind)
    offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about `limit` bytes of text each; a longer text is a part of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


class Words:
    """Bounds and hashes of all words of a column. first[i] is the index of the first word of row i (one more at the end)."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.offs = buffers(column)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        inside = ~SPACE[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.offs] = True
        before = np.ones(n, bool)
        before[1:] = ~inside[:-1]
        self.starts = np.flatnonzero(inside & (before | cut[:n]))
        after = np.ones(n, bool)
        after[:-1] = ~inside[1:]
        self.ends = np.flatnonzero(inside & (after | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offs)

    def hashes(self, step: int = 1 << 20) -> np.ndarray:
        """A 64-bit hash of each word, computed in parts of about `step` bytes."""
        global _powers
        out = np.empty(len(self.starts), np.uint64)
        lens = self.ends - self.starts
        if len(lens) and lens.max() > len(_powers):
            _powers = np.cumprod(np.full(int(lens.max()), _BASE, np.uint64))
        ahead = np.concatenate([[0], np.cumsum(lens)])
        at = 0
        while at < len(out):
            end = max(at + 1, int(np.searchsorted(ahead, ahead[at] + step, "right")) - 1)
            own, begin = lens[at:end], ahead[at:end] - ahead[at]
            inner = np.arange(int(own.sum())) - np.repeat(begin, own)
            h = _BYTE[self.data[inner + np.repeat(self.starts[at:end], own)]]
            h *= _powers[inner]
            out[at:end] = np.add.reduceat(h, begin)
            at = end
        return mix(out + lens.astype(np.uint64))

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n words from each start at which a row has n words, and how many such starts precede each row."""
        counts = np.maximum(np.diff(self.first) - n + 1, 0)
        first = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(first[-1]) - np.repeat(first[:-1] - self.first[:-1], counts)
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h *= np.uint64(0xD6E8FEB86659FD93)
            h += hashes[at + k]
        return mix(h), first


def combined(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit key of several."""
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + p.astype(np.uint64))
    return h
