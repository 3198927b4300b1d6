"""Vectorised word access to Arrow text columns.

A word is a maximal run of bytes other than the six ASCII blanks
(0x20, 0x09-0x0D).  UTF-8 never uses those bytes inside a longer character,
so the split on bytes is the split on code points.  Everything here works on
one slice of a batch at a time, so memory follows ``SLICE_BYTES`` (or the one
longest text), never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
PIECE = 1 << 17  # bytes or words that are hashed at once, so that temporaries stay small however long a text is
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
FOLDED[[i for i in range(33, 127) if not chr(i).isalnum()]] = 0x20

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, 2 * PIECE), _powers(_BASE_INVERSE, 2 * PIECE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64; only a table of one size is kept."""
    return _kept_powers() if n < 2 * PIECE else (_powers(_BASE, n + 1), _powers(_BASE_INVERSE, n + 1))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text (one row at least)."""
    column_data = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column_data), 0), dtype=np.int64)
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > limit:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += int(n)
    if at < len(sizes):
        yield batch.slice(at)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its n+1 offsets; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """Words of one slice: byte bounds, row and 64-bit hash of each, in reading order."""

    def __init__(self, column: pa.Array, hashed: bool = True, fold: np.ndarray | None = None):
        """``fold`` maps each byte before the split: FOLDED lowers ASCII letters and takes punctuation for blanks."""
        data, offsets = text_bytes(column)
        if fold is not None:
            data = fold[data]
        self.data, self.offsets, self.rows = data, offsets, len(column)
        solid = ~BLANK[data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        first[cuts] = solid[cuts]
        before = cuts[cuts > 0] - 1
        last[before] = solid[before]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        self.row_from = np.searchsorted(self.row, np.arange(self.rows + 1))
        self.hash = self._hashes() if hashed else None

    def _hashes(self) -> np.ndarray:
        out, at = np.empty(len(self.starts), dtype=np.uint64), 0
        while at < len(out):
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + PIECE, side="right")))
            part = self.data[low : self.ends[to - 1]]
            up, down = powers(len(part))
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUES[part] * up[: len(part)], out=sums[1:])
            start = self.starts[at:to] - low
            out[at:to] = mix((sums[self.ends[at:to] - low] - sums[start]) * down[start])
            at = to
        return out

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.row_from)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each position on; positions too near the slice's end are left out."""
        out = np.zeros(max(0, len(self.hash) - n + 1), dtype=np.uint64)
        for at in range(0, len(out), PIECE):
            part = self.hash[at : at + PIECE + n - 1]
            up, down = powers(len(part))
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            out[at : at + PIECE] = mix((sums[n:] - sums[:-n]) * down[: len(sums) - n])
        return out

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from a position on belong to one row."""
        if len(self.row) < n:
            return np.zeros(0, dtype=bool)
        return self.row[n - 1 :] == self.row[: len(self.row) - n + 1]

    def raw(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()
