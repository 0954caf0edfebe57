"""Vectorised word hashing over Arrow string columns.

Words are runs of kept bytes (a 256-entry mask), A-Z folded to a-z. As every rule used here
keeps or drops all bytes of 0x80 and above alike, cutting UTF-8 bytes equals cutting code points.
A word's 64-bit hash comes from prefix sums of a polynomial in the byte position, so a whole
batch is hashed with a few numpy passes and no Python string is made.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 20  # bytes hashed at once; bounds the temporary arrays
SLICE = 4 << 20  # bytes of text taken from a batch at once


def _table(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63 - 1, n, dtype=np.uint64) * U(2) + U(1)


_BYTE = _table(11, 256)
_BYTE[65:91] = _BYTE[97:123]
_P = U(0x9E3779B97F4A7C15)
_PINV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MULT = _table(12, 64)


def _powers(base: U, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = U(1)
    return np.multiply.accumulate(out)


_POW = _powers(_P, CHUNK + 1)
_INV = _powers(_PINV, CHUNK + 1)


def mask(keep) -> np.ndarray:
    """A 256-entry mask from a predicate on byte values."""
    return np.fromiter((keep(b) for b in range(256)), dtype=bool, count=256)


NOT_SPACE = mask(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALNUM = mask(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the word."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row bounds) for slices of about SLICE bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    if len(column) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(at, at[row] + SLICE, side="right")) - 1)
        yield row, raw[at[row] : at[to]], at[row : to + 1] - at[row]
        row = to


class Words:
    """The words of consecutive texts: byte bounds, hashes and each text's range of words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, keep: np.ndarray):
        self.data = data
        kept = keep[data]
        before = np.empty_like(kept)
        before[1:] = kept[:-1]
        first = bounds[:-1][bounds[:-1] < len(data)]
        before[first] = False
        if len(kept):
            before[0] = False
        self.starts = np.flatnonzero(kept & ~before)
        after = np.zeros_like(kept)
        after[:-1] = kept[1:]
        after[first[first > 0] - 1] = False
        self.ends = np.flatnonzero(kept & ~after) + 1
        self.of = np.searchsorted(self.starts, bounds)  # words of text i: of[i] to of[i + 1]
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=np.uint64)
        i = 0
        while i < len(out):
            base = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, base + CHUNK, side="right")))
            part = self.data[base : self.ends[j - 1]]
            if len(part) > CHUNK:  # one word longer than a chunk: fold it piece by piece
                total = np.full(1, len(part), dtype=np.uint64)
                for k in range(0, len(part), CHUNK):
                    piece = _BYTE[part[k : k + CHUNK]]
                    total = mix(total * _P + (piece * _POW[: len(piece)]).sum(dtype=np.uint64))
                out[i] = total[0]
            else:
                sums = np.zeros(len(part) + 1, dtype=np.uint64)
                np.cumsum(_BYTE[part] * _POW[: len(part)], out=sums[1:])
                s, e = self.starts[i:j] - base, self.ends[i:j] - base
                out[i:j] = (sums[e] - sums[s]) * _INV[s]
            i = j
        return mix(out)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j, folded and joined by single spaces."""
        return b" ".join(self.data[s:e].tobytes().lower() for s, e in zip(self.starts[i:j], self.ends[i:j], strict=True))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words (over text borders too; callers cut those)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, U(k))
    for j in range(k):
        out += hashes[j : j + n] * _MULT[j]
    return mix(out)


def shingle_set(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingle hashes of one text; fewer words make one shingle, none makes none."""
    if len(hashes) == 0:
        return hashes
    return np.unique(grams(hashes, min(k, len(hashes))))


def shingle_sets(column, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) for every row of a string column."""
    for row, data, bounds in texts(column):
        words = Words(data, bounds, NOT_SPACE)
        full = grams(words.hashes, k)
        for i in range(len(bounds) - 1):
            a, b = words.of[i], words.of[i + 1]
            yield row + i, np.unique(full[a : b - k + 1]) if b - a >= k else shingle_set(words.hashes[a:b], k)


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on after its task, beside the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
