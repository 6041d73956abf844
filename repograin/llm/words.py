"""Words and hashes of whole Arrow text columns, a few numpy passes per byte and no loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts are worked off in runs of about this size; a longer text is a run of its own

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LETTERS = np.zeros(256, bool)  # ASCII letters, and all bytes of other letters
LETTERS[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    LETTERS[_c] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= 4 * CHUNK_BYTES:
            _powers[name] = have
    return have[:n]


@dataclass
class Run:
    """Neighbouring texts: their bytes one after the other, and where each begins (one entry more than texts)."""

    first: int  # row of the first text in its batch
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def starts(self) -> np.ndarray:
        """Marks the first byte of each non-empty text."""
        marks = np.zeros(len(self.data) + 1, bool)
        marks[self.offsets] = True
        return marks

    def bounds(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the maximal runs of bytes in the class ``inside`` (a table of 256), none across texts."""
        within = np.zeros(len(self.data) + 2, bool)
        within[1:-1] = inside[self.data]
        begin = np.flatnonzero(within[1:-1] & (~within[:-2] | self.starts[:-1]))
        end = np.flatnonzero(within[1:-1] & (~within[2:] | self.starts[1:])) + 1
        return begin, end

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        """The text, counted from 0, in which each byte position lies."""
        return np.searchsorted(self.offsets, positions, side="right") - 1


class Hasher:
    """64-bit hashes of any byte ranges of ``data`` in constant time each."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * _power("up", _BASE, len(data)), out=self.sums[1:])
        self.down = _power("down", _INVERSE, len(data) + 1)

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[begin]) * self.down[begin]
        return mix(raw + (end - begin).astype(np.uint64) * _BASE)


def runs(column: pa.Array, lower: bool = True, size: int = CHUNK_BYTES) -> Iterator[Run]:
    """The texts of a string column in runs of about ``size`` bytes; null is empty, A-Z become a-z on request."""
    texts = pa.concat_arrays([column.cast(pa.large_string())]) if column.null_count == 0 else column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        own = data[offsets[row] : offsets[upto]]
        yield Run(row, LOWER[own] if lower else own, offsets[row : upto + 1] - offsets[row])
        row = upto
