"""Words of whole texts as numpy arrays, hashed without a Python step per word.

Helpers for Arrow tasks: a batch of texts is cut into slices of bounded bytes, each slice becomes
one byte array, and prefix polynomial hashes give the hash of any span by one subtraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Avalanche of 64-bit values."""
    x = x ^ np.uint64((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_BYTE_CODES = mix(np.arange(256, dtype=np.uint64), 7)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
#: Letters, digits and every byte of a character beyond ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. n - 1, kept for the next slice."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


class Slice:
    """Some rows of a batch: their bytes in one array and the offsets of the rows."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def prefix_hashes(self) -> np.ndarray:
        """P with hash(s, e) = (P[e] - P[s]) * inverse ** s."""
        out = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODES[self.data] * powers(_BASE, len(self.data)), out=out[1:])
        return out

    def word_spans(self, in_word: np.ndarray = _IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of all maximal runs of word bytes, by default without white space.

        No run crosses rows.
        """
        inside = in_word[self.data]
        if not len(inside):
            return (np.zeros(0, dtype=np.int64),) * 3
        cut = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        opens[cut] = inside[cut]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        closes[cut - 1] = inside[cut - 1]
        starts = np.flatnonzero(opens)
        return starts, np.flatnonzero(closes) + 1, np.searchsorted(self.offsets, starts, "right") - 1


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal spans have equal hashes wherever they start."""
    return mix((prefix[ends] - prefix[starts]) * powers(_INVERSE, len(prefix))[starts])


def slices(texts: pa.Array, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Rows in slices of about ``limit`` bytes, one row at least; null texts are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    every = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + limit, "right")) - 1)
        part = every[ends[low] : ends[high]]
        yield Slice(low, _LOWER[part] if lower else part, ends[low : high + 1] - ends[low])
        low = high
