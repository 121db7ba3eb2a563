"""Positions drawn by hashing (seed, label, replicate, draw), many draws at a time.

A bootstrap takes one hash per draw, which an SQL engine spends most of its time on: it builds a text
and a digest object for each. Here the draws of many replicates are one numpy array, and the hash
runs over the array step by step. Modulo the number of values the results are the positions that
``conv(substring(md5(concat_ws('|', seed, label, replicate, draw)), 1, 8), 16, 10)`` and
``xxhash64(seed, label, replicate, draw)`` give in Spark SQL.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np

MESSAGES = 1 << 14

# Fixed values of MD5 (RFC 1321): start values, and the shifts of each round of sixteen steps.
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2.0**32).astype(np.uint32)

# Fixed values of XXH64: its primes.
_PRIMES = (
    0x9E3779B185EBCA87,
    0xC2B2AE3D27D4EB4F,
    0x165667B19E3779F9,
    0x85EBCA77C2B2AE63,
    0x27D4EB2F165667C5,
)


def _first_words(blocks: np.ndarray) -> np.ndarray:
    """First 32 bits, in text order, of the MD5 of one-block messages; ``blocks`` is 16 words by message."""
    a, b, c, d = (np.full(blocks.shape[1], x, dtype=np.uint32) for x in _START)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += blocks[g]
        f += _SINES[i]
        shift = np.uint32(_SHIFTS[turn][i % 4])
        f = (f << shift) | (f >> (np.uint32(32) - shift))
        f += b
        a, b, c, d = d, f, b, c
    a += np.uint32(_START[0])
    return a.byteswap()


def md5_draws(prefixes: Sequence[bytes], low: int, high: int) -> np.ndarray:
    """First eight hexadecimal digits, as a number, of md5(prefix + decimal draw).

    One row a prefix, one column a draw from ``low`` to ``high`` - 1.
    """
    out = np.empty((len(prefixes), high - low), dtype=np.int64)
    lengths = np.array([len(p) for p in prefixes])
    while low < high:
        # Draws with equally many digits, as many as one block of messages takes.
        digits = len(str(low))
        stop = min(high, 10**digits, low + MESSAGES)
        draws = np.arange(low, stop)
        text = (draws[:, None] // 10 ** np.arange(digits - 1, -1, -1) % 10 + 48).astype(np.uint8)
        columns = slice(out.shape[1] - (high - low), out.shape[1] - (high - stop))
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            if length + digits > 55:  # more than one block
                for row in rows:
                    whole = b"".join(md5(prefixes[row] + t.tobytes()).digest()[:4] for t in text)
                    out[row, columns] = np.frombuffer(whole, dtype=">u4")
                continue
            step = max(1, MESSAGES // len(draws))
            for first in range(0, len(rows), step):
                some = rows[first : first + step]
                message = np.zeros((len(some), len(draws), 64), dtype=np.uint8)
                heads = np.frombuffer(b"".join(prefixes[r] for r in some), dtype=np.uint8)
                message[:, :, :length] = heads.reshape(len(some), 1, length)
                message[:, :, length : length + digits] = text
                message[:, :, length + digits] = 0x80
                message[:, :, 56:58] = np.array([8 * (length + digits)], dtype="<u2").view(np.uint8)
                blocks = np.ascontiguousarray(message.reshape(-1, 64).view("<u4").T)
                out[some, columns] = _first_words(blocks).reshape(len(some), len(draws))
        low = stop
    return out


def xxhash64_draws(seeds: np.ndarray, low: int, high: int) -> np.ndarray:
    """XXH64 of each draw as a four-byte number under each seed, as Spark's ``xxhash64`` chains it."""
    p1, p2, p3, _, p5 = (np.uint64(p) for p in _PRIMES)
    draws = np.arange(low, high, dtype=np.uint64)
    h = seeds.astype(np.int64).view(np.uint64)[:, None] + p5 + np.uint64(4)
    h = h ^ (draws * p1)[None, :]
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)
