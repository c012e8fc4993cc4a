"""Vectorised text kernels that run inside tasks: word and n-gram fingerprints of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

U = np.uint64
_ODD = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))
_BASE = 0x5851F42D4C957F2D
_PIECE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


BYTE_CODE = mix((np.arange(256, dtype=U) + U(1)) * _ODD[0])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] = np.arange(97, 123, dtype=np.uint8)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    size = _PIECE + 4096
    while size < n:
        size *= 2
    if size not in _powers:
        up = np.full(size, U(_BASE))
        down = np.full(size, U(pow(_BASE, -1, 2**64)))
        up[0] = down[0] = U(1)
        if len(_powers) > 1:
            _powers.clear()
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


#: Bytes of a word from which it is hashed by itself.
_LONG = 512


def joined(texts: list[bytes], limit: int = _PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of whole texts of about ``limit`` bytes: first index, bytes with a newline after each text, starts."""
    first, total = 0, 0
    for k, t in enumerate(texts):
        total += len(t) + 1
        if total >= limit or k == len(texts) - 1:
            group = texts[first : k + 1]
            starts = np.zeros(len(group), np.int64)
            np.cumsum([len(x) + 1 for x in group[:-1]], out=starts[1:])
            yield first, np.frombuffer(b"\n".join(group) + b"\n", np.uint8), starts
            first, total = k + 1, 0


def words(data: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Start and fingerprint of each run of bytes other than white space; ``fold`` lower-cases A to Z.

    A fingerprint mixes the length and then eight bytes at a time, so every step depends on all before it: unlike
    a polynomial modulo a power of two, it has no words that collide whatever its constants are.
    """
    black = ~IS_SPACE[data]
    edge = np.diff(black.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = ends - starts
    data = np.concatenate([FOLD[data] if fold else data, np.zeros(8, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(data, 8)
    out = mix(size.astype(U) * _ODD[0] + _ODD[1])
    some, at = np.flatnonzero(size <= _LONG), 0
    while len(some):
        left = size[some] - at
        eight = np.ascontiguousarray(windows[starts[some] + at]).view("<u8").ravel().astype(U)
        short = left < 8
        eight[short] &= (U(1) << (U(8) * left[short].astype(U))) - U(1)
        out[some] = mix(out[some] * _ODD[2] ^ mix(eight + _ODD[3]))
        some, at = some[left > 8], at + 8
    for k in np.flatnonzero(size > _LONG):
        out[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return starts, out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of every run of ``n`` words; one entry per start."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, U)
    out = hashes[:size] * _ODD[0]
    for k in range(1, n):
        out = mix(out) + hashes[k : k + size] * _ODD[k % 5]
    return mix(out)


def counts_by_text(starts: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """How many of the sorted positions fall into each text."""
    return np.diff(np.append(np.searchsorted(starts, text_starts), len(starts)))
