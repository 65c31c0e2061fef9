"""Words of many texts at once, straight from their UTF-8 bytes, with 64-bit hashes."""

from __future__ import annotations

import numpy as np

_ASCII = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, every other byte as it is.
LOWER = np.where((_ASCII >= 65) & (_ASCII <= 90), _ASCII + 32, _ASCII).astype(np.uint8)
#: Bytes of words that white space (20, 09-0D) separates.
NOT_SPACE = ~((_ASCII == 0x20) | ((_ASCII >= 0x09) & (_ASCII <= 0x0D)))
#: Bytes of words of letters and digits: 0-9, A-Z, a-z and everything beyond ASCII.
ALNUM = ((_ASCII >= 0x30) & (_ASCII <= 0x39)) | ((_ASCII >= 0x41) & (_ASCII <= 0x5A)) | ((_ASCII >= 0x61) & (_ASCII <= 0x7A)) | (_ASCII >= 0x80)

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(which: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 4 << 20:  # longer texts are rare: their powers are made anew and not kept
            _powers[which] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word: a longest run of bytes that `inside` marks, within one row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    mark = inside[data]
    edge = np.empty(len(data) + 1, bool)  # a row may begin at i
    edge[:] = False
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = mark[:-1]
    starts = np.flatnonzero(mark & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = mark[1:]
    ends = np.flatnonzero(mark & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def running(lowered: np.ndarray) -> np.ndarray:
    """Running sums of the byte values' polynomial, from which any span's hash is a difference."""
    total = np.zeros(len(lowered) + 1, np.uint64)
    if len(lowered):
        np.cumsum(_TABLE[lowered] * _power("up", _BASE, len(lowered)), out=total[1:])
    return total


def span_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix((total[ends] - total[starts]) * _power("down", _BACK, len(total))[starts] + (ends - starts).astype(np.uint64))


def hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: a polynomial of random byte values, from differences of running sums."""
    return span_hashes(running(lowered), starts, ends)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start, end, row, hash) of all words."""
    lowered = LOWER[data]
    start, end, row = spans(data, offsets, inside)
    return lowered, start, end, row, hashes(lowered, start, end)
