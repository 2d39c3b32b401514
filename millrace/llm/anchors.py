"""Content-defined anchors and substring fingerprints of byte strings."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

GRAM = 16
#: Windows in a block; a place inside a block fits 24 bits.
BLOCK = 1 << 23
_BASE = 0x2545F4914F6CDD1D


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(1 << bits, _BASE, np.uint64)
    down = np.full(1 << bits, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def window(length: int) -> int:
    """How many places an anchor is chosen from: the wider, the fewer anchors, and the shorter the core that all strings with one share."""
    return length * 3 // 5


class Prints:
    """64-bit fingerprints of any substring of data: polynomial sums modulo 2**64, mixed.

    For strings of under 1024 bytes no structure of the text makes these collide by design.
    """

    def __init__(self, data: np.ndarray):
        self.down = _powers(max(21, int(len(data)).bit_length()))[1]
        up = _powers(max(21, int(len(data)).bit_length()))[0]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, begin: int, end: int) -> np.ndarray:
        """What `of` gives for the GRAM bytes from each place of begin..end-1 on."""
        return _mix((self.sums[begin + GRAM : end + GRAM] - self.sums[begin:end]) * self.down[begin:end] + np.uint64(GRAM))


def _least(prints: Prints, begin: int, end: int, wide: int) -> np.ndarray:
    """For each window of `wide` of the places begin..end-1 the place of its least fingerprint."""
    key = prints.grams(begin, end)
    key &= np.uint64((1 << 64) - (1 << 24))
    key |= np.arange(end - begin, dtype=np.uint64)
    size = 1
    while size < wide:
        step = min(size, wide - size)
        key = np.minimum(key[:-step], key[step:])
        size += step
    key &= np.uint64((1 << 24) - 1)
    return key.view(np.int64) + begin


def minimizers(prints: Prints, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, lo, hi): for the starts p in lo..hi of strings of `length` bytes, the same anchor.

    The anchor of p is the place of the least 16-byte fingerprint among the window(length) from p on, the
    leftmost if several; it depends on the string at p alone. bounds: where each text begins,
    and the end of the last; strings lie inside one text. length must be 40 at least.
    """
    n, wide = int(bounds[-1]), window(length)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    least = np.concatenate([_least(prints, b, min(b + BLOCK + wide - 1, n - GRAM + 1), wide) for b in range(0, n - GRAM - wide + 2, BLOCK)])
    valid = np.zeros(len(least) + 1, np.int8)
    long = np.diff(bounds) >= length
    np.add.at(valid, bounds[:-1][long], 1)
    np.add.at(valid, bounds[1:][long] - length + 1, -1)
    valid = np.cumsum(valid, dtype=np.int8)[:-1].view(bool)
    same = (least[1:] == least[:-1]) & valid[1:] & valid[:-1]
    new = np.flatnonzero(valid & ~np.append(False, same))
    return least[new], new, np.flatnonzero(valid & ~np.append(same, False))
