"""Partitioning and bucketing by hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_M = (1 << 64) - 1
#: Fixed values of the public FarmHash fingerprint.
K0, K1, K2 = 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F


def _rotate(v: int, s: int) -> int:
    return (v >> s | v << (64 - s)) & _M


def _mix(v: int) -> int:
    return v ^ v >> 47


def _word(s: bytes, at: int, size: int = 8) -> int:
    return int.from_bytes(s[at : at + size], "little")


def _len16(u: int, v: int, mul: int) -> int:
    a = _mix((u ^ v) * mul & _M)
    return _mix((v ^ a) * mul & _M) * mul & _M


def _weak(s: bytes, at: int, a: int, b: int) -> tuple[int, int]:
    w, x, y, z = (_word(s, at + 8 * k) for k in range(4))
    a = a + w & _M
    b = _rotate(b + a + z & _M, 21)
    c = a
    a = a + x + y & _M
    return a + z & _M, b + _rotate(a, 44) + c & _M


def fingerprint64(s: bytes) -> int:
    """The public 64-bit FarmHash fingerprint of a byte string."""
    n = len(s)
    mul = K2 + n * 2 & _M
    if n <= 16:
        if n >= 8:
            a, b = _word(s, 0) + K2 & _M, _word(s, n - 8)
            c, d = _rotate(b, 37) * mul + a & _M, (_rotate(a, 25) + b & _M) * mul & _M
            return _len16(c, d, mul)
        if n >= 4:
            return _len16(n + (_word(s, 0, 4) << 3) & _M, _word(s, n - 4, 4), mul)
        if n:
            y, z = s[0] + (s[n >> 1] << 8), n + (s[-1] << 2)
            return _mix(y * K2 & _M ^ z * K0 & _M) * K2 & _M
        return K2
    if n <= 32:
        a, b = _word(s, 0) * K1 & _M, _word(s, 8)
        c, d = _word(s, n - 8) * mul & _M, _word(s, n - 16) * K2 & _M
        return _len16(_rotate(a + b & _M, 43) + _rotate(c, 30) + d & _M, a + _rotate(b + K2 & _M, 18) + c & _M, mul)
    if n <= 64:
        a, b = _word(s, 0) * K2 & _M, _word(s, 8)
        c, d = _word(s, n - 8) * mul & _M, _word(s, n - 16) * K2 & _M
        y = _rotate(a + b & _M, 43) + _rotate(c, 30) + d & _M
        z = _len16(y, a + _rotate(b + K2 & _M, 18) + c & _M, mul)
        e, f = _word(s, 16) * mul & _M, _word(s, 24)
        g, h = (y + _word(s, n - 32) & _M) * mul & _M, (z + _word(s, n - 24) & _M) * mul & _M
        return _len16(_rotate(e + f & _M, 43) + _rotate(g, 30) + h & _M, e + _rotate(f + a & _M, 18) + g & _M, mul)
    x, y = 81, 81 * K1 + 113 & _M
    z = _mix(y * K2 + 113 & _M) * K2 & _M
    v, w = (0, 0), (0, 0)
    x = x * K2 + _word(s, 0) & _M
    end = (n - 1) // 64 * 64
    for at in range(0, end, 64):
        x = _rotate(x + y + v[0] + _word(s, at + 8) & _M, 37) * K1 & _M
        y = _rotate(y + v[1] + _word(s, at + 48) & _M, 42) * K1 & _M
        x ^= w[1]
        y = y + v[0] + _word(s, at + 40) & _M
        z = _rotate(z + w[0] & _M, 33) * K1 & _M
        v = _weak(s, at, v[1] * K1 & _M, x + w[0] & _M)
        w = _weak(s, at + 32, z + w[1] & _M, y + _word(s, at + 16) & _M)
        z, x = x, z
    at = n - 64
    mul = K1 + ((z & 0xFF) << 1) & _M
    w = (w[0] + (n - 1 & 63) & _M, w[1])
    v = (v[0] + w[0] & _M, v[1])
    w = (w[0] + v[0] & _M, w[1])
    x = _rotate(x + y + v[0] + _word(s, at + 8) & _M, 37) * mul & _M
    y = _rotate(y + v[1] + _word(s, at + 48) & _M, 42) * mul & _M
    x ^= w[1] * 9 & _M
    y = y + v[0] * 9 + _word(s, at + 40) & _M
    z = _rotate(z + w[0] & _M, 33) * mul & _M
    v = _weak(s, at, v[1] * mul & _M, x + w[0] & _M)
    w = _weak(s, at + 32, z + w[1] & _M, y + _word(s, at + 16) & _M)
    z, x = x, z
    return _len16(_len16(v[0], w[0], mul) + _mix(y) * K0 + z & _M, _len16(v[1], w[1], mul) + x & _M, mul)


def fingerprints(values: pa.Array) -> np.ndarray:
    """fingerprint64 of every string, as unsigned numbers; all strings of a class of lengths at once. A null is as an empty string."""
    values = values.fill_null("").cast(pa.large_binary())
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.zeros((data.size if data else 0) + 8, np.uint8)
    raw[: len(raw) - 8] = np.frombuffer(data, np.uint8) if data else 0
    words = {size: np.ndarray(len(raw) - 7, f"<u{size}", raw, strides=(1,)) for size in (1, 4, 8)}

    def word(at: np.ndarray, size: int = 8) -> np.ndarray:
        return words[size][at].astype(np.uint64)

    start, n = ends[:-1], np.diff(ends)
    out = np.full(len(values), K2, np.uint64)
    for least, most, way in ((1, 3, _upto3), (4, 7, _upto7), (8, 16, _upto16), (17, 32, _upto32), (33, 64, _upto64), (65, None, _longer)):
        which = np.flatnonzero((n >= least) & (n <= most if most else True))
        if len(which):
            out[which] = way(word, start[which], n[which])
    return out


def _mul(n: np.ndarray) -> np.ndarray:
    return K2 + n.astype(np.uint64) * 2


def _upto3(word, at, n):
    y, z = word(at, 1) + (word(at + (n >> 1), 1) << 8), n.astype(np.uint64) + (word(at + n - 1, 1) << 2)
    return _mix(y * K2 ^ z * K0) * K2


def _upto7(word, at, n):
    return _len16(n.astype(np.uint64) + (word(at, 4) << 3), word(at + n - 4, 4), _mul(n))


def _upto16(word, at, n):
    mul, a, b = _mul(n), word(at) + K2, word(at + n - 8)
    return _len16(_rotate(b, 37) * mul + a, (_rotate(a, 25) + b) * mul, mul)


def _upto32(word, at, n):
    mul, a, b = _mul(n), word(at) * K1, word(at + 8)
    c, d = word(at + n - 8) * _mul(n), word(at + n - 16) * K2
    return _len16(_rotate(a + b, 43) + _rotate(c, 30) + d, a + _rotate(b + K2, 18) + c, mul)


def _upto64(word, at, n):
    mul, a, b = _mul(n), word(at) * K2, word(at + 8)
    c, d = word(at + n - 8) * mul, word(at + n - 16) * K2
    y = _rotate(a + b, 43) + _rotate(c, 30) + d
    z = _len16(y, a + _rotate(b + K2, 18) + c, mul)
    e, f = word(at + 16) * mul, word(at + 24)
    g, h = (y + word(at + n - 32)) * mul, (z + word(at + n - 24)) * mul
    return _len16(_rotate(e + f, 43) + _rotate(g, 30) + h, e + _rotate(f + a, 18) + g, mul)


def _longer(word, at, n):
    """Blocks of 64 bytes, each for all strings that have one; the last 64 bytes come at the end."""
    same = lambda value: np.full(len(at), value & _M, np.uint64)
    x, y = word(at) + same(81 * K2), same(81 * K1 + 113)
    z = _mix(y * K2 + 113) * K2
    v0, v1, w0, w1 = (same(0) for _ in range(4))
    blocks = (n - 1) // 64
    for k in range(int(blocks.max())):
        i = np.flatnonzero(blocks > k)
        p = at[i] + 64 * k
        a = _rotate(x[i] + y[i] + v0[i] + word(p + 8), 37) * K1 ^ w1[i]
        b = _rotate(y[i] + v1[i] + word(p + 48), 42) * K1 + v0[i] + word(p + 40)
        c = _rotate(z[i] + w0[i], 33) * K1
        (v0[i], v1[i]), (w0[i], w1[i]) = _weak_at(word, p, v1[i] * K1, a + w0[i]), _weak_at(word, p + 32, c + w1[i], b + word(p + 16))
        x[i], y[i], z[i] = c, b, a
    p = at + n - 64
    mul = K1 + ((z & 0xFF) << 1)
    w0 = w0 + (n - 1 & 63).astype(np.uint64)
    v0 = v0 + w0
    w0 = w0 + v0
    x = _rotate(x + y + v0 + word(p + 8), 37) * mul ^ w1 * 9
    y = _rotate(y + v1 + word(p + 48), 42) * mul + v0 * 9 + word(p + 40)
    z = _rotate(z + w0, 33) * mul
    (v0, v1), (w0, w1) = _weak_at(word, p, v1 * mul, x + w0), _weak_at(word, p + 32, z + w1, y + word(p + 16))
    return _len16(_len16(v0, w0, mul) + _mix(y) * K0 + x, _len16(v1, w1, mul) + z, mul)


def _weak_at(word, at, a, b):
    w, x, y, z = (word(at + 8 * k) for k in range(4))
    a = a + w
    b = _rotate(b + a + z, 21)
    c = a
    a = a + x + y
    return a + z, b + _rotate(a, 44) + c


def hash_bucket(num_bins: int):
    """fingerprint64 of the text form modulo num_bins, by an Arrow UDF; NULL stays NULL."""
    if not num_bins or num_bins <= 0:
        raise ValueError("num_bins must be positive")

    @F.arrow_udf("bigint")
    def bucket(values: pa.Array) -> pa.Array:
        return pa.array((fingerprints(values) % num_bins).astype(np.int64), mask=values.is_null().to_numpy(zero_copy_only=False))

    return lambda c: bucket(c.cast("string"))


def native_hash_bucket(num_bins: int):
    """pmod(xxhash64, num_bins): other buckets than hash_bucket, but no Python."""
    if not num_bins or num_bins <= 0:
        raise ValueError("num_bins must be positive")
    return lambda c: F.when(c.isNotNull(), F.pmod(F.xxhash64(c.cast("string")), F.lit(num_bins)))


def string_partition(c: Column, n: int) -> Column:
    """The digits of the SHA-256 in hex, read as a number in base 32, modulo n."""
    digits = F.filter(F.split(F.sha2(c, 256), ""), lambda x: x != "")
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, x: (a * 32 + F.call_function("instr", F.lit("0123456789abcdef"), x) - 1) % n)


def int_partition(c: Column, n: int) -> Column:
    return F.pmod(c, F.lit(n))
