"""md5 of every pair of a prefix and a suffix, as numbers, for hashes whose number is replicates x rows."""

from __future__ import annotations

import hashlib
import math

import numpy as np

BLOCK = 16_384  # pairs at once: the working arrays then stay in a core's cache
_K = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORD = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _words(texts: list[bytes], at: int, end: bytes = b"") -> np.ndarray:
    """16 words a text, which stands at byte ``at`` of an otherwise empty block."""
    return np.frombuffer(b"".join((b"\0" * at + t + end).ljust(64, b"\0") for t in texts), "<u4").reshape(-1, 16)


def md5_60(prefixes: list[bytes], suffixes: list[bytes]) -> np.ndarray:
    """The first 15 hex digits of md5(prefix + suffix), (prefix, suffix) as uint64. All of a side have one length."""
    size = len(prefixes[0]) + len(suffixes[0])
    if size > 55:  # more than one block of md5
        return np.array([[int(hashlib.md5(p + s).hexdigest()[:15], 16) for s in suffixes] for p in prefixes], np.uint64)
    first, second = _words(prefixes, 0), _words(suffixes, len(prefixes[0]), b"\x80")
    words = []
    for j in range(16):
        x, y = first[:, j, None], second[None, :, j]
        words.append((x | y) if x.any() and y.any() else x if x.any() else y)
    words[14] = words[14] | np.uint32(8 * size)
    shape = (len(prefixes), len(suffixes))
    a, b, c, d = (np.full(shape, x) for x in _START)
    t, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        t += a
        t += words[_WORD[i]] + _K[i]
        np.left_shift(t, np.uint32(_SHIFTS[i]), out=turned)
        t >>= np.uint32(32 - _SHIFTS[i])
        t |= turned
        t += b
        a, b, c, d, t = d, t, b, c, a
    a += _START[0]
    b += _START[1]
    return ((a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap()) >> np.uint64(4)


def blocks(prefixes: list[bytes], suffixes: list[bytes]):
    """(prefix numbers, suffix numbers, digests) for all pairs, in blocks of about ``BLOCK`` pairs of equal lengths."""
    def by_length(texts):
        out: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            out.setdefault(len(t), []).append(i)
        return out.values()
    for rows in by_length(suffixes):
        for i in range(0, len(rows), 1024):
            some = rows[i:i + 1024]
            step = max(BLOCK // len(some), 1)
            for firsts in by_length(prefixes):
                for j in range(0, len(firsts), step):
                    yield firsts[j:j + step], some, md5_60([prefixes[p] for p in firsts[j:j + step]], [suffixes[s] for s in some])
