"""MD5 of many short texts at once, by numpy: Spark's ``md5`` of the same texts, as numbers."""

from __future__ import annotations

from math import sin

import numpy as np

# fixed values of RFC 1321
_SINES = [np.uint32(int(abs(sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)

#: Texts that are worked on at once.
BLOCK = 16_384


def _message(prefix: bytes, numbers: np.ndarray, digits: int) -> tuple[np.ndarray, int]:
    """The 16 words of each text ``prefix`` + number, and how many of them hold text; all numbers have ``digits`` digits."""
    size = len(prefix) + digits
    words = np.zeros((16, len(numbers)), np.uint32)
    for i, letter in enumerate(prefix):
        words[i // 4] |= np.uint32(letter << 8 * (i % 4))
    left = numbers.astype(np.uint32 if digits < 10 else np.uint64)
    for i in range(size - 1, len(prefix) - 1, -1):
        rest = left // 10
        words[i // 4] |= (left - rest * 10 + 48).astype(np.uint32) << np.uint32(8 * (i % 4))
        left = rest
    words[size // 4] |= np.uint32(0x80 << 8 * (size % 4))
    words[14] = 8 * size
    return words, size // 4 + 1


def _digest(words: np.ndarray, used: int) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = (np.full(words.shape[1], s, np.uint32) for s in _START)
    f, high = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            at = 7 * i % 16
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _SINES[i]
        if at < used or at == 14:  # the others are 0
            f += words[at]
        np.left_shift(f, np.uint32(_TURNS[i]), out=high)
        f >>= np.uint32(32 - _TURNS[i])
        f |= high
        f += b
        a, d, c, b, f = d, c, b, f, a
    a, b, c, d = ((x + np.uint32(s)).byteswap().astype(np.uint64) for x, s in zip((a, b, c, d), _START, strict=True))
    return a << np.uint64(32) | b, c << np.uint64(32) | d


def md5_numbered(prefix: bytes, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last 64 bits of the MD5 of ``prefix`` + each number (not negative) in decimal; they order as the hexadecimal digests do.

    ``prefix`` has at most 36 bytes, so that a text fits one block of MD5.
    """
    if len(prefix) > 36:
        raise ValueError("the prefix of a numbered text has more than 36 bytes")
    first, last = np.empty(len(numbers), np.uint64), np.empty(len(numbers), np.uint64)
    size = np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), numbers, side="right") + 1
    for digits in np.unique(size):
        rows = np.flatnonzero(size == digits)
        for lo in range(0, len(rows), BLOCK):
            r = rows[lo : lo + BLOCK]
            first[r], last[r] = _digest(*_message(prefix, numbers[r], int(digits)))
    return first, last
