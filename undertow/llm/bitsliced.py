"""Bit-sliced comparison: bit planes stand vertically, carry-save counters add the differing bits of many pairs at once, and a
block is left as soon as all its lanes exceed the radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes(values: np.ndarray) -> np.ndarray:
    """Vertical bit planes: row k holds bit k of all values (one word or a row of words each), 64 values a word."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


class Counter:
    """Counts of ones in many lanes at once, bit-sliced; a lane that passes the radius is over."""

    def __init__(self, shape: tuple, radius: int) -> None:
        self.radius, self.digits, self.over = radius, [np.zeros(shape, np.uint64) for _ in range(radius.bit_length())], np.zeros(shape, np.uint64)

    def add(self, x: np.ndarray) -> None:
        for digit in self.digits:
            carry = digit & x
            digit ^= x
            x = carry
        self.over |= x

    def within(self) -> np.ndarray:
        """The lanes whose count is at most the radius."""
        more, same = self.over.copy(), ~self.over
        for i in range(len(self.digits) - 1, -1, -1):
            if self.radius >> i & 1:
                same &= self.digits[i]
            else:
                more |= same & self.digits[i]
                same &= ~self.digits[i]
        return ~more


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int = 3) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) differ in at most radius bits."""
    if a.ndim == 2 and a.shape[1] > 2:
        # Half of the bits rule out most pairs.
        close = close_pairs(a[:, : a.shape[1] // 2], b[:, : a.shape[1] // 2], radius)
        close[close] = _close(a[close], b[close], radius)
        return close
    return _close(a, b, radius)


def _close(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    if not len(a):
        return np.zeros(0, bool)
    differ = planes(a ^ b)
    counter = Counter(differ.shape[1:], radius)
    for k, plane in enumerate(differ):
        counter.add(plane)
        if k % 8 == 7 and (counter.over == ONES).all():
            break
    return np.unpackbits(np.ascontiguousarray(counter.within()).view(np.uint8), bitorder="little")[: len(a)].astype(bool)


def close_rows(queries: np.ndarray, block: np.ndarray, radius: int = 3, at_once: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """For each query with any, the positions in block within radius."""
    vertical = planes(block)
    valid = planes(np.full(len(block), ONES))[0]
    for start in range(0, len(queries), at_once):
        q = queries[start : start + at_once]
        counter = Counter((len(q), vertical.shape[1]), radius)
        q = q.reshape(len(q), -1)
        for k in range(len(vertical)):
            mask = (np.uint64(0) - (q[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)))[:, None]
            counter.add(vertical[k] ^ mask)
            if k % 8 == 7 and (counter.over | ~valid == ONES).all():
                break
        found = counter.within() & valid
        for i in np.flatnonzero(found.any(axis=1)):
            yield start + i, np.flatnonzero(np.unpackbits(np.ascontiguousarray(found[i]).view(np.uint8), bitorder="little"))
