"""Prefix-free parsing of byte strings by rolling-hash triggers.

A trigger is a position whose rolling hash (of ``GRAM`` bytes) is the leftmost
least one in some run of ``span`` positions, so whether a position triggers
depends on nearby bytes only and every string of ``length`` bytes holds one.  The
window starts that share a trigger form a phrase; a phrase's bytes run to the end
of its last window, so neighbours overlap and equal windows lie at equal places
of phrases with equal triggers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tessera.llm import kernels

GRAM = 40


@dataclass
class Phrases:
    """Phrases of a chunk, in text order.  Windows start at ``low`` to ``high`` inclusive."""

    doc: np.ndarray
    low: np.ndarray
    high: np.ndarray
    trigger: np.ndarray
    key: np.ndarray
    content: np.ndarray
    again: np.ndarray


_P = np.uint64((1 << 61) - 1)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
#: Bases of the two independent hash families.
_BASES = (0x0A3C5E9F17B2D468, 0x13D7F0A96C8E2B51)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b) -> np.ndarray:
    """Product modulo 2**61 - 1 of numbers below it."""
    a1, a0 = a >> np.uint64(31), a & _LOW31
    b1, b0 = b >> np.uint64(31), b & _LOW31
    mid = a1 * b0 + a0 * b1
    return _reduced(np.uint64(2) * (a1 * b1) + (mid >> np.uint64(30)) + ((mid & _LOW30) << np.uint64(31)) + a0 * b0)


def _power(family: int, down: bool, n: int) -> np.ndarray:
    """Powers of a family's base, or of its inverse."""
    held = _powers.get((family, down))
    if held is None or len(held) < n:
        base = pow(_BASES[family], -1 if down else 1, int(_P))
        held = np.ones(1, dtype=np.uint64)
        while len(held) < max(n, 1 << 12):
            held = np.concatenate([held, times(held, np.uint64(pow(base, len(held), int(_P))))])
        _powers[family, down] = held
    return held[:n]


class Rolling:
    """Prefix-sum hashes of a chunk: any substring of up to 4 MB in constant time.

    Polynomials modulo the prime 2**61 - 1, where no structure of a text cancels as it
    does modulo a power of two.  Families differ in base and byte values.
    """

    def __init__(self, data: np.ndarray, family: int = 0):
        n = len(data)
        # Values are a permutation of 1 to 256, so a product with half a power has 41 bits
        # and the sum over a substring 63: nothing is reduced before a hash is asked for.
        values = np.argsort(kernels.mix(kernels.BYTE_VALUES + np.uint64(family))).astype(np.uint64) + np.uint64(1)
        own, power = values[data], _power(family, False, n)
        self.low, self.high = np.zeros(n + 1, dtype=np.uint64), np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(own * (power & np.uint64((1 << 32) - 1)), out=self.low[1:])
        np.cumsum(own * (power >> np.uint64(32)), out=self.high[1:])
        self.down = _power(family, True, n + 1)

    def _named(self, low: np.ndarray, high: np.ndarray, down: np.ndarray) -> np.ndarray:
        # high * 2**32, where 2**61 is 1
        high = (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32))
        return kernels.mix(times(_reduced(high + _reduced(low)), down))

    def of(self, starts: np.ndarray, size) -> np.ndarray:
        ends = starts + size
        return self._named(self.low[ends] - self.low[starts], self.high[ends] - self.high[starts], self.down[starts])

    def all(self, size: int) -> np.ndarray:
        """The hash at every position that has ``size`` bytes after it."""
        n = len(self.low) - size
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return self._named(self.low[size:] - self.low[:n], self.high[size:] - self.high[:n], self.down[:n])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position on.

    It only chooses triggers and gathers phrases, which are then told apart by
    :class:`Rolling`; so a polynomial modulo 2**64 will do, at a fraction of the work.
    """
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(kernels.BYTE_VALUES[data] * kernels._power("up", kernels._BASE, len(data)), out=sums[1:])
    out = sums[GRAM:] - sums[:n]
    out *= kernels._power("down", kernels._INVERSE, n)
    return kernels.mix(out)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    size = -(-len(values) // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def phrases(data: np.ndarray, offsets: np.ndarray, rolling: Rolling, length: int, second: Rolling | None = None) -> Phrases:
    """Parse every document of a chunk; windows never cross documents.

    ``content`` and ``again`` name a phrase's bytes by ``rolling`` and ``second``.
    """
    second = second or Rolling(data, 1)
    span = length - GRAM + 1
    grams = gram_hashes(data)
    ranked = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_least(ranked, span)
    n = len(least)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Phrases(none, none, none, none, *[none.astype(np.uint64)] * 3)
    trigger = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # A window that runs over the end of its document is none.
    inside = np.ones(n, dtype=bool)
    for end in offsets[1:].tolist():
        inside[max(0, end - length + 1) : end] = False
    change = np.zeros(n, dtype=bool)
    change[1:] = (trigger[1:] != trigger[:-1]) | ~inside[:-1]
    change[0] = True
    first = offsets[:-1]
    change[first[first < n]] = True
    low = np.flatnonzero(change & inside)
    # A phrase ends where the next begins or where windows stop.
    stop = np.concatenate([np.flatnonzero(change | ~inside), [n]])
    high = stop[np.searchsorted(stop, low, side="right")] - 1
    at = trigger[low]
    doc = np.searchsorted(offsets, low, side="right") - 1
    content = rolling.of(low, high - low + length) + (at - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return Phrases(doc, low, high, at, grams[at], kernels.mix(content), second.of(low, high - low + length))


def prefix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of each position's ``length`` bytes among all, equal where the bytes are equal.

    This is the suffix array of ``data`` cut off at ``length``: ranks of 8 bytes
    are doubled until they cover it.  Positions near the end rank by what is left.
    """
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(length + 8, dtype=np.uint64)])
    packed = np.zeros(n + length, dtype=np.uint64)
    step = min(7, length)  # 9 bits each: 0 stands for the end
    for k in range(step):
        packed = (packed << np.uint64(9)) | padded[k : k + n + length]
    rank = np.unique(packed, return_inverse=True)[1].astype(np.uint64)
    done = step
    while done < length:
        ahead = min(done, length - done)
        pair = rank.copy()
        pair[: len(rank) - ahead] = (rank[: len(rank) - ahead] << np.uint64(32)) | rank[ahead:]
        pair[len(rank) - ahead :] <<= np.uint64(32)
        rank = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        done += ahead
    return rank[:n].astype(np.int64)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The full suffix array of a byte array, by doubling ranks to its length."""
    return np.argsort(prefix_ranks(data, max(8, len(data))), kind="stable") if len(data) else np.zeros(0, np.int64)
