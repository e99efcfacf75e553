"""Vectorised hashing of byte and word sequences (numpy, one document at a time)."""

from __future__ import annotations

import numpy as np

#: The white space that separates words, and odd multipliers of the rolling hashes.
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
ORDER = 0xC2B2AE3D27D4EB4F
PLACE_BITS = 31

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n + 1:
        size = max(4096, 1 << (n + 1).bit_length())
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 1 << 22:
            _powers[base] = have
    return have


class Rolling:
    """Polynomial hashes of any ranges of a sequence, from one pass of prefix sums modulo 2^64."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        up, self.down = _powers_of(base, n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def raw_windows(self, size: int) -> np.ndarray:
        """Polynomial of every window of `size` values, not mixed."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return (self.sums[size:] - self.sums[:n]) * self.down[:n]

    def windows(self, size: int) -> np.ndarray:
        """Hash of every window of `size` values."""
        return mix(self.raw_windows(size))


def as_bytes(text: bytes | None) -> np.ndarray:
    return np.frombuffer(text or b"", dtype=np.uint8)


def byte_values(raw: np.ndarray) -> np.ndarray:
    return raw.astype(np.uint64) + np.uint64(1)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`; white space is ASCII, so bytes suffice."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = IS_WORD[raw]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    return Rolling(byte_values(raw), BYTE_BASE).ranges(starts, ends)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    return Rolling(words, WORD_BASE).windows(min(size, n))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of `width` values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchored_runs(grams: np.ndarray, width: int, most: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizers: each window of `width` consecutive grams chooses its smallest.

    Grams are polynomials that aren't mixed; the high bits of a product order them, and the chosen are mixed.
    Neighbouring windows that choose an equal gram form a run of at most `most` windows. Returns each run's gram
    hash, its first window, its number of windows and whether the gram may stand in it more than once. The choice
    depends on a window's content alone, so equal windows choose equal grams; a run of equal bytes is few runs.
    """
    if len(grams) < width:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none, np.zeros(0, dtype=bool)
    shift = np.uint64(PLACE_BITS)
    best = sliding_min((grams * np.uint64(ORDER) >> shift << shift) | np.arange(len(grams), dtype=np.uint64), width)
    place = (best & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    chosen = grams[place]
    new = np.concatenate(([True], chosen[1:] != chosen[:-1]))
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(place)])))
    last = first + count - 1
    again = place[first] != place[last]
    if count.max() > most:
        parts = -(-count // most)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, count, again = np.repeat(first, parts) + nth * most, np.minimum(np.repeat(count, parts) - nth * most, most), np.repeat(again, parts)
    return mix(chosen[first]), first, count, again
