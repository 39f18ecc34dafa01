"""Vectorised text kernels: word spans, rolling hashes, windows and winnowing."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the polynomial hashes modulo 2**64; two lanes make 128-bit keys.
BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
WINDOW_BASES = (0xA0761D6478BD642F | 1, 0xE7037ED1A0B428DB | 1)

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length() if n > 1 else 1)
        inverse = pow(base, -1, 1 << 64)
        pair = []
        for b in (base, inverse):
            out = np.empty(size, np.uint64)
            out[0] = 1
            done = 1
            while done < size:
                step = np.uint64(pow(b, done, 1 << 64))
                take = min(done, size - done)
                out[done : done + take] = out[:take] * step
                done += take
            pair.append(out)
        have = _POWERS[base] = (pair[0], pair[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the public splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """H with H[j] - H[i] = sum of values[k] * base**k over i <= k < j."""
    out = np.zeros(len(values) + 1, np.uint64)
    if len(values):
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of each values[start:end] that doesn't depend on where it stands."""
    return mix((prefix[ends] - prefix[starts]) * powers(base, len(prefix))[1][starts] + (ends - starts).astype(np.uint64))


def rolling_hash(prefix: np.ndarray, k: int, base: int) -> np.ndarray:
    """``span_hash`` of all k consecutive values, in place and without index arrays."""
    n = len(prefix) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = prefix[k:] - prefix[:-k]
    h *= powers(base, len(prefix))[1][:n]
    h += np.uint64(k)
    spare = h >> np.uint64(30)
    h ^= spare
    h *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(h, np.uint64(27), out=spare)
    h ^= spare
    h *= np.uint64(0x94D049BB133111EB)
    np.right_shift(h, np.uint64(31), out=spare)
    h ^= spare
    return h


def runs_of(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of True that doesn't cross a text's end."""
    n = len(member)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = member[:-1]
    starts = np.flatnonzero(member & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = member[1:]
    ends = np.flatnonzero(member & (~after | cut[1:])) + 1
    return starts, ends


#: Bytes of white space that end a word of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes of a word of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, a-z, and all of every non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 word offsets of the texts."""
    starts, ends = runs_of(member[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def window_starts(word_offsets: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end word and text of each k-word window; short: a text of fewer, but not no, words is one window."""
    sizes = np.diff(word_offsets)
    counts = np.maximum(sizes - k + 1, np.minimum(sizes, 1) if short else 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(word_offsets[:-1], counts)
    return first, np.minimum(first + k, word_offsets[1:][owner]), owner


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any [start, end)."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the minimum of each w consecutive values; by their upper 32 bits, the last of equal ones.

    The choice depends on the values in the window alone, so equal windows choose alike.
    """
    n = len(values)
    if n < w:
        return np.zeros(0, np.uint32)
    key = np.empty(-(-n // w) * w, np.uint64)
    key[n:] = np.iinfo(np.uint64).max
    halves = key[:n].view(np.uint32).reshape(-1, 2)  # little-endian: the low half comes first
    halves[:, 0] = np.uint32(0xFFFFFFFF) - np.arange(n, dtype=np.uint32)
    halves[:, 1] = np.ascontiguousarray(values).view(np.uint32).reshape(-1, 2)[:, 1]
    grid = key.reshape(-1, w)
    low = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()[: n - w + 1]
    low = np.minimum(low, np.minimum.accumulate(grid, axis=1).ravel()[w - 1 : n])
    return np.uint32(0xFFFFFFFF) - low.view(np.uint32).reshape(-1, 2)[:, 0]
