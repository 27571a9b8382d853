"""Word shingles of many texts at once, hashed to 64 bits with numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bytes of text that are hashed at once, a few dozen bytes of arrays for each; a longer text is hashed by itself.
AT_ONCE = 1 << 18
_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64; those that usual sizes need are kept."""
    found = list(_POWERS)
    if len(found[0]) < size:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            found[k] = np.cumprod(steps, dtype=np.uint64)
        if size <= 2 * AT_ONCE:
            _POWERS[:] = found
    return found[0][:size], found[1][:size]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of ``texts`` (A-Z lower-cased; white space as in ASCII) and the text it is in."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b" ".join([*texts, b""]) if texts else b"", np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1))
    starts, stops = edge[::2], edge[1::2]
    low = raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
    up, down = _powers(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[low] * up, dtype=np.uint64)])
    hashes = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(np.cumsum(sizes + 1), starts, "right")


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingles of ``words`` words, sorted; a shorter text is one shingle, an empty one none."""
    out, part, size = [], [], 0
    for text in texts:
        if part and size + len(text) > AT_ONCE:
            out += _sets(part, words)
            part, size = [], 0
        part.append(text)
        size += len(text) + 1
    return out + _sets(part, words)


def _sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    hashes, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    full = max(0, len(hashes) - words + 1)
    rolled = np.zeros(full, np.uint64)
    for k in range(words if full else 0):
        rolled += hashes[k : k + full] * _PLACE[k]
    rolled = mix(rolled)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= words:
            out.append(np.unique(rolled[end - count : end - words + 1]))
        elif count:
            few = hashes[end - count : end]
            out.append(mix(np.array([(few * _PLACE[:count]).sum(dtype=np.uint64) + np.uint64(count)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles, whatever their order."""
    total = mix(shingles + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])
