"""Words and word shingles of a text as 64-bit hashes in numpy arrays, for work inside Arrow batches."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def split(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` in UTF-8: bytes.split() cuts at exactly these six characters."""
    return [] if text is None else text.encode().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S30)) * _A
    x = (x ^ (x >> _S27)) * _B
    return x ^ (x >> _S31)


_powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 2  # of an odd factor, and of its inverse


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, factor in enumerate((int(_STEP), pow(int(_STEP), -1, 1 << 64))):
            steps = np.full(2 * n, factor, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_byte = mixed(np.arange(256, dtype=np.uint64) + _STEP)
_byte_lower = _byte.copy()
_byte_lower[65:91] = _byte[97:123]
CHUNK = 1 << 20


def hashed(texts: list[str], lower: bool = False) -> list[np.ndarray]:
    """The hashes of the words `[^\\x20\\x09-\\x0D]+` of every text, from prefix sums of a polynomial over their bytes, about CHUNK bytes at a time. lower: A-Z count as a-z."""
    encoded = [x.encode() for x in texts]
    data = np.frombuffer(b"\n".join(encoded), np.uint8)
    heads = np.cumsum([0] + [len(x) + 1 for x in encoded])
    value = _byte_lower if lower else _byte
    found, starts, at = [], [], 0
    while at < len(data):
        to = min(len(data), at + CHUNK)
        space = _space[data[at:to]]
        while to < len(data) and not space.any():  # a word that is longer than the chunk
            to = min(len(data), at + 2 * (to - at))
            space = _space[data[at:to]]
        if to < len(data):
            space = space[: len(space) - int(space[::-1].argmax())]
            to = at + len(space)
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        first, last = edge[::2], edge[1::2]
        power, inverse = powers(to - at + 1)
        sums = np.zeros(to - at + 1, np.uint64)
        np.cumsum(value[data[at:to]] * power[: to - at], out=sums[1:])
        found.append(mixed((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)))
        starts.append(first + at)
        at = to
    if not found:
        return [np.empty(0, np.uint64) for _ in texts]
    every = np.concatenate(found)
    cuts = np.searchsorted(np.concatenate(starts), heads)
    return [every[a:b] for a, b in zip(cuts, cuts[1:])]


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, in order; none if there are fewer. Long windows come from prefix sums of a polynomial."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if k <= 3:
        out = hashes[:n].copy()
        for j in range(1, k):
            out = mixed(out + _STEP) + hashes[j : j + n]
        return mixed(out ^ np.uint64(k))
    power, inverse = powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * inverse[:n] ^ np.uint64(k))


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """The distinct k-word shingles, sorted; of fewer words, the whole sequence as one; of none, none."""
    n = len(hashes)
    return np.unique(windows(hashes, min(k, n))) if n else np.empty(0, np.uint64)
