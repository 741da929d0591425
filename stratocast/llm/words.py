"""Words of many texts at once, as numpy arrays, for use inside tasks.

A word is a run of bytes other than the six ASCII blanks, so no decoding is
needed and only A-Z are lower-cased. A word's hash is a polynomial in its bytes
modulo 2**64, mixed: equal words have equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_BYTES = 1 << 20  # texts are worked on in slices of about this size; a longer text is a slice of its own
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
GAPS_AND_MARKS = _SPACE.copy()  # blanks and ASCII punctuation, for words of letters and digits only
GAPS_AND_MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_BYTE = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] += np.uint64(32)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES * 2)
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
        del _powers[:-2]
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about SLICE_BYTES together."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > SLICE_BYTES:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def word_hashes(texts: list, lower: bool, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts (bytes or None), and each text's first word's index, with the end.

    Words are runs of bytes outside `gaps`, which must hold the line feed.
    """
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
    inside = ~gaps[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    up, down = powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER if lower else _BYTE)[data] * up, out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mixed(raw + (ends - starts).astype(np.uint64)), first


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of n consecutive words from every word on, and whether these lie within one text."""
    out = np.zeros(len(hashes), np.uint64)
    whole = np.zeros(len(hashes), bool)
    size = len(hashes) - n + 1
    if size <= 0:
        return out, whole
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total = total * np.uint64(_BASE) + hashes[k : k + size]
    out[:size] = mixed(total)
    last = np.repeat(first[1:], np.diff(first))
    whole[:] = np.arange(len(hashes)) + n <= last
    return out, whole
