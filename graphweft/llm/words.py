"""Words of many texts at once, as hashes in numpy arrays."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

from graphweft.llm.common import slices

#: ASCII white space; all other bytes belong to words.
SPACES = (0x20, *range(0x09, 0x0E))
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Hashing goes in slices of about this many characters.
SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.cache
def powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i below 2 ** bits; base is odd."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(1 << bits, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers_for(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(base, max(16, n.bit_length()))


@functools.cache
def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, as it is and with A-Z as a-z."""
    plain = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    lower = plain.copy()
    lower[ord("A") : ord("Z") + 1] = plain[ord("a") : ord("z") + 1]
    return plain, lower


@functools.cache
def _is_word() -> np.ndarray:
    table = np.ones(256, bool)
    table[list(SPACES)] = False
    return table


def hash_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words end in them."""
    whole = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    inside = np.zeros(len(whole) + 2, bool)
    inside[1:-1] = _is_word()[whole]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    forth, back = powers_for(0x2545F4914F6CDD1D, len(whole) + 1)
    sums = np.zeros(len(whole) + 1, np.uint64)
    np.cumsum(byte_tables()[int(lower)][whole] * forth[: len(whole)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64) * _ODD)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(start, ends)


def each_words(texts: list[bytes | None], lower: bool = False) -> Iterator[np.ndarray]:
    """Word hashes of each text in turn; None has none."""
    raw = [t or b"" for t in texts]
    for a, b in slices(raw, SLICE):
        hashes, ends = hash_words(raw[a:b], lower)
        begin = 0
        for end in ends.tolist():
            yield hashes[begin:end]
            begin = end


def grams(words: np.ndarray, n: int, base: int = 0x9DDFEA08EB382D69) -> np.ndarray:
    """A hash of each n consecutive words; none where there are fewer words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    if n <= 8:
        out = np.zeros(count, np.uint64)
        for i in range(n):
            out = out * np.uint64(base) + words[i : i + count]
        return mix(out)
    forth, back = powers_for(base, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * forth[: len(words)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * back[:count])
