"""Words of a text: as columns, and as hashes computed on the text's bytes.

A word is a run of characters other than the six ASCII white-space characters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_CHUNK = 1 << 16
_MASK = (1 << 64) - 1


def lowered(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words in order; an empty array for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _splitmix(n: int, seed: int) -> list[int]:
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        out[have : 2 * have] = out[: min(have, n - have)] * step
        have *= 2
    return out


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = _powers(_BASE, _CHUNK)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), _CHUNK)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_BYTES = np.array(_splitmix(256, 11), np.uint64) | np.uint64(1)
_BYTES[_IS_SPACE] = 0
_BYTES_LOWER = _BYTES.copy()
_BYTES_LOWER[65:91] = _BYTES[97:123]
_GRAM = np.array(_splitmix(64, 23), np.uint64) | np.uint64(1)


def word_hashes(text: bytes | str | None, lower: bool = True) -> np.ndarray:
    """One 64-bit hash per word of the text, in order.

    A word hashes to a polynomial in its bytes modulo 2**64.  The text is read in chunks of fixed
    size, so memory beyond the result does not grow with its length; a word over a chunk's end is
    carried on.
    """
    if not text:
        return np.empty(0, np.uint64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text, np.uint8)
    table = _BYTES_LOWER if lower else _BYTES
    found, open_hash, open_length = [], 0, 0  # the word that reaches the chunk's start
    for at in range(0, len(data), _CHUNK):
        part = data[at : at + _CHUNK]
        n, space = len(part), _IS_SPACE[part]
        edge = np.flatnonzero(space[:-1] > space[1:]) + 1
        starts = edge if space[0] else np.concatenate((np.zeros(1, np.int64), edge))
        hashes = np.empty(0, np.uint64)
        if len(starts):
            values = table[part]
            values *= _POWERS[:n]
            hashes = np.add.reduceat(values, starts)
            hashes *= _INVERSE[starts]
        if open_length:
            if space[0]:
                found.append(np.array([open_hash], np.uint64))
            else:
                shifted = int(hashes[0]) * pow(_BASE, open_length, 1 << 64)
                hashes[0] = np.uint64((open_hash + shifted) & _MASK)
        if space[-1] or not len(starts):
            open_hash = open_length = 0
        else:
            whole = len(starts) == 1 and starts[0] == 0
            open_length = (open_length if whole else 0) + n - int(starts[-1])
            open_hash = int(hashes[-1])
            hashes = hashes[:-1]
        found.append(hashes)
    if open_length:
        found.append(np.array([open_hash], np.uint64))
    return mix(found[0] if len(found) == 1 else np.concatenate(found))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words; none for a shorter text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n] * _GRAM[0]
    for k in range(1, size):
        out += hashes[k : k + n] * _GRAM[k]
    return mix(out)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """The distinct runs of ``size`` words, sorted; a shorter text is one run, an empty one none."""
    if not len(hashes):
        return hashes
    grams = gram_hashes(hashes, min(size, len(hashes)))
    if len(hashes) < size:
        grams = grams ^ np.uint64(len(hashes))
    grams.sort()
    return grams[np.concatenate((np.ones(1, bool), grams[1:] != grams[:-1]))]
