"""Words, their hashes and rolling window hashes of many texts at once, in numpy.

All functions take UTF-8 bytes of texts laid end to end and the offsets of the texts. Separators are
ASCII in every definition of a word used here, so bytes can stand for characters.

Words, lines and texts are hashed by multilinear sums modulo 2**64: each byte's random value times the
random weight of its place, so that two different spans meet with a probability near 2**-64 whatever
their pattern (a polynomial of the bytes would meet for some long words of two letters). Windows of few
words are Rabin-Karp polynomials of such word hashes from prefix sums: a window costs one subtraction
and one multiplication by an inverse power.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Odd multipliers, so that each has an inverse modulo 2**64.
BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93

SPACES = b" \t\n\v\f\r"


def _class(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


#: Bytes of words `[^\x20\x09-\x0D]+`.
SOLID = _class(lambda b: b not in SPACES)
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, of lower-cased text.
ALNUM = _class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: A-Z to a-z, all else as it is.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_places = np.zeros(0, _U)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**n and the inverses of these."""
    got = _tables.get(base)
    if got is None or len(got[0]) <= n:
        size = max(n + 1, 1 << 12)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, _U)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        got = (out[0], out[1])
        if size <= 1 << 22:  # a very long text's table is not kept
            _tables[base] = got
    return got


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


#: A random value of each byte.
_BYTES = mixed((np.arange(256, dtype=_U) + _U(1)) * _U(WORD_BASE))


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each text (and one more) the index of its first word."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = inside[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _weights(n: int) -> np.ndarray:
    """Pseudo-random weights of the places 0 .. n - 1 in a span."""
    global _places
    if len(_places) >= n:
        return _places
    table = mixed((np.arange(max(n, 1 << 12), dtype=_U) + _U(1)) * _U(BYTE_BASE))
    if len(table) <= 1 << 22:  # a very long text's table is not kept
        _places = table
    return table


def _weighed(values: np.ndarray, table: np.ndarray | None, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each span: the sum of its values, each times the weight of its place, mixed with the span's length."""
    sizes = ends - starts
    out = np.zeros(len(starts), _U)
    full = np.flatnonzero(sizes)
    if len(full):
        own = sizes[full]
        begin = np.cumsum(own) - own
        total = int(begin[-1] + own[-1])
        place = np.arange(total) - np.repeat(begin, own)
        at = place + np.repeat(starts[full], own)
        terms = values[at] if table is None else table[values[at]]
        terms *= _weights(int(own.max()))[place]
        out[full] = np.add.reduceat(terms, begin)
    return mixed(out + sizes.astype(_U) * _U(WORD_BASE_2))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, whatever stands around it."""
    return _weighed(data, _BYTES, starts, ends)


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words that start a window inside their text, and how many each text has."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return begin + np.arange(len(begin)), counts


def sequence_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each sequence of word hashes from a start to an end."""
    return _weighed(words, None, starts, ends)


def window_hashes(words: np.ndarray, starts: np.ndarray, width: int, base: int = WORD_BASE) -> np.ndarray:
    """A mixed 64-bit rolling hash of `width` consecutive word hashes from each start."""
    power, inverse = _powers(base, len(words))
    sums = np.zeros(len(words) + 1, _U)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    return mixed((sums[starts + width] - sums[starts]) * inverse[starts])


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """For each of n words: is it in a window that begins at one of `starts` (each given once)?"""
    steps = np.zeros(n + 1, np.int64)
    steps[starts] += 1
    steps[starts + width] -= 1
    return np.cumsum(steps[:n]) > 0


def runs(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (in words) of the maximal runs of True that stay inside a text."""
    if not len(mask):
        z = np.zeros(0, np.int64)
        return z, z
    begin, end = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    cut = first[1:-1]
    cut = cut[(cut > 0) & (cut < len(mask))]
    begin[cut] = mask[cut]
    end[cut - 1] = mask[cut - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text's words."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each, and where each begins (and the end of the last)."""
    sizes = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    index = np.arange(int(at[-1])) + np.repeat(starts - at[:-1], sizes)
    keep = np.ones(int(at[-1]), bool)
    keep[at[1:] - 1] = False
    out[keep] = data[index[keep]]
    return out, at
