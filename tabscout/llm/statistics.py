"""Counts of whole texts, many at once, in numpy: what the quality operators are made of."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tabscout.llm import kernels as K
from tabscout.llm.shared import text_pieces

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_DIGIT = np.isin(np.arange(256), np.arange(0x30, 0x3A))
_UPPER = np.isin(np.arange(256), np.arange(0x41, 0x5B))
_PUNCT = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
#: Bytes that begin a character.
_LEAD = (np.arange(256) & 0xC0) != 0x80
_LINE = np.arange(256) != 0x0A


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: does it occur elsewhere too; does it occur before?"""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    twice, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the \\n-split lines that have a word, the words of each, and the first line of each text."""
    starts, ends, _ = K.spans(data, offsets, _LINE)
    words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
    full = words > 0
    starts, ends, words = starts[full], ends[full], words[full]
    return starts, ends, words, np.searchsorted(starts, offsets)


class TextCounts:
    """Of one piece of texts: int64 arrays with a value for each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        n = len(offsets) - 1
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.first = K.spans(data, offsets, K.SOLID)
        self.hashes = K.span_hashes(data, self.starts, self.ends)
        self.n_words = np.diff(self.first)
        lead = _LEAD[data]
        self.n_chars = _per_text(lead, offsets)
        self.word_chars = _per_text(lead & K.SOLID[data], offsets)
        self.n_symbols = _per_text(_SYMBOL[data], offsets)
        text = K.mixed(np.arange(n, dtype=np.uint64) + np.uint64(1))
        at, counts = K.window_starts(self.first, 3)
        windows = K.window_hashes(self.hashes, at, 3) ^ np.repeat(text, counts)
        twice, _ = _again(windows)
        self.n_repeat_words = K.sums_by_text(K.covered(len(self.starts), at[twice], 3), self.first)
        self.line_starts, self.line_ends, self.line_words, self.line_first = lines(data, offsets, self.starts)
        exact = K.span_hashes(data, self.line_starts, self.line_ends) ^ np.repeat(text, np.diff(self.line_first))
        self.n_lines = np.diff(self.line_first)
        _, later = _again(exact)
        self.n_dup_lines = K.sums_by_text(later, self.line_first)

    def counts_of(self, which: str) -> np.ndarray:
        table = {"digits": _DIGIT, "upper": _UPPER, "punctuation": _PUNCT, "stops": _STOP}[which]
        return _per_text(table[self.data], self.offsets)

    def distinct_words(self) -> np.ndarray:
        text = K.mixed(np.arange(len(self.n_words), dtype=np.uint64) + np.uint64(1))
        _, later = _again(self.hashes ^ np.repeat(text, self.n_words))
        return self.n_words - K.sums_by_text(later, self.first)


def counted(column: pa.Array) -> Iterator[tuple[int, int, TextCounts]]:
    """(first text, end text, counts) of each piece of a column."""
    for lo, hi, data, offsets in text_pieces(column):
        yield lo, hi, TextCounts(data, offsets)
