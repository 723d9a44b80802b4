"""Counts over whole texts, many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np

from .common import mixed, prefix_hash, span_hash, word_spans

#: Characters that count as symbols (fixed value).
SYMBOLS = b"#*$%&|<>"
WINDOW = 5


def table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


IS_SYMBOL = table(SYMBOLS)
IS_SPACE = table(b"\t\n\x0b\x0c\r ")
IS_UPPER, IS_DIGIT = table(bytes(range(65, 91))), table(bytes(range(48, 58)))
IS_PUNCT = table(b"!\"'(),-./:;?[]_`{}~@\\^+=")


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[at[1:]] - sums[at[:-1]]


def repeats(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to an earlier value of its row, equal to any other value of its row) for each position; rows ascend."""
    key = mixed(value + (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    later, other = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    other[order[1:]] |= same
    other[order[:-1]] |= same
    return later, other


class Texts:
    """Words of the texts that lie one after another in body, at the offsets at."""

    def __init__(self, body: np.ndarray, at: np.ndarray):
        self.body, self.at, self.n = body, at, len(at) - 1
        self.lo, self.hi, self.row = word_spans(body, at)
        self.sums = prefix_hash(body)
        self.words = span_hash(self.sums, self.lo, self.hi)
        self.n_words = np.bincount(self.row, minlength=self.n)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of `size` words within a text."""
        m = len(self.words) - size + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ok = np.flatnonzero(self.row[size - 1 :] == self.row[:m])
        value = self.words[ok].copy()
        for k in range(1, size):
            value = mixed(value * np.uint64(0xFF51AFD7ED558CCD | 1) + self.words[ok + k])
        return ok, value

    def word_chars(self) -> np.ndarray:
        return per_text(((self.body & 0xC0) != 0x80) & ~IS_SPACE[self.body], self.at)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, row) of the \\n-split lines that hold a word."""
        cut = np.flatnonzero(self.body == 10)
        lo = np.union1d(self.at[:-1][np.diff(self.at) > 0], cut + 1)
        lo = lo[lo < len(self.body)]
        row = np.searchsorted(self.at, lo, "right") - 1
        ends = np.append(cut, len(self.body))
        hi = np.minimum(ends[np.searchsorted(ends, lo)], self.at[row + 1])
        has = np.searchsorted(self.lo, hi) > np.searchsorted(self.lo, lo)
        return lo[has], hi[has], row[has]

    def dup_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(lines with a word, those equal to an earlier one) of each text."""
        lo, hi, row = self.lines()
        later, _ = repeats(row, span_hash(self.sums, lo, hi))
        return np.bincount(row, minlength=self.n), np.bincount(row[later], minlength=self.n)

    def repeat_words(self, size: int = WINDOW) -> np.ndarray:
        """Words in windows of `size` words found twice or more in the text."""
        at, value = self.grams(size)
        _, other = repeats(self.row[at], value)
        mark = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(mark, at[other], 1)
        np.add.at(mark, at[other] + size, -1)
        return np.bincount(self.row[np.cumsum(mark[:-1]) > 0], minlength=self.n)

    def distinct_words(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct words, occurrences of words met before) of each text."""
        later, _ = repeats(self.row, self.words)
        n = np.bincount(self.row[later], minlength=self.n)
        return self.n_words - n, n
