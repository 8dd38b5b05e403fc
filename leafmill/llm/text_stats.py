"""Counts over whole texts, for all rows of an Arrow batch at once."""

from __future__ import annotations

import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

from .common import Rolling, mix64, text_bytes, word_spans


# Kinds of characters, by Unicode category.
UPPER, LOWER, LETTER, DIGIT = 1, 2, 3, 4


def _kind(point: int) -> int:
    category = unicodedata.category(chr(point))
    return {"Lu": UPPER, "Lt": UPPER, "Ll": LOWER, "Lo": LETTER, "Lm": LETTER, "Nd": DIGIT}.get(category, 0)


@lru_cache(maxsize=1)
def character_kinds() -> np.ndarray:
    """The kind of each code point up to U+FFFF."""
    return np.fromiter(map(_kind, range(0x10000)), np.uint8, 0x10000)


class Texts:
    """The texts of a batch as bytes laid end to end; every count has one number per row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n = len(offsets) - 1

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        return cls(*text_bytes(column))

    def only(self, rows: np.ndarray) -> Texts:
        """The texts of the rows where ``rows`` is true."""
        if rows.all():
            return self
        lengths = np.diff(self.offsets)
        return Texts(self.data[np.repeat(rows, lengths)], np.concatenate([[0], np.cumsum(lengths[rows])]))

    def per_row(self, marks: np.ndarray) -> np.ndarray:
        """How many of the marked bytes each row has."""
        sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    @cached_property
    def blank(self) -> np.ndarray:
        return (self.data == 32) | ((self.data >= 9) & (self.data <= 13))

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return word_spans(self.data, self.offsets)

    @cached_property
    def rolling(self) -> Rolling:
        return Rolling(self.data)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return self.rolling.of(*self.words[:2])

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.words[2], minlength=self.n)[: self.n].astype(np.int64)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.per_row(~self.blank & ((self.data & 0xC0) != 0x80))

    def count(self, characters: str) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(characters.encode("ascii"))] = True
        return self.per_row(table[self.data])

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.count("#*$%&|<>")

    @cached_property
    def _kinds(self) -> np.ndarray:
        """The kind of each character, at its first byte; 0 at all other bytes."""
        table = character_kinds()
        kinds = table[self.data]
        kinds[self.data >= 0x80] = 0
        if (self.data >= 0x80).any():
            points = np.frombuffer(self.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            found = table[np.minimum(points, 0xFFFF)]
            for point in np.unique(points[points > 0xFFFF]).tolist():
                found[points == point] = _kind(point)
            kinds[(self.data & 0xC0) != 0x80] = found
        return kinds

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self.per_row(self._kinds == UPPER)

    @cached_property
    def n_lower(self) -> np.ndarray:
        return self.per_row(self._kinds == LOWER)

    @cached_property
    def n_letters(self) -> np.ndarray:
        """Letters of all scripts, with case or without."""
        return self.per_row((self._kinds >= UPPER) & (self._kinds <= LETTER))

    @cached_property
    def n_digits(self) -> np.ndarray:
        return self.per_row(self._kinds == DIGIT)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of lines with a word, those equal to an earlier line) of each row."""
        breaks = np.flatnonzero(self.data == 10)
        # a break that ends a text starts no line of the next one
        starts = np.unique(np.concatenate([self.offsets[:-1], breaks + 1]))
        row = np.searchsorted(self.offsets[1:], starts, side="right")
        # a start at a row's end belongs to that row's last, empty line
        inner = row < self.n
        starts, row = starts[inner], row[inner]
        at = np.searchsorted(breaks, starts)
        stop = np.where(at < len(breaks), breaks[np.minimum(at, len(breaks) - 1)] if len(breaks) else len(self.data), len(self.data))
        ends = np.minimum(stop, self.offsets[row + 1])
        filled = np.concatenate([[0], np.cumsum(~self.blank)])
        some = filled[ends] > filled[starts]
        starts, ends, row = starts[some], ends[some], row[some]
        total = np.bincount(row, minlength=self.n)[: self.n]
        keys = mix64(self.rolling.of(starts, ends) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(keys, return_index=True)
        distinct = np.bincount(row[first], minlength=self.n)[: self.n]
        return total.astype(np.int64), (total - distinct).astype(np.int64)

    def _by_row(self, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return mix64(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    @cached_property
    def n_distinct_words(self) -> np.ndarray:
        row = self.words[2]
        _, first = np.unique(self._by_row(self.word_hashes, row), return_index=True)
        return np.bincount(row[first], minlength=self.n)[: self.n].astype(np.int64)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words inside 3-word windows that the text has twice or more."""
        h, row = self.word_hashes, self.words[2]
        covered = np.zeros(len(h), bool)
        if len(h) >= 3:
            whole = row[:-2] == row[2:]
            windows = mix64(mix64(mix64(h[:-2]) + h[1:-1]) + h[2:])
            keys = self._by_row(windows, row[:-2])
            at = np.flatnonzero(whole)
            order = at[np.argsort(keys[at])]
            twice = np.zeros(len(order), bool)
            if len(order) > 1:
                same = keys[order[1:]] == keys[order[:-1]]
                twice[1:] |= same
                twice[:-1] |= same
            hit = order[twice]
            for i in range(3):
                covered[hit + i] = True
        return np.bincount(row[covered], minlength=self.n)[: self.n].astype(np.int64)
