"""Language identification by cross-parsing entropy on suffix automata."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, fresh, release_memory, slices, small_batches, text_bytes

# Symbols of labelled text per language, and the documents it is taken from.
REFERENCE_SYMBOLS = 30_000
REFERENCE_DOCS = 60
REFERENCE_DOC_CHARS = 20_000
# A phrase ends at every WINDOW symbols, so that windows of all texts are parsed side by side.
WINDOW_SYMBOLS = 512
SLICE_BYTES = 1 << 20
UNDETERMINED = "und"
# Automata over more letters than this have sparse transitions.
DENSE_LETTERS = 200
_DROP = -1


class Alphabet:
    """Numbers for code points: 0 a blank, then the letters in use, then one for all other letters."""

    def __init__(self, letters: list[str]):
        self.known = {c: i + 1 for i, c in enumerate(letters)}
        self.unknown = len(letters) + 1
        self.size = self.unknown + 1
        self.table = np.fromiter((self._number(chr(c)) for c in range(0x10000)), np.int32, 0x10000)

    def _number(self, c: str) -> int:
        if c.isalpha():
            return self.known.get(c.lower()[0], self.unknown)
        return _DROP if unicodedata.category(c)[0] == "M" else 0

    def numbers(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, row of each): blanks that follow a blank or begin a text, and marks, are left out."""
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        first = np.flatnonzero((data & 0xC0) != 0x80)
        row = np.searchsorted(offsets[1:], first, side="right")
        symbols = self.table[np.minimum(points, 0xFFFF)]
        high = np.flatnonzero(points > 0xFFFF)
        if len(high):
            found, at = np.unique(points[high], return_inverse=True)
            symbols[high] = np.array([self._number(chr(c)) for c in found], np.int32)[at]
        stay = symbols != _DROP
        symbols, row = symbols[stay], row[stay]
        blank = symbols == 0
        doubled = blank.copy()
        doubled[1:] &= blank[:-1] | (row[1:] != row[:-1])
        return symbols[~doubled], row[~doubled]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of ``symbols`` from state 0."""
    moves: list[dict[int, int]] = [{}]
    links, lengths = [-1], [0]
    last = 0
    for s in symbols:
        state = len(moves)
        moves.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        p = last
        while p >= 0 and s not in moves[p]:
            moves[p][s] = state
            p = links[p]
        if p >= 0:
            q = moves[p][s]
            if lengths[p] + 1 == lengths[q]:
                links[state] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                while p >= 0 and moves[p].get(s) == q:
                    moves[p][s] = copy
                    p = links[p]
                links[q] = links[state] = copy
        last = state
    return moves


class Dense:
    """Automata of few letters each: one table of transitions, with a column for each letter of a language."""

    def __init__(self, rows: list[int], automata: list[list[dict[int, int]]], size: int):
        self.rows = rows
        letters = [sorted({s for row in moves for s in row if s < size - 1}) for moves in automata]
        self.width = max(map(len, letters)) + 1
        # the last column is that of letters which the language lacks
        self.columns = np.full((len(automata), size), self.width - 1, np.int32)
        tables = [np.full((1, self.width), -1, np.int32)]
        self.starts = np.zeros((len(automata), size), np.int32)
        base = 1
        for n, (moves, own) in enumerate(zip(automata, letters, strict=True)):
            self.columns[n, own] = np.arange(len(own))
            column = {s: i for i, s in enumerate(own)}
            table = np.full((len(moves), self.width), -1, np.int32)
            for state, row in enumerate(moves):
                for s, to in row.items():
                    if s in column:
                        table[state, column[s]] = to + base
            self.starts[n, own] = table[0, : len(own)]
            tables.append(table)
            base += len(moves)
        self.flat = np.concatenate(tables).ravel()

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self.flat[state.astype(np.int64) * self.width + self.columns[:, c]]


class Sparse:
    """Automata of many letters: the transitions that there are, sorted by state and letter."""

    def __init__(self, rows: list[int], automata: list[list[dict[int, int]]], size: int):
        self.rows, self.size = rows, size
        self.starts = np.zeros((len(automata), size), np.int32)
        keys, targets = [], []
        base = 1
        for n, moves in enumerate(automata):
            for s, to in moves[0].items():
                if s < size - 1:
                    self.starts[n, s] = to + base
            for state, row in enumerate(moves):
                kept = [(s, to) for s, to in row.items() if s < size - 1]
                keys += [(state + base) * size + s for s, _ in kept]
                targets += [to + base for _, to in kept]
            base += len(moves)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.targets = np.array(keys, np.int64)[order], np.array(targets, np.int32)[order]

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.size + c
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], -1)


class CrossParser:
    """Suffix automata of one reference text per language.

    State 0 reads nothing: a symbol that a language lacks is a phrase of its own.
    """

    def __init__(self, references: dict[str, list[str]], dense_letters: int = DENSE_LETTERS):
        self.languages = sorted(references)
        used = sorted({c.lower()[0] for texts in references.values() for text in texts for c in text if c.isalpha()})
        self.alphabet = Alphabet(used)
        size = self.alphabet.size
        self.bits = []
        groups: dict[type, tuple[list, list]] = {Dense: ([], []), Sparse: ([], [])}
        for n, name in enumerate(self.languages):
            reference: list[int] = []
            for text in references[name]:
                data, offsets = text_bytes(pa.array([text]))
                # a symbol that no text has stands between documents
                reference += [*self.alphabet.numbers(data, offsets)[0].tolist(), size]
            reference = reference[: REFERENCE_SYMBOLS + 1]
            rows, automata = groups[Dense if len(set(reference)) <= dense_letters else Sparse]
            rows.append(n)
            automata.append(suffix_automaton(reference))
            self.bits.append(np.log2(max(len(reference), 2)))
        self.groups = [kind(rows, automata, size) for kind, (rows, automata) in groups.items() if rows]

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases of each row in each language, letters of each row).

        A phrase is the longest text that the reference has; all windows advance by one symbol a step.
        """
        n = len(offsets) - 1
        symbols, row = self.alphabet.numbers(data, offsets)
        letters = np.bincount(row[symbols > 0], minlength=n)[:n]
        per_row = np.bincount(row, minlength=n)[:n]
        windows = -(-per_row // WINDOW_SYMBOLS)
        owner = np.repeat(np.arange(n), windows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = (np.cumsum(per_row) - per_row)[owner] + nth * WINDOW_SYMBOLS
        length = np.minimum(per_row[owner] - nth * WINDOW_SYMBOLS, WINDOW_SYMBOLS)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        active = np.searchsorted(-length, -np.arange(WINDOW_SYMBOLS), side="left")
        totals = np.zeros((len(self.languages), n), np.int64)
        for group in self.groups:
            state = np.zeros((len(group.rows), len(owner)), np.int32)
            count = np.zeros(state.shape, np.int32)
            for t in range(int(length.max(initial=0))):
                k = active[t]
                c = symbols[start[:k] + t]
                to = group.step(state[:, :k], c)
                ended = to < 0
                count[:, :k] += ended
                state[:, :k] = np.where(ended, group.starts[:, c], to)
            for i, language in enumerate(group.rows):
                totals[language] = np.bincount(owner, weights=count[i], minlength=n)[:n]
        return totals, letters

    def identify(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        totals, letters = self.phrases(data, offsets)
        n = len(offsets) - 1
        if not self.languages:
            return [UNDETERMINED] * n, np.zeros(n)
        cost = totals * np.array(self.bits)[:, None]
        best = cost.argmin(axis=0)
        least = cost[best, np.arange(n)]
        if len(self.languages) > 1:
            second = np.partition(cost, 1, axis=0)[1]
            score = 1 - least / np.maximum(second, 1e-300)
        else:
            score = np.ones(n)
        found = letters > 0
        names = np.array(self.languages, dtype=object)[best]
        names[~found] = UNDETERMINED
        return names.tolist(), np.where(found, np.clip(score, 0, 1), 0.0)


def reference_texts(docs: DataFrame, folds: int = 3, held_fold: int = 1, docs_per_language: int = REFERENCE_DOCS, doc_chars: int = REFERENCE_DOC_CHARS) -> dict[str, list[str]]:
    """Labelled texts to learn from, bounded per language: the ``docs_per_language`` documents whose ids
    hash lowest, of those outside the held-out fold; of a longer one the first ``doc_chars`` characters."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held_fold))
    ranked = labelled.select("lang", F.substring("text", 1, doc_chars).alias("text"), F.xxhash64("doc_id", F.lit("reference")).alias("h"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    texts: dict[str, list[str]] = {}
    for row in ranked.withColumn("n", first).where(F.col("n") <= docs_per_language).orderBy("lang", "n").collect():
        texts.setdefault(row["lang"], []).append(row["text"])
    return texts


def identify_languages(docs: DataFrame, references: dict[str, list[str]]) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score.

    The language whose reference covers the whole text with the fewest phrases wins, a phrase counting
    as the log of the reference's length; ties go to the smaller code. ``score`` is one less the ratio
    to the second best, 1 with one language only. Null texts, and texts without a letter, are ``und``
    with score 0, and so is all with no reference. Rows alike get the same result; other columns pass
    through, except for those named like the two new ones. An empty table gives no rows.

    Only texts go to Python and only verdicts come back. A task makes the automata anew and lets go of
    them at its end.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def identified(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = CrossParser(references)
        for column in columns:
            names: list[str] = []
            scores = [np.zeros(0)]
            for part in slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text", SLICE_BYTES):
                found, score = parser.identify(*text_bytes(part.column("text")))
                names += found
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["lang_pred", "score"])
        del parser
        release_memory()

    found = fresh("found", keep)
    # else the optimizer may run it once for a filter and once more for the result
    verdict = identified.asNondeterministic()(F.col("text"))
    kept = [f"`{c}`" for c in keep]
    return docs.select(*kept, verdict.alias(found)).select(*kept, f"{found}.lang_pred", f"{found}.score")
