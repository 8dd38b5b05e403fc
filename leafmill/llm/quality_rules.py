"""Quality rules as a short-circuit cascade."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .text_stats import Texts

# A rule says which rows to reject.
Rule = Callable[[Texts], np.ndarray]

RULES: dict[str, Rule] = {
    # more marks than two to every five words
    "symbols": lambda t: 5 * t.n_symbols > 2 * t.n_words,
    # most letters are capitals
    "shouting": lambda t: 2 * t.n_upper > t.n_letters,
    # an exclamation mark to every other word
    "exclamations": lambda t: 2 * t.count("!") > t.n_words,
    # more than a third of the lines repeat an earlier one
    "repeated_lines": lambda t: 3 * t.lines[1] > t.lines[0],
    # fewer than one word in twenty is new, in texts long enough to tell
    "few_words": lambda t: (t.n_words >= 100) & (20 * t.n_distinct_words < np.minimum(t.n_words, 2000)),
    # words of a mean length that no prose has
    "word_length": lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 20 * t.n_words),
    # more digits than letters
    "digits": lambda t: t.n_digits > t.n_letters,
}
# Rows of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 2000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    return {"n_words": texts.n_words, "word_chars": texts.word_chars, "n_symbols": texts.n_symbols, "n_dup_lines": texts.lines[1], "n_repeat_words": texts.n_repeat_words}


def plan_cascade(docs: DataFrame, rules: dict[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, rejected share), most rejections per second first.

    Estimated on the ``sample_rows`` documents whose ids hash lowest (rows that share an id count all). The order changes the work, not
    the verdicts: a document stays if no rule rejects it.
    """
    names = list(rules)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            whole = Texts.of(batch.column("text"))
            seconds, rejected = [], []
            for name in names:
                # no counts kept from other rules, so that each pays for itself
                texts = Texts(whole.data, whole.offsets)
                began = time.thread_time()
                out = rules[name](texts)
                seconds.append(time.thread_time() - began)
                rejected.append(int(out.sum()))
            yield pa.RecordBatch.from_pydict({"rule": names, "seconds": seconds, "rejected": rejected, "n": [whole.n] * len(names)})

    # the hashes alone find the cut, so that no texts are sorted
    cut = docs.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample_rows).agg(F.max("h")).scalar()
    sample = docs.where(F.xxhash64("doc_id") <= cut).select(F.coalesce("text", F.lit("")).alias("text"))
    seen = sample.mapInArrow(measure, "rule string, seconds double, rejected long, n long")
    rows = seen.groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r"), F.sum("n").alias("n")).collect()
    known = {r["rule"]: (r["s"] / r["n"], r["r"] / r["n"]) for r in rows if r["n"]}
    costs = [(name, *known.get(name, (0.0, 0.0))) for name in names]
    return sorted(costs, key=lambda x: (-x[2] / max(x[1], 1e-12), x[0]))


def cascade(texts: Texts, alive: np.ndarray, order: list[str], rules: dict[str, Rule]) -> np.ndarray:
    """Which of the ``alive`` rows pass all rules; a rule sees only the texts that are left."""
    alive = alive.copy()
    for name in order:
        left = np.flatnonzero(alive)
        if not len(left):
            break
        alive[left[rules[name](texts.only(alive))]] = False
    return alive


def judge(docs: DataFrame, rules: dict[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept.

    Counts are over the whole text; a null or empty text has none, so it fails the base rule. Only
    documents that pass it meet the cascade, whose order is fitted on a sample by ``plan_cascade``.
    Rows that repeat are judged alike; other columns are not read. An empty table gives no rows.
    """
    order = [name for name, _, _ in plan_cascade(docs, rules, sample_rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = Texts.of(batch.column("text"))
            base = base_counts(texts)
            failed = (base["n_words"] < min_words) | (100 * base["n_repeat_words"] > max_repeat_percent * base["n_words"])
            kept = cascade(Texts(texts.data, texts.offsets), ~failed, order, rules)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(base[c]) for c in BASE], pa.array(failed), pa.array(kept)], ["doc_id", *BASE, "base_failed", "kept"])

    counts = ", ".join(f"{c} long" for c in BASE)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {counts}, base_failed boolean, kept boolean")
