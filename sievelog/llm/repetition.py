"""Quality rules: how many characters of a text stand inside repeated n-grams and lines.

Words get 64-bit hashes, runs of n words rolling combinations of them, all in numpy on slices of many documents at once.
A run counts as repeated if its document has it twice or more; its characters count once, however many runs cover them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import mixed, sliced, span_hashes, windows, words

#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Largest allowed shares. ``ngrams``: of word characters inside repeated runs of so many words, first occurrences
    included; ``lines``: of word characters inside lines that repeat an earlier one; ``symbols``: symbols for each word;
    ``line_count``: of lines that repeat an earlier one. Documents under ``least_words``, or with over ``repeat_words`` of
    their words in repeated 3-word windows, fail the base rules. As longer repeated runs lie inside those windows, the other
    limits have to be well under that share to reject anything."""

    least_words: int = 50
    repeat_words: int = 50
    ngrams: tuple[tuple[int, float], ...] = ((5, 0.30), (7, 0.26), (10, 0.20))
    lines: float = 0.20
    line_count: float = 0.35
    symbols: float = 0.15


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    if not len(keys):
        return np.zeros(0, bool)
    codes, distinct = pd.factorize(keys)
    return (np.bincount(codes, minlength=len(distinct)) > 1)[codes]


def _of_document(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hashes, made different from document to document."""
    return hashes ^ mixed(np.repeat(np.arange(1, len(first), dtype=np.uint64), np.diff(first)) * np.uint64(0x9E3779B97F4A7C15))


def covered(hashes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a run of ``n`` words that their document has twice or more."""
    runs, begin = windows(hashes, first, n)
    per = np.diff(begin)
    at = np.repeat(first[:-1] - begin[:-1], per) + np.arange(len(runs))
    at = at[repeated(_of_document(runs, begin))]
    depth = np.bincount(at, minlength=len(hashes) + 1).astype(np.int64) - np.bincount(at + n, minlength=len(hashes) + 1 + n)[: len(hashes) + 1]
    return np.cumsum(depth)[: len(hashes)] > 0


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over the runs that begin at ``first``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[first])


def lines_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines between line feeds, without empty ones, and the first of each document."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = data != 10
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def measure(data: np.ndarray, off: np.ndarray, ngrams: tuple[int, ...] = (5, 7, 10)) -> dict[str, np.ndarray]:
    """Counts of each document: words, word_chars, symbols, lines (with a word), dup_lines, dup_line_chars, repeat_words (in
    repeated 3-word windows), and chars in repeated n-grams as ``dup_chars_<n>``."""
    starts, ends, first = words(data, off)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]
    out = {"words": np.diff(first), "word_chars": sums(chars, first)}
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    out["symbols"] = sums(table[data] if len(data) else np.zeros(0, np.int64), off)
    from_, to, line_first = lines_of(data, off)
    begun = np.searchsorted(starts, from_)
    has = np.searchsorted(starts, to) - begun
    total = np.concatenate([[0], np.cumsum(chars)])
    line_chars = total[begun + has] - total[begun]
    full = has > 0
    doc = np.repeat(np.arange(len(off) - 1), np.diff(line_first))[full]
    keys = _of_document(span_hashes(data, from_, to), line_first)[full]
    later = pd.Series(keys).duplicated().to_numpy() if len(keys) else np.zeros(0, bool)
    out["lines"] = np.bincount(doc, minlength=len(off) - 1)
    out["dup_lines"] = np.bincount(doc[later], minlength=len(off) - 1)
    out["dup_line_chars"] = np.bincount(doc[later], line_chars[full][later], minlength=len(off) - 1).astype(np.int64)
    hashes = span_hashes(data, starts, ends)
    out["repeat_words"] = sums(covered(hashes, first, 3), first)
    for n in ngrams:
        out[f"dup_chars_{n}"] = sums(chars * covered(hashes, first, n), first)
    return out


def verdict(m: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)"""
    failed = (m["words"] < rules.least_words) | (100 * m["repeat_words"] > rules.repeat_words * m["words"])
    kept = ~failed
    for n, most in rules.ngrams:
        kept &= m[f"dup_chars_{n}"] <= most * m["word_chars"]
    kept &= m["dup_line_chars"] <= rules.lines * m["word_chars"]
    kept &= m["dup_lines"] <= rules.line_count * m["lines"]
    kept &= m["symbols"] <= rules.symbols * m["words"]
    return failed, kept


def judge_documents(docs: DataFrame, rules: Rules = Rules(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The measures and the verdict for every whole text: a row for each row.

    Null and empty texts have no words and fail. Nothing is shuffled, so no key can be hot; a long text is one row of one
    task. Columns besides the two named aren't looked at.
    """
    names = ["words", "word_chars", "symbols", "lines", "dup_lines", "dup_line_chars", "repeat_words", *(f"dup_chars_{n}" for n, _ in rules.ngrams)]
    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in names) + ", base_failed boolean, kept boolean"

    def run(batches):
        for rows, data, off in sliced(batches, text_column):
            m = measure(data, off, tuple(n for n, _ in rules.ngrams))
            failed, kept = verdict(m, rules)
            yield pa.RecordBatch.from_arrays([rows.column(id_column), *(pa.array(m[x], pa.int64()) for x in names), pa.array(failed), pa.array(kept)], [id_column, *names, "base_failed", "kept"])

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def keep_good(docs: DataFrame, rules: Rules = Rules(), text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the rules keep, with all columns and unchanged."""

    def run(batches):
        for rows, data, off in sliced(batches, text_column):
            _, kept = verdict(measure(data, off, tuple(n for n, _ in rules.ngrams)), rules)
            yield rows.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
