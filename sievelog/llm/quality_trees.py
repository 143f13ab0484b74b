"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays.

The statistics of all documents are made in numpy, slice by slice. Trees are fitted on the driver on a bounded sample of
labelled rows, level by level, with gradient histograms of at most BINS values for each statistic. A fitted forest is three
arrays (statistic, threshold, leaf value) of complete trees, which all rows of a slice descend at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import SPACE, char_counts, sliced, words
from .repetition import measure, sums

BINS = 64
#: Labelled rows that trees are fitted on, at most: those of the smallest hashes of their ids.
SAMPLE = 20_000
STATISTICS = (
    "log_words", "mean_word", "longest_word", "symbols", "digits", "upper", "punctuation", "not_ascii", "spaces", "line_feeds",
    "words_a_line", "dup_lines", "dup_line_chars", "repeat_words", "dup_chars_5", "dup_chars_10", "no_letter_words",
)

_CLASS = {
    "digits": np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8)),
    "upper": (np.arange(256) >= 65) & (np.arange(256) <= 90),
    "punctuation": np.isin(np.arange(256), np.frombuffer(b".,;:!?'\"()-", np.uint8)),
    "not_ascii": np.arange(256) >= 192,
    "spaces": SPACE,
    "line_feeds": np.arange(256) == 10,
}
_LETTER = ((np.arange(256) | 32) >= 97) & ((np.arange(256) | 32) <= 122) | (np.arange(256) >= 128)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row for each document, a column for each of STATISTICS; of an empty one, zeros."""
    m = measure(data, off, (5, 10))
    n = np.maximum(char_counts(data, off), 1)
    many, chars, lines = np.maximum(m["words"], 1), np.maximum(m["word_chars"], 1), np.maximum(m["lines"], 1)
    starts, ends, first = words(data, off)
    longest = np.zeros(len(off) - 1)
    some = np.diff(first) > 0
    if some.any():
        longest[some] = np.maximum.reduceat(ends - starts, first[:-1][some])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out = {
        "log_words": np.log1p(m["words"]), "mean_word": m["word_chars"] / many, "longest_word": longest, "symbols": m["symbols"] / many, "words_a_line": m["words"] / lines, "dup_lines": m["dup_lines"] / lines, "dup_line_chars": m["dup_line_chars"] / chars,
        "repeat_words": m["repeat_words"] / many, "dup_chars_5": m["dup_chars_5"] / chars, "dup_chars_10": m["dup_chars_10"] / chars, "no_letter_words": sums(letters[ends] == letters[starts], first) / many,
    } | {k: sums(t[data], off) / n for k, t in _CLASS.items()}
    return np.stack([out[x] for x in STATISTICS], axis=1).astype(np.float64)


@dataclass
class Forest:
    """``feature`` and ``threshold``: (trees, 2 ** depth - 1), a node's children at 2 i + 1 and 2 i + 2; ``leaf``: (trees, 2 ** depth)."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        tree, row = np.arange(trees), np.arange(len(x))[:, None]
        for _ in range(int(inner + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, at - inner].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, least: int = 5) -> Forest:
    """Newton boosting of the logistic loss. Without rows or with one label only, a constant."""
    inner = 2**depth - 1
    mean = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if not len(y) or y.min() == y.max():
        return Forest(feature[:1], threshold[:1], leaf[:1], base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(cut, c, "left") for cut, c in zip(cuts, x.T, strict=True)], axis=1)
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            begin, many = 2**level - 1, 2**level
            best = np.full(many, 1e-9)
            total_g, total_h = (np.bincount(node - begin, v, minlength=many) for v in (g, h))
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                place = (node - begin) * BINS + bins[:, f]
                gl, hl, nl = (np.cumsum(np.bincount(place, v, minlength=many * BINS).reshape(many, BINS), axis=1)[:, : len(cut)] for v in (g, h, None))
                gr, hr, nr = total_g[:, None] - gl, total_h[:, None] - hl, np.bincount(node - begin, minlength=many)[:, None] - nl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                gain = np.where((nl >= least) & (nr >= least), gain, 0)
                top = gain.argmax(axis=1)
                value = gain[np.arange(many), top]
                for i in np.flatnonzero(value > best):
                    best[i], feature[t, begin + i], threshold[t, begin + i] = value[i], f, cut[top[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        end = node - inner
        sums_g, sums_h = (np.bincount(end, v, minlength=inner + 1) for v in (g, h))
        leaf[t] = -rate * sums_g / (sums_h + ridge)
        margin += leaf[t, end]
    return Forest(feature, threshold, leaf, base)


def fold_of(column: str, folds: int):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Forest:
    """Fits on at most ``sample`` labelled rows outside fold 0. Only the text is an input; ids choose rows, labels are learned."""
    chosen = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("double").alias("y")).filter("id is not null and y is not null").filter(fold_of("id", folds) != 0)
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "y").limit(sample)  # bounded, so it may be broadcast
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(chosen), "id").select("id", "y", "text")

    def run(batches):
        for b, data, off in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(list(statistics(data, off)), pa.list_(pa.float64()))], ["id", "y", "x"])

    schema = T.StructType([rows.schema["id"], T.StructField("y", T.DoubleType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    got = rows.mapInArrow(run, schema).orderBy(F.xxhash64("id"), "id", "y", "x").limit(2 * sample).collect()
    return fit(np.array([r["x"] for r in got]).reshape(-1, len(STATISTICS)), np.array([r["y"] for r in got]))


def score_documents(docs: DataFrame, forest: Forest, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of every whole text; null and empty texts have statistics of zero. A row for each row, nothing is shuffled."""

    def run(batches):
        for rows, data, off in sliced(batches, text_column):
            yield pa.RecordBatch.from_arrays([rows.column(id_column), pa.array(forest.score(statistics(data, off)))], [id_column, "score"])

    return docs.select(id_column, text_column).mapInArrow(run, T.StructType([docs.schema[id_column], T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, forest: Forest, least: float = 0.3, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more, with all columns and unchanged."""

    def run(batches):
        for rows, data, off in sliced(batches, text_column):
            yield rows.filter(pa.array(forest.score(statistics(data, off)) >= least))

    return docs.mapInArrow(run, docs.schema)
