"""Document fingerprints by Order MinHash: signatures that follow the edit distance, as they keep the order of what they pick.

A text's elements are its k-mers of code points, each with the number of its occurrence so far. All elements get a 64-bit
hash; component ``i`` of the fingerprint takes the ``l`` elements whose hashes come next from ``i / m`` of the hash range on
(around its end), puts them in the order of the text, and hashes that tuple. So every component is the minimum under a
rotation of one random order, and short texts need no other treatment than long ones.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import mixed

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Sketch:
    """``k``: code points of a k-mer; ``l``: k-mers of a tuple; ``m``: components, each of 16 bits."""

    k: int = 6
    l: int = 2  # noqa: E741
    m: int = 64

    def of(self, points: np.ndarray) -> np.ndarray:
        n = len(points) - self.k + 1
        wide = points.astype(np.uint64)
        if n < 1:  # the whole text as one element
            grams = np.array([len(points)], np.uint64)
            for p in wide:
                grams = mixed(grams * _K1 + p)
            n = 1
        else:
            grams = np.zeros(n, np.uint64)
            for i in range(self.k):
                grams = grams * _K1 + wide[i : i + n] + _K2
            grams = mixed(grams)
        # the number of each k-mer's occurrence: with the position in the low bits, sorting puts equal ones in text order
        bits = np.uint64(max(1, int(n - 1).bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        ranked = np.sort((grams & ~low) | np.arange(n, dtype=np.uint64))
        same = (ranked[1:] & ~low) == (ranked[:-1] & ~low)
        if same.any():
            head = np.concatenate([[0], np.flatnonzero(~same) + 1])
            size = np.diff(np.append(head, n))
            number = np.arange(n) - np.repeat(head, size)
            later = np.flatnonzero(number)
            at = (ranked[later] & low).astype(np.int64)
            grams[at] = mixed(grams[at] + number[later].astype(np.uint64) * _K2)
        start = np.arange(self.m, dtype=np.uint64) * np.uint64(2**64 // self.m)
        if n > 64 * self.m:  # the first few of each component's range are enough
            step = 2**64 // self.m
            few = np.flatnonzero((grams % np.uint64(step)) < np.uint64(step // n * 16 * self.m))
            if (np.bincount((grams[few] // np.uint64(step)).astype(np.int64), minlength=self.m)[: self.m] < self.l).any():
                few = np.arange(n)
        else:
            few = np.arange(n)
        order = few[np.argsort(grams[few], kind="stable")]
        first = np.searchsorted(grams[order], start)
        take = min(self.l, len(order))
        picked = np.sort(order[(first[:, None] + np.arange(take)) % len(order)], axis=1)
        out = np.zeros(self.m, np.uint64)
        for j in range(take):
            out = mixed(out * _K1 + grams[picked[:, j]] + np.uint64(j + 1))
        return (out >> np.uint64(48)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal components."""
    return float(np.count_nonzero(a == b)) / len(a)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def fingerprints(docs: DataFrame, sketch: Sketch = Sketch(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint) of every whole text, as hexadecimal digits; null: as empty. A row for each row."""

    def run(batches):
        for b in batches:
            made = [sketch.of(_points(t or "")).tobytes().hex() for t in b.column(text_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_column), pa.array(made, pa.string())], [id_column, "fingerprint"])

    return docs.select(id_column, text_column).mapInArrow(run, T.StructType([docs.schema[id_column], T.StructField("fingerprint", T.StringType())]))


def with_next(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, int]:
    """Rows dealt to range buckets of descending ids, each bucket followed by the row that comes after it (``after`` = 1):
    the first of the next bucket, or of the first bucket. Texts are shuffled once. Only bucket bounds meet on the driver."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63))).alias("key"), F.col(id_column).isNull().alias("none"), F.coalesce(text_column, F.lit("")).alias("text"))
    n = max(1, docs.rdd.getNumPartitions())
    keys = rows.select("key")
    # Quantiles of a part of the ids only balance the buckets; any bounds give the same rows.
    bounds = np.unique(np.array(keys.approxQuantile("key", [i / n for i in range(1, n)], max(0.2 / n, 1e-4)) if n > 1 else [], np.int64))

    @F.pandas_udf("int")
    def bucket(key):
        import pandas as pd

        return pd.Series(len(bounds) - np.searchsorted(bounds, key.to_numpy()))

    keyed = rows.withColumn("bucket", bucket("key"))
    firsts = sorted((r["bucket"], r["key"]) for r in keys.withColumn("bucket", bucket("key")).groupBy("bucket").agg(F.max("key").alias("key")).collect())
    before = {key: firsts[i - 1][0] for i, (_, key) in enumerate(firsts)}  # the bucket that a first row also closes
    opening = spark.createDataFrame([(k, b) for k, b in before.items()], "key long, closes int")
    # at most a row for each bucket
    both = keyed.join(F.broadcast(opening), "key", "left")
    places = F.when(F.col("closes").isNull(), F.array(F.struct("bucket", F.lit(0).alias("after")))).otherwise(F.array(F.struct("bucket", F.lit(0).alias("after")), F.struct(F.col("closes").alias("bucket"), F.lit(1).alias("after"))))
    dealt = both.select("key", "none", "text", F.explode(places).alias("p")).select("p.bucket", "p.after", "key", "none", "text")
    parts = len(bounds) + 1
    return dealt.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "after", F.desc("key"), "text"), parts


def edited_fingerprints(docs: DataFrame, sketch: Sketch = Sketch(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For every text and the next by descending id (after the last, the first): n_chars, the SHA-256 of its edited text (last
    half replaced by the beginning of the next), both fingerprints, and their likeness: near_edited, near_next.

    Null text: as empty. Rows of one id follow each other by text. A null id comes after all others. No rows: no rows.
    """
    dealt, _ = with_next(docs, id_column, text_column)
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None  # the row whose next one hasn't come yet
        closed = False
        for b in batches:
            out: list[tuple] = []
            for bucket, after, key, none, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "after", "key", "none", "text")), strict=True):
                if held is not None and held[0] != bucket:
                    held, closed = None, False
                if closed:
                    continue
                points = _points(text)
                own = sketch.of(points)
                if held is not None:
                    _, k, empty, was, its, mark = held
                    half = len(its) // 2
                    edited = was[: len(was) - half] + text[:half]
                    other = sketch.of(_points(edited))
                    out.append((None if empty else k, len(its), hashlib.sha256(edited.encode()).hexdigest(), mark.tobytes().hex(), other.tobytes().hex(), likeness(mark, other), likeness(mark, own)))
                held, closed = (bucket, key, none, text, points, own), bool(after)
            columns = [*zip(*out, strict=True)] if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [id_column, *names])

    return dealt.mapInArrow(run, f"`{id_column}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
