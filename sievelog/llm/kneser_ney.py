"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, stored as sorted hash arrays, mapped into memory to score.

The first round counts words and numbers them, frequent ones first, so that numbers take little room. The second counts
n-grams of the highest order. A trigram (u, v, w) goes to a shard of its middle word v, so that all of a context (u, v) and
all that stands before (v, w) meet there: the shard stores counts and contexts, and passes on the pairs (v, w) with the
number of different words before them. Where v is frequent, its trigrams are spread over several shards by u and w, and
sums of contexts and pairs are made in the next exchange. Pairs go to shards of their hash; what they add to their two words
is summed in a last exchange. Scoring looks up the words, pairs and trigrams of a slice of text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, mixed, sliced, span_hashes, words
from .repetition import sums
from .shared import BLOBS, FAN, Compact, Store, Tally, blobs, counted, joined, reduced, remove, shard_of, shared_folder, shards_for, summed

#: The hash that stands for the end of a text (no word's, but with the chance of any 64-bit collision).
END = np.uint64(0xE0D0_F7E7_5EED_0001)
#: A middle word's trigrams are spread over one shard more for each so many occurrences.
HOT = 1_000_000
#: N-grams that a task holds before it adds equal ones up, and distinct ones before it passes them on.
FLUSH, HELD = 1_600_000, 1_000_000
#: What the second exchange carries.
PAIR, CONTEXT, COUNTS = range(3)

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of numbers, of any size."""
    return mixed(mixed(a.astype(np.uint64) + _A) * _B + b.astype(np.uint64))


def three(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mixed(two(a, b) * _A + c.astype(np.uint64) + _B)


def spread(keys: np.ndarray) -> np.ndarray:
    """Routes of keys to shards, apart from the bits that look-ups use."""
    return mixed(keys ^ _B)


def middle(u: np.ndarray, v: np.ndarray, w: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Routes of trigrams by their middle word and, if that has several shares, one of them."""
    share = np.where(shares > 1, two(u, w) % shares.astype(np.uint64), np.uint64(0))
    return two(v, share)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each document with END after them, and the first of each document."""
    data = LOWER[data]
    starts, ends, first = words(data, off)
    own = span_hashes(data, starts, ends)
    at = first + np.arange(len(first))
    out = np.full(int(at[-1]), END)
    keep = np.ones(len(out), bool)
    keep[at[1:] - 1] = False
    out[keep] = own
    return out, at


def before(values: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """The value of the token before each one; ``start`` before a document's first."""
    out = np.empty(len(values), np.int64)
    out[1:] = values[:-1]
    out[first[:-1]] = start
    return out


def discounts(n: np.ndarray) -> np.ndarray:
    """For counts of 0, 1, 2 and over: what is taken off, from how many keys have a count of 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1:
        return np.array([0, 0.5, 0.75, 0.75])  # too little to tell
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2 if n2 else d1
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return np.array([0, min(max(d1, 0.05), 0.99), min(max(d2, 0.05), 1.95), min(max(d3, 0.05), 2.9)])


def of_contexts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct contexts, the sums of their counts, and how many of those are 1, 2 and more."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(at):
        return keys, *[np.zeros(0, np.uint64)] * 4
    return keys[at], *(np.add.reduceat(x, at, dtype=np.uint64) for x in (counts, counts == 1, counts == 2, counts > 2))


def frequencies(counts: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(counts == i)) for i in (1, 2, 3, 4)]


class _Numbered(Store):
    """Words by hash with count and rank within their shard."""

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words, and their numbers from 1 on, frequent words first (-1: not in the training texts; 0 is for the start
        of a text)."""
        count, rank = self.find(hashes, np.int64(0), np.int64(-1))
        return count, np.where(rank >= 0, rank * self.shards + shard_of(hashes, self.shards) + 1, -1)


@dataclass
class Model:
    order: int
    share: int  # occurrences of a middle word for each shard that its trigrams are spread over
    words: _Numbered
    by_word: Store  # of a word as the left of pairs: total, pairs of count 1, 2, more; as the right: different words before it
    pairs: Compact  # (left, right) -> count; of order 3: different words before the pair
    contexts: Compact | None  # (u, v) -> total, trigrams of count 1, 2, more
    hot: Compact | None  # the same, if v is frequent
    trigrams: Compact | None
    tokens: int
    distinct: int
    highest: np.ndarray  # discounts of trigrams
    followers: np.ndarray  # discounts of pairs
    lowest: np.ndarray  # discounts of the numbers of predecessors
    kinds: int  # different pairs
    rest: float  # mass of the lowest order that goes to all words evenly

    def score(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token: its count in training, and its log10 probability after the tokens before it."""
        codes, distinct = pd.factorize(hashes)
        counts, numbers = self.words.numbers(distinct)
        stats = np.array(self.by_word.find(mixed(numbers.astype(np.uint64)), *[np.int64(0)] * 5))
        stats[:, numbers < 0] = 0
        start = np.array([int(x[0]) for x in self.by_word.find(mixed(np.zeros(1, np.uint64)), *[np.int64(0)] * 5)])
        seen = stats[4]
        p = (np.maximum(seen - self.lowest[np.minimum(seen, 3)], 0) / max(self.kinds, 1) + self.rest / (self.distinct + 1))[codes]

        # pairs: the last entry of each array of statistics is the start's, the entry before is no word's
        place = before(codes, first, len(distinct))
        table = np.concatenate([stats, start[:, None]], axis=1)
        number = np.append(numbers, 0)
        total, *f = (table[k][place] for k in range(4))
        w, v = numbers[codes], number[place]
        n = np.zeros(len(w), np.int64)
        ask = np.flatnonzero((w > 0) & (v >= 0) & (total > 0))
        keys = two(v[ask], w[ask])
        which, some = pd.factorize(keys)
        n[ask] = self.pairs.find(spread(some), some)[0][which]
        p = self._with(p, n, total, f, self.followers)
        if self.order == 2:
            return counts[codes], np.log10(p)

        # trigrams
        u = number[before(place, first, len(distinct))]
        shares = (1 + np.append(counts, 0) // self.share)[place]
        known = np.flatnonzero((u >= 0) & (v >= 0))
        context, route = two(u[known], v[known]), two(v[known], np.zeros(len(known), np.uint64))
        which, some = pd.factorize(context)
        at = np.empty(len(some), np.int64)
        at[which] = np.arange(len(which))
        hot = shares[known][at] > 1
        found = np.zeros((4, len(some)), np.int64)
        found[:, ~hot] = self.contexts.find(route[at][~hot], some[~hot])
        found[:, hot] = self.hot.find(spread(some[hot]), some[hot])
        total, *f = (np.zeros(len(w), np.int64) for _ in range(4))
        for k, a in enumerate((total, *f)):
            a[known] = found[k][which]
        n = np.zeros(len(w), np.int64)
        ask = np.flatnonzero((total > 0) & (w > 0))
        n[ask] = self.trigrams.find(middle(u[ask], v[ask], w[ask], shares[ask]), three(u[ask], v[ask], w[ask]))[0]
        return counts[codes], np.log10(self._with(p, n, total, f, self.highest))

    @staticmethod
    def _with(lower: np.ndarray, n: np.ndarray, total: np.ndarray, f: list[np.ndarray], d: np.ndarray) -> np.ndarray:
        """Probabilities of an order from those of the order below it; unchanged where the context is unknown."""
        whole = np.maximum(total, 1)
        back = (d[1] * f[0] + d[2] * f[1] + d[3] * f[2]) / whole
        return np.where(total > 0, np.maximum(n - d[np.minimum(n, 3)], 0) / whole + back * lower, lower)


def _payloads(kind: int, made):
    for b in made:
        yield b.add_column(1, "kind", pa.array([kind] * b.num_rows, pa.int32()))


def _row(shard: int, kind: int, n: int, numbers: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([kind], pa.int32()), pa.array([None], pa.binary()), pa.array([n], pa.int64()), pa.array([numbers], pa.list_(pa.int64()))], ["shard", "kind", "payload", "n", "numbers"])


def _wide(made):
    """Payload rows in the schema of ``_row``."""
    for b in made:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.list_(pa.int64()))], ["shard", "kind", "payload", "n", "numbers"])


LEVEL = "shard int, kind int, payload binary, n long, numbers array<long>"


def train(docs: DataFrame, text_column: str = "text", order: int = 3, share: int = HOT) -> Model:
    """Counts all texts of ``docs``; ``order``: 2 or 3 words. Null text: as empty, which still has an end. Repeated rows count
    each; without rows every token is as likely as any other. Other columns aren't looked at."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    docs = docs.select(text_column)
    shards = shards_for(docs)
    root = shared_folder(spark, "kneser-ney")
    known = _Numbered(f"{root}/words", shards, ("count", "number"))

    def count_words(batches):
        tally = Tally(shards)
        for _, data, off in sliced(batches, text_column):
            yield from tally.add(*counted(tokens(data, off)[0]))
        yield from tally.flush()

    def fold_words(shard, parts):
        keys, counts = summed(*joined(parts))
        counts = counts.astype(np.int64)
        rank = np.empty(len(keys), np.uint32)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(keys), dtype=np.uint32)
        known.write(shard, keys, counts.astype(np.min_scalar_type(int(counts.max()))), rank)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())]})

    rows = known.fill(docs.mapInArrow(count_words, BLOBS), fold_words, ", total long")
    n_tokens, distinct = sum(r["total"] for r in rows), int(known.sizes.sum())
    kind_of_number = np.min_scalar_type((int(known.sizes.max()) + 1) * shards)

    def numbered(data, off):
        hashes, first = tokens(data, off)
        codes, some = pd.factorize(hashes)
        count, number = known.numbers(some)
        return codes, np.append(number, 0).astype(kind_of_number), np.append(count, 0), first, len(some)

    # the second round: n-grams of the highest order
    pairs = Compact(f"{root}/pairs", shards, 1)
    contexts, hot, trigrams = (Compact(f"{root}/{x}", shards, n) for x, n in (("contexts", 4), ("hot", 4), ("trigrams", 1)))

    def merged(parts):
        key, *rest, counts = joined(parts)
        order_ = np.argsort(key)
        key = key[order_]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        if len(at):
            counts = np.add.reduceat(counts[order_], at, dtype=np.uint64)
            counts = counts.astype(np.uint32 if int(counts.max()) < 1 << 32 else np.uint64)
        return [key[at], *(x[order_[at]] for x in rest), counts]

    def count_grams(batches):
        """Payloads by route: of trigrams (v, u, w, whether v has several shares, count), of pairs (v, w, count)."""
        parts, n = [], 0

        def give(merged_):
            _, route, *rest = merged_
            by = np.lexsort((*reversed(rest[:order]), shard_of(route, min(shards, FAN))))
            return blobs(shards, route[by], *(x[by] for x in rest), keyless=True)

        for _, data, off in sliced(batches, text_column, known.slice_bytes):
            codes, number, count, first, start = numbered(data, off)
            place = before(codes, first, start)
            w, v = number[codes], number[place]
            if order == 2:
                key = two(v, w)
                part = [key, spread(key), v, w, np.ones(len(w), np.uint32)]
            else:
                u, shares = number[before(place, first, start)], (1 + count // share)[place]
                part = [three(u, v, w), middle(u, v, w, shares), v, u, w, (shares > 1).astype(np.uint8), np.ones(len(w), np.uint32)]
            parts.append(merged([part]))
            n += len(parts[-1][0])
            if n > FLUSH:
                parts = [merged(parts)]
                n = len(parts[0][0])
                if n > HELD:
                    yield from give(parts[0])
                    parts, n = [], 0
        if parts:
            yield from give(merged(parts))

    def fold_trigrams(shard, parts):
        v, u, w, several, counts = joined(parts)
        parts.clear()
        key, v, u, w, several, counts = merged([[three(u, v, w), v, u, w, several, counts]])
        several = several.astype(bool)
        trigrams.write(shard, key, counts)
        keys = two(u, v)
        own = of_contexts(keys[~several], counts[~several])
        contexts.write(shard, *own)
        yield _row(shard, COUNTS, len(counts), [*frequencies(counts), len(own[0])])
        some = of_contexts(keys[several], counts[several])
        route = spread(some[0])
        by = np.argsort(route)
        yield from _wide(_payloads(CONTEXT, blobs(shards, route[by], *(x[by] for x in some), keyless=True)))
        key, v, w, n = merged([[two(v, w), v, w, np.ones(len(v), np.uint32)]])
        route = spread(key)
        by = np.lexsort((w, v, shard_of(route, min(shards, FAN))))
        yield from _wide(_payloads(PAIR, blobs(shards, route[by], v[by], w[by], n[by], keyless=True)))

    def fold_second(shard, parts, kind):
        if kind == CONTEXT:
            keys, *stats = joined(parts)
            keys, *stats = summed(keys, *(s.astype(np.uint64) for s in stats))
            hot.write(shard, keys, *stats)
            yield _row(shard, CONTEXT, len(keys), [])
            return
        v, w, counts = joined(parts)
        keys, v, w, counts = merged([[two(v, w), v, w, counts]])
        pairs.write(shard, keys, counts)
        yield _row(shard, PAIR, len(keys), frequencies(counts))
        left, right = of_contexts(v, counts), counted(w)
        number = np.concatenate([left[0], right[0]])
        stats = [np.concatenate([x, np.zeros(len(right[0]), x.dtype)]) for x in left[1:]] + [np.concatenate([np.zeros(len(left[0]), np.uint32), right[1].astype(np.uint32)])]
        number, *stats = summed(number, *stats)
        route = mixed(number.astype(np.uint64))
        by = np.lexsort((number, shard_of(route, min(shards, FAN))))
        yield from _wide(_payloads(PAIR, blobs(shards, route[by], number[by], *(x[by].astype(np.min_scalar_type(int(x.max()))) for x in stats), keyless=True)))

    grams = docs.mapInArrow(count_grams, BLOBS)
    highest = np.zeros(4)
    if order == 3:
        level = f"{root}/level"
        reduced(grams, shards, fold_trigrams, LEVEL, keyless=True).write.parquet(level)
        done = spark.read.parquet(level)
        for r in done.filter("payload is null").collect():  # one for each shard
            trigrams.sizes[r["shard"]], contexts.sizes[r["shard"]] = r["n"], r["numbers"][4]
            highest += r["numbers"][:4]
        grams = done.filter("payload is not null")
    else:
        grams = grams.withColumn("kind", F.lit(PAIR))
    reduced(grams, shards, fold_second, LEVEL, keyless=True, kinds=True).write.parquet(f"{root}/second")
    remove(f"{root}/level")
    done = spark.read.parquet(f"{root}/second")
    middle_ = np.zeros(4)
    for r in done.filter("payload is null").collect():  # two for each shard at most
        (hot if r["kind"] == CONTEXT else pairs).sizes[r["shard"]] = r["n"]
        if r["kind"] == PAIR:
            middle_ += r["numbers"]

    by_word = Store(f"{root}/by-word", shards, ("total", "f1", "f2", "f3", "before"))

    def fold_by_word(shard, parts):
        number, *stats = joined(parts)
        keys, *stats = summed(mixed(number.astype(np.uint64)), *(s.astype(np.uint64) for s in stats))
        by_word.write(shard, keys, *(s.astype(np.min_scalar_type(int(s.max()))) for s in stats))
        n = stats[4]
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([[*frequencies(n), int(np.count_nonzero(n > 2))]], pa.list_(pa.int64()))], ["shard", "n", "numbers"])

    of_words = sum((np.array(r["numbers"]) for r in by_word.fill(done.filter("payload is not null"), fold_by_word, ", numbers array<long>", keyless=True)), np.zeros(5))
    remove(f"{root}/second")
    lowest, kinds = discounts(of_words[:4]), int(pairs.sizes.sum())
    rest = float(lowest[1] * of_words[0] + lowest[2] * of_words[1] + lowest[3] * of_words[4]) / kinds if kinds else 1.0
    some = (contexts, hot, trigrams) if order == 3 else (None, None, None)
    return Model(order, share, known, by_word, pairs, *some, n_tokens, distinct, discounts(highest), discounts(middle_), lowest, kinds, rest)


def score_documents(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every whole text: tokens with the end, tokens that training had, and
    log10 probabilities by smoothed word counts and by the model. A row for each row, of an empty table none; null text: as
    empty, which has an end. Other columns aren't looked at.
    """
    n, v = model.tokens, model.distinct
    floor = n + 0.1 * (v + 1)

    def run(batches):
        for rows, data, off in sliced(batches, text_column, 2 * model.words.slice_bytes):
            hashes, first = tokens(data, off)
            counts, p = model.score(hashes, first)
            base = np.log10((counts + 0.1) / floor)
            yield pa.RecordBatch.from_arrays(
                [rows.column(id_column), pa.array(np.diff(first), pa.int64()), pa.array(sums(counts > 0, first), pa.int64()), pa.array(np.add.reduceat(base, first[:-1])), pa.array(np.add.reduceat(p, first[:-1]))],
                [id_column, "n_tokens", "n_known", "base_score", "score"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, n_tokens long, n_known long, base_score double, score double")


def held_out(id_column: str, folds: int):
    """Whether crc32 of the id as text leaves no remainder; a null id: as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % folds == 0
