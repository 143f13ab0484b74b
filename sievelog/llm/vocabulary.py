"""The distinct pre-tokens of a corpus, each encoded once by merge replay, as sorted hash arrays.

Tasks gather the distinct pre-tokens of their texts, which go to shards of their hashes; a shard encodes each of its words
once and stores its number of pieces, and the ids if they are wanted. Words are told apart by 128 bits: a word whose first
64 bits are another word's too is marked, and documents that have one are left to the library.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import positions, sliced, span_hashes
from .pretokens import pieces
from .shared import BLOBS, Store, StoreError, blobs, joined, shard_bounds, shared_folder, shards_for

#: Distinct pre-tokens that a task holds before it passes them on.
HELD = 400_000
#: Instead of a number of pieces: two words with one hash; not there.
CLASH, ABSENT = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)


def special_documents(added: Iterable[str], data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Documents whose text has a special token's text inside, which only the library treats as it does."""
    out: set[int] = set()
    raw = data.tobytes() if added else b""
    for special in added:
        mark, at = special.encode(), -1
        while (at := raw.find(mark, at + 1)) >= 0:
            out.add(int(np.searchsorted(off, at, "right")) - 1)
    return np.array(sorted(out), np.int64)


def distinct_words(data: np.ndarray, off: np.ndarray):
    """Starts and ends of the pre-tokens, the first of each document, their numbers among the distinct hashes, those, and the
    first place of each."""
    starts, ends, first = pieces(data, off)
    hashes = span_hashes(data, starts, ends)
    codes, distinct = pd.factorize(hashes)
    here = np.empty(len(distinct), np.int64)
    here[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return starts, ends, first, codes, distinct, here


class Vocabulary:
    """Number of pieces of every distinct pre-token of ``docs`` and, with ``keep_ids``, the pieces."""

    def __init__(self, docs: DataFrame, path: str, text_column: str, keep_ids: bool):
        from .bpe import merges

        self.path = path
        shards = shards_for(docs.select(text_column))
        store = self.store = Store(shared_folder(docs.sparkSession, "vocabulary"), shards, ("n", "at") if keep_ids else ("n",))

        def gather(batches):
            seen, seen_check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            held: list[list[np.ndarray]] = []

            def give():
                hashes, lens, check, flat = joined(held)
                order = np.argsort(hashes, kind="stable")
                index, _, _ = positions((np.cumsum(lens) - lens)[order], lens[order])
                return blobs(shards, hashes[order], lens[order].astype(np.uint32), check[order], texts=flat[index])

            for _, data, off in sliced(batches, text_column):
                starts, ends, _, codes, distinct, here = distinct_words(data, off)
                check = span_hashes(data, starts, ends, 1)
                other = np.flatnonzero(check != check[here][codes])  # another word with a hash that is here already
                at = np.concatenate([here, other])
                hashes, check = np.concatenate([distinct, distinct[codes[other]]]), check[at]
                if len(seen):
                    i = np.minimum(np.searchsorted(seen, hashes), len(seen) - 1)
                    new = (seen[i] != hashes) | (seen_check[i] != check)
                    hashes, check, at = hashes[new], check[new], at[new]
                lens = ends[at] - starts[at]
                held.append([hashes, lens, check, data[positions(starts[at], lens)[0]]])
                seen, seen_check = np.concatenate([seen, hashes]), np.concatenate([seen_check, check])
                order = np.argsort(seen, kind="stable")
                seen, seen_check = seen[order], seen_check[order]
                if len(seen) > HELD:
                    yield from give()
                    held, seen, seen_check = [], seen[:0], seen_check[:0]
            if len(seen):
                yield from give()

        def encode(shard, parts):
            hashes, lens, check, flat = joined(parts)
            lens = lens.astype(np.int64)
            keys, at, codes = np.unique(hashes, return_index=True, return_inverse=True)
            clash = codes[check != check[at][codes]]
            index, _, _ = positions((np.cumsum(lens) - lens)[at], lens[at])
            ids, counts = merges(path).encoded(flat[index], lens[at])
            n = counts.astype(np.uint32)
            n[clash] = CLASH
            if keep_ids:
                store.write(shard, keys, n, np.cumsum(counts) - counts)
                store.write_more(shard, "ids", ids)
            else:
                store.write(shard, keys, n)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64())})

        store.fill(docs.select(text_column).mapInArrow(gather, BLOBS), encode, texts=True)

    def _found(self, words: np.ndarray, *more):
        n, *rest = self.store.find(words, ABSENT, *more)
        if (n == ABSENT).any():
            raise StoreError("texts have pre-tokens that they didn't have when they were gathered")
        return n, *rest

    def counts_of(self, batches: Iterator[pa.RecordBatch], text_column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """For each slice of texts: the rows, the number of pieces of each, and of bytes."""
        from .bpe import merges

        table = merges(self.path)
        for rows, data, off in sliced(batches, text_column, self.store.slice_bytes):
            _, _, first, codes, words, _ = distinct_words(data, off)
            (n,) = self._found(words)
            total = np.concatenate([[0], np.cumsum(n[codes], dtype=np.int64)])
            tokens = np.diff(total[first])
            for d in self._left(table, n, codes, first, data, off).tolist():
                tokens[d] = len(table.library(data[off[d] : off[d + 1]].tobytes().decode()))
            yield rows, tokens, np.diff(off)

    def ids_of(self, batches: Iterator[pa.RecordBatch], text_column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """For each slice of texts: the rows, the ids of all, one after the other, and where each row's begin (one more entry)."""
        from .bpe import merges, with_library

        table = merges(self.path)
        for rows, data, off in sliced(batches, text_column, self.store.slice_bytes):
            _, _, first, codes, words, _ = distinct_words(data, off)
            n, at = self._found(words, np.int64(0))
            left = self._left(table, n, codes, first, data, off)
            n = np.where(n == CLASH, 0, n).astype(np.int64)
            order = np.argsort(words)
            bounds, parts = shard_bounds(words[order], self.store.shards), [np.zeros(0, np.int32)]
            for s in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
                own = order[bounds[s] : bounds[s + 1]]
                parts.append(self.store.array(s, "ids")[positions(at[own], n[own])[0]])
            begin = np.empty(len(words), np.int64)
            begin[order] = np.cumsum(n[order]) - n[order]
            per = n[codes]
            ids = np.concatenate(parts)[positions(begin[codes], per)[0]]
            yield rows, *with_library(table.library, ids, np.concatenate([[0], np.cumsum(per)])[first], left, data, off)

    @staticmethod
    def _left(table, n, codes, first, data, off) -> np.ndarray:
        """Documents that the library has to encode."""
        some = special_documents(table.added, data, off)
        if (clash := n == CLASH).any():
            some = np.union1d(some, np.searchsorted(first, np.flatnonzero(clash[codes]), "right") - 1)
        return some
