"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes decides where chunks end, so that equal passages have equal chunks wherever they
stand; ends move on to the next white space, so that words stay whole. Of each stretch of chunks of at least ``least`` bytes,
told apart by 128 bits, the first in the corpus stays (smallest document id, then position); the others are cut out. A short
repetition alone is no passage. A task passes on a stretch once, with the place of its first occurrence and whether there
were more, so a passage that a third of all documents have is one entry from each flush of a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrays import SPACE, mixed, sliced, span_hashes
from .shared import BLOBS, Store, blobs, joined, shared_folder, shards_for

_RANDOM = np.random.Generator(np.random.PCG64(77))
GEAR = _RANDOM.integers(0, 2**16, 256, dtype=np.uint16)
WINDOW = 16
#: The odd number of digests, and its inverse modulo 2^64.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes that an end moves on at most to come to white space.
REACH = 48
#: Stretches that a task holds before it passes them on.
HELD = 700_000


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the gears of the last WINDOW, each shifted once for every byte after it (16 bits, so that older
    bytes have left the sum)."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h = np.concatenate([h[:step], h[step:] + (h[:-step] << np.uint16(step))])
        step *= 2
    return h


def chunks(data: np.ndarray, off: np.ndarray, least: int = 8, bits: int = 3, most: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends of all documents, in order, and the first chunk of each document (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    marks = np.flatnonzero(gear(data) >> np.uint16(16 - bits) == 0) + 1
    doc = np.searchsorted(off, marks - 1, "right") - 1
    inside = marks - off[doc] >= WINDOW  # else the hash has bytes of the document before
    marks, doc = marks[inside], doc[inside]
    leads = (data & 0xC0) != 0x80
    stops = np.append(np.flatnonzero(SPACE[data]) + 1, n)
    stops = np.minimum(stops[np.searchsorted(stops, marks)], off[doc + 1])
    starts = np.append(np.flatnonzero(leads), n)
    marks = np.unique(np.where(stops - marks <= REACH, stops, starts[np.searchsorted(starts, marks)])).tolist()
    ends: list[int] = []
    first = [0]
    k, many = 0, len(marks)
    for begin, end in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        last = begin
        while last < end:
            while k < many and marks[k] < last + least:
                k += 1
            cut = marks[k] if k < many else n
            if cut > last + most:
                cut = last + most
                while cut < end and not leads[cut]:
                    cut += 1
            if cut + least > end:
                cut = end
            ends.append(cut)
            last = cut
        first.append(len(ends))
    return np.array(ends, np.int64), np.array(first, np.int64)


def stretches(begins: np.ndarray, ends: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last chunk of the shortest stretch of ``least`` bytes or more from each chunk on, within a document.

    A run of that size is the union of those inside it but for what is left of its last chunks, less than one chunk."""
    past = np.repeat(first[1:], np.diff(first))  # of the chunk's document
    to = np.searchsorted(ends, begins + least)
    fits = np.flatnonzero(to < past)
    return fits, to[fits]


def digests(own: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Of each stretch 64 bits, the same wherever it stands: differences of sums of chunk hashes times powers of an odd number."""
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(own), _STEP)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(own), _BACK)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(own * power[:-1])])
    return mixed((total[to + 1] - total[at]) * back[at] + (to - at).astype(np.uint64))


def first_of_each(keys, check, ids, place, many):
    """Of equal stretches the first occurrence (document id, then place), and whether there are more."""
    order = np.lexsort((place, ids, check, keys))
    keys, check, ids, place, many = (x[order] for x in (keys, check, ids, place, many))
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (check[1:] != check[:-1])])
    at = np.flatnonzero(new)
    several = (np.diff(np.append(at, len(keys))) > 1) | np.logical_or.reduceat(many, at)
    return keys[at], check[at], ids[at], place[at], several


class Repeated:
    """Digests of stretches that the corpus has more than once, with the place of the first."""

    def __init__(self, docs: DataFrame, least: int, id_column: str, text_column: str):
        shards = shards_for(docs.select(id_column, text_column))
        store = self.store = Store(shared_folder(docs.sparkSession, "chunks"), shards, ("doc", "place", "check"))

        def gather(batches):
            held, n = [], 0

            def give():
                keys, check, ids, place, many = first_of_each(*joined(held))
                return blobs(shards, keys, check, ids, place.astype(np.uint32), many)

            for rows, data, off in sliced(batches, text_column):
                keys, check, ids, place = spans(rows, data, off, least, id_column)[:4]
                held.append([keys, check, ids, place, np.zeros(len(keys), bool)])
                n += len(keys)
                if n > HELD:
                    yield from give()
                    held, n = [], 0
            if n:
                yield from give()

        def fold(shard, parts):
            keys, check, ids, place, many = first_of_each(*joined(parts))
            store.write(shard, keys[many], ids[many], place[many], check[many])
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": [int(many.sum())]})

        store.fill(docs.select(id_column, text_column).mapInArrow(gather, BLOBS), fold)


def spans(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray, least: int, id_column: str):
    """Of each stretch: both halves of its digest, document id (null as the least), number of its first chunk in its document,
    first and last chunk; of each chunk begin and end; and the first chunk of each document."""
    ends, first = chunks(data, off)
    per = np.diff(first)
    begins = np.empty(len(ends), np.int64)
    begins[1:] = ends[:-1]
    begins[first[:-1][per > 0]] = off[:-1][per > 0]
    own, more = span_hashes(data, begins, ends), span_hashes(data, begins, ends, 1)
    at, to = stretches(begins, ends, first, least)
    doc = np.repeat(np.arange(len(per)), per)[at]
    ids = rows.column(id_column).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.int64)[doc]
    return digests(own, at, to), digests(more, at, to), ids, at - first[doc], (at, to), (begins, ends), first


def dedup_substrings(docs: DataFrame, least: int = 200, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` with the repeated passages of at least ``least`` bytes cut out of the text, and three more:
    ``n_chunks``, ``n_cut`` (chunks cut out) and ``cut_spans`` (array of struct<begin, length> in code points of the text as
    it was).

    200 bytes are about 35 words: what is sure to be found of a passage of over 50, whose ends may lie inside chunks. One
    occurrence of everything stays in the corpus. Whole copies lose their text but not their row; null stays null, and a text
    without a passage, of whatever length, stays as it is. An empty table gives none. Rows that share an id count as one
    document after another with the same places, so the copies among them stay whole: give unique ids, whole numbers. Columns
    of ``docs`` with the names of the three give way.
    """
    docs = docs.drop("n_chunks", "n_cut", "cut_spans")
    store = Repeated(docs, least, id_column, text_column).store
    names = docs.columns

    def run(batches):
        for rows, data, off in sliced(batches, text_column, store.slice_bytes):
            keys, check, ids, place, (from_, to), (begins, ends), first = spans(rows, data, off, least, id_column)
            owner, at = store.find(keys, np.int64(-1), np.uint32(0xFFFFFFFF), check=check)
            dup = (at != np.uint32(0xFFFFFFFF)) & ~((owner == ids) & (at == place))
            doc = np.repeat(np.arange(rows.num_rows), np.diff(first))
            depth = np.bincount(from_[dup], minlength=len(ends) + 1) - np.bincount(to[dup] + 1, minlength=len(ends) + 1)
            cut = np.cumsum(depth)[:-1] > 0
            follows = np.zeros(len(ends), bool)  # the chunk before, of the same document, is cut as well
            follows[1:] = cut[:-1] & (doc[1:] == doc[:-1])
            n_cut = np.bincount(doc[cut], minlength=rows.num_rows)
            edge = np.zeros(len(data) + 1, np.int32)
            edge[begins[cut]] += 1
            edge[ends[cut]] -= 1
            keep = np.cumsum(edge[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(keep)])[off]
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            text = pa.Array.from_buffers(pa.large_string(), rows.num_rows, [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[keep]))])
            was = rows.column(text_column)
            text = pc.if_else(was.is_valid(), text.cast(was.type), pa.scalar(None, was.type))
            head = np.flatnonzero(cut & ~follows)
            tail = np.flatnonzero(cut & ~np.append((follows & cut)[1:], False))
            origin = points[off[doc[head]]]
            per = np.concatenate([[0], np.cumsum(np.bincount(doc[head], minlength=rows.num_rows))])
            cut_spans = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays([pa.array(points[begins[head]] - origin, pa.int64()), pa.array(points[ends[tail]] - points[begins[head]], pa.int64())], ["begin", "length"]))
            columns = [text if c == text_column else rows.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(first), pa.int64()), pa.array(n_cut, pa.int64()), cut_spans], [*names, "n_chunks", "n_cut", "cut_spans"])

    span = T.StructType().add("begin", "long").add("length", "long")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_chunks", T.LongType()), T.StructField("n_cut", T.LongType()), T.StructField("cut_spans", T.ArrayType(span))])
    return docs.mapInArrow(run, schema)
