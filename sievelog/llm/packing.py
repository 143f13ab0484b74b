"""Best-fit packing of documents into sequences of a fixed number of tokens.

A piece's place depends on its length alone, and there are no more lengths than tokens in a sequence. So the bins are
planned on the histogram of lengths, which is as small for 100 TB as for 1 GB, and pieces then take the places of their
length by their number within it. Pieces over a third of a sequence fit at most twice: they are matched greedily, the
largest with the largest that still fits. Smaller ones, longest first, go to the gap that they fill best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import blocks, crc_of_ids
from .shared import shared_folder


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Places for ``counts[length]`` pieces of each length. Rows: length, number of the first piece of that length, first
    bin, pieces in each bin, offset of the bin's first one; piece ``i`` of the row is in bin ``first + i // each``.
    The rows of a length follow each other without gaps in the numbers."""
    places: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # runs of bins (first, how many) by their free tokens

    def put(length: int, first: int, n: int, each: int, free: int) -> None:
        """``each`` pieces into each of ``n`` bins that have ``free`` tokens left."""
        places.append((length, used[length], first, each, capacity - free))
        used[length] += n * each
        if free - each * length:
            gaps.setdefault(free - each * length, []).append((first, n))

    left = {s: n for s, n in counts.items() if n and 3 * s > capacity}
    for s in sorted(left, reverse=True):
        while n := left[s]:
            mate = max((t for t, m in left.items() if m and t + s <= capacity), default=0)
            if mate == s:
                pairs = n // 2
                if pairs:
                    first, bins = bins, bins + pairs
                    put(s, first, pairs, 2, capacity)
                    left[s] -= 2 * pairs
                    continue
                mate = max((t for t, m in left.items() if m and t < s and t + s <= capacity), default=0)
            many = min(n, left[mate]) if mate else n
            first, bins = bins, bins + many
            left[s] -= many
            if mate:
                places.append((s, used[s], first, 1, 0))
                used[s] += many
                put(mate, first, many, 1, capacity - s)
                left[mate] -= many
            else:
                put(s, first, many, 1, capacity)
    for s in sorted((s for s, n in counts.items() if n and 0 < s and 3 * s <= capacity), reverse=True):
        n = counts[s]
        while n:
            g = min((g for g, runs in gaps.items() if g >= s and runs), default=0)  # the gap that s fills best
            if not g:
                each = capacity // s
                whole, rest = divmod(n, each)
                if whole:
                    first, bins = bins, bins + whole
                    put(s, first, whole, each, capacity)
                if rest:
                    first, bins = bins, bins + 1
                    put(s, first, 1, rest, capacity)
                break
            first, many = gaps[g].pop()
            each = min(n, g // s)
            take = min(many, n // each)
            if take < many:
                gaps[g].append((first + take, many - take))
            put(s, first, take, each, g)
            n -= take * each
    if counts.get(0):
        places.append((0, 0, bins, counts[0], 0))
    return np.array(sorted(places), np.int64).reshape(-1, 5)


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """Pieces of at most ``capacity`` ids. The columns ``task`` and ``place`` number the pieces of one length within a task."""
    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task long, place long"

    def run(batches) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for block in blocks(batches, path, [id_column], text_column):
            for rows, ids, begin, _ in block.ids():
                row, piece, start, length, crc, place = [], [], [], [], [], []
                for d, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], np.int32(end_id))
                    head = len(own) % capacity or capacity
                    at = 0
                    for i, to in enumerate(range(head, len(own) + 1, capacity)):
                        row.append(d)
                        piece.append(i)
                        start.append(at)
                        length.append(to - at)
                        crc.append(crc_of_ids(own[at:to]))
                        place.append(int(seen[to - at]))
                        seen[to - at] += 1
                        at = to
                yield pa.RecordBatch.from_arrays(
                    [rows.column(id_column).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([task] * len(row), pa.int64()), pa.array(place, pa.int64())],
                    [id_column, "piece", "start", "length", "ids_crc32", "task", "place"],
                )

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Packs the token ids of all texts, each with ``end_id`` after it, into sequences of at most ``capacity`` ids.

    Returns per piece: the document's id, piece, start, length, ids_crc32, sequence_id, offset. Documents over ``capacity``
    are cut into pieces of ``capacity``, the first of which may be shorter. Null text: as empty, so a single ``end_id``.
    Equal rows are packed each for itself, in places of their own. No documents: no rows.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "pieces")
    # Written, as the numbering of equal lengths has to stay as it is when tasks run again.
    pieces_of(docs, path, capacity, end_id, id_column, text_column).write.parquet(folder)
    pieces = spark.read.parquet(folder)
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(plan(histogram, capacity))
    before = by_task.selectExpr("length", "task", "sum(n) over (partition by length order by task rows between unbounded preceding and 1 preceding) as earlier")

    def run(batches):
        table = places.value
        first_row = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("number").to_numpy(zero_copy_only=False)
            at = np.empty(len(length), np.int64)
            for s in np.unique(length).tolist():
                a, b = first_row[s], first_row[s + 1]
                own = length == s
                at[own] = a + np.searchsorted(table[a:b, 1], number[own], "right") - 1
            row = table[at]
            turn = number - row[:, 1]
            sequence = row[:, 2] + turn // row[:, 3]
            offset = row[:, 4] + turn % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (id_column, "piece", "start", "length", "ids_crc32")), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [id_column, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = pieces.join(before, ["length", "task"]).withColumn("number", F.col("place") + F.coalesce("earlier", F.lit(0)))
    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.select(id_column, "piece", "start", "length", "ids_crc32", "number").mapInArrow(run, schema)
