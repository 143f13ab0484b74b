"""N-gram Jaccard join: documents whose sets of word shingles are alike, exactly, and the groups that links make of them.

Sets that are equal count once, by a digest. Tokens (shingle hashes) are ordered from rare to frequent. Two sets with a
Jaccard likeness of at least t share a token among the first ``n - ceil(t n) + 1`` of each, and k tokens among the first
``n - ceil(t n) + k``. Tokens of a single class of equal sets lead nowhere and come first, so a set with enough of them needs
no index entry at all: that is nearly every document without near copies. From the others, rare tokens of the extended
prefix are indexed singly and frequent ones as k-token combinations.

A key's documents aren't paired with each other: each is verified against the first of its key, and those linked are one
component. Only keys that still have several components get the pairs between those, by exact bounds first: sizes, and the
triangle inequality of the Jaccard distance over documents that both were verified against.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, mixed, sliced, span_hashes, windows, words
from .components import components
from .repetition import sums
from .shared import BLOBS, Store, Tally, blobs, counted, joined, mapped, reduced, remove, save, shared_folder, shards_for, summed

#: Bits of a token's hash that are counted. Fewer would only make some tokens look more frequent than they are.
COUNTED = np.uint64(0xFFFFFFFFFFF00000)


def shingles(data: np.ndarray, off: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document's n-word shingles, in order, and the first of each document. A text of fewer words
    has its whole sequence as one; without words, none."""
    data = LOWER[data]
    starts, ends, first = words(data, off)
    own = span_hashes(data, starts, ends)
    runs, begin = windows(own, first, n)
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < n))
    parts, counts = [], np.zeros(len(off) - 1, np.int64)
    whole = {}
    for k in range(1, n):
        of = short[size[short] == k]
        if len(of):
            at = np.repeat(first[of], k) + np.tile(np.arange(k), len(of))
            got, _ = windows(own[at], np.arange(len(of) + 1) * k, k)
            whole |= dict(zip(of.tolist(), got.tolist(), strict=True))
    for d, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
        if a < b:
            x = np.sort(runs[a:b])
            if b - a > 1:
                x = x[np.concatenate([[True], x[1:] != x[:-1]])]
            parts.append(x)
            counts[d] = len(x)
        elif d in whole:
            parts.append(np.array([whole[d]], np.uint64))
            counts[d] = 1
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum(counts)])


def digests(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two numbers."""
    total = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(tokens ^ np.uint64(seed)))]) for seed in (0x243F6A8885A308D3, 0x13198A2E03707344)]
    return tuple(t[first[1:]] - t[first[:-1]] for t in total)


# The join

#: Tokens in so many texts at most are rare, and indexed singly.
RARE = 64
#: With so many frequent tokens at most in its prefix, a set indexes their pairs; with more, the tokens.
LIGHT = 24
#: Keys of so many sets at most give their pairs at once.
SMALL = 8
#: Sets whose names go together to a task, to be compared with the names of so many open ones.
CHUNK, OPENED = 2048, 128


class Sets:
    """The sets that have index entries, in files of the shared folder: tokens of several classes, by their hashes."""

    def __init__(self, folder: str, index: Store):
        self.folder, self.index, self._files = folder, index, {}

    def __getstate__(self):
        return self.__dict__ | {"_files": {}}

    def get(self, nodes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Sorted tokens, and the sizes of the whole sets."""
        file, at, n, size = self.index.find(mixed(nodes.astype(np.uint64)), np.int64(-1), np.int64(0), np.int64(0), np.int64(0))
        out = []
        for f, a, k in zip(file.tolist(), at.tolist(), n.tolist(), strict=True):
            if f not in self._files:
                if len(self._files) > 500:
                    self._files.clear()
                self._files[f] = mapped(f"{self.folder}/{f}.npy")
            out.append(self._files[f][a : a + k])
        return out, size


def filled(shard: int, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": [n]})


def alike(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (a + b - shared)


def verified(batches, sets: Sets, percent: int):
    """Pairs (a, b) that are alike."""
    for batch in batches:
        a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
        keep = np.zeros(len(a), bool)
        order = np.argsort(a, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], a[order][1:] != a[order][:-1], [True]])) if len(a) else [0]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[i:j]
            ((own,), (size,)) = sets.get(a[rows[:1]])
            others, sizes = sets.get(b[rows])
            hits = np.array([np.count_nonzero(own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x) for x in others])
            keep[rows] = alike(hits, size, sizes, percent)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def link_documents(docs: DataFrame, percent: int = 75, words_each: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: the size of its set of word shingles, and the smallest id that links
    between sets of a Jaccard likeness of ``percent`` or more lead to, its own included.

    Null, empty and wordless texts have no shingles and are linked with nothing; texts of any length are taken whole. Rows
    that share an id and a text are each as one; if their texts differ, the links between equal sets are those of all texts,
    and near ones those of any one of them. A null id gives a null component, an empty table no rows. Other columns aren't
    looked at.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent has to be over 0 and at most 100")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    shards = shards_for(docs)
    root = shared_folder(spark, "jaccard")

    # 1. Sizes and digests of the sets, and how often each token occurs
    def first_pass(batches):
        tally = Tally(shards)

        def payloads(made):
            for b in made:
                nulls = [pa.nulls(b.num_rows, pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([*nulls, b.column("shard"), b.column("payload")], ["id", "n", "d1", "d2", "shard", "payload"])

        for rows, data, off in sliced(batches):
            tokens, first = shingles(data, off, words_each)
            d1, d2 = digests(tokens, first)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(np.diff(first)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.nulls(rows.num_rows, pa.int32()), pa.nulls(rows.num_rows, pa.binary())], ["id", "n", "d1", "d2", "shard", "payload"])
            yield from payloads(tally.add(*counted(tokens & COUNTED)))
        yield from payloads(tally.flush())

    docs.mapInArrow(first_pass, "id long, n long, d1 long, d2 long, shard int, payload binary").write.parquet(f"{root}/first")
    first = spark.read.parquet(f"{root}/first")
    meta = first.filter("shard is null").select("id", "n", "d1", "d2")
    counts = Store(f"{root}/counts", shards, ("count",))

    def fold_counts(shard, parts):
        keys, n = summed(*joined(parts))
        many = n > 1
        counts.write(shard, keys[many], n[many].astype(np.uint32))
        yield filled(shard, int(many.sum()))

    counts.fill(first.filter("shard is not null"), fold_counts)

    # 2. Equal sets
    classes = meta.filter("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    copies = Store(f"{root}/copies", shards, ("rep", "copies", "d2"))

    def copied(batches):
        for b in batches:
            d1, rep, n, d2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("d1", "rep", "copies", "d2"))
            order = np.argsort(d1.view(np.uint64))
            yield from blobs(shards, d1.view(np.uint64)[order], rep[order], n[order], d2.view(np.uint64)[order])

    def fold_copies(shard, parts):
        d1, rep, n, d2 = joined(parts)
        order = np.argsort(d1)
        copies.write(shard, d1[order], rep[order], n[order], d2[order])
        yield filled(shard, len(d1))

    copies.fill(classes.filter("copies > 1").mapInArrow(copied, BLOBS), fold_copies)

    # 3. Index entries of one set of each class, and the sets that have any
    folder = f"{root}/sets"

    def second_pass(batches):
        file = TaskContext.get().taskAttemptId()
        held, length = [], 0
        entries: list[list[np.ndarray]] = []
        index: list[tuple] = []
        for rows, data, off in sliced(batches, limit=counts.slice_bytes):
            tokens, first = shingles(data, off, words_each)
            ids = rows.column("id").fill_null(-1).to_numpy(zero_copy_only=False)
            d1, d2 = digests(tokens, first)
            rep, same = copies.find(d1, np.int64(-1), np.int64(1), check=d2)
            size = np.diff(first)
            use = (size > 0) & rows.column("id").is_valid().to_numpy(zero_copy_only=False) & ((same == 1) | (rep == ids))
            keep = np.repeat(use, size)
            (seen,) = counts.find((tokens & COUNTED)[keep], np.uint32(1))
            count = np.ones(len(tokens), np.int64)
            count[keep] = seen
            own = count <= np.repeat(same, size)  # in no other class
            unique = sums(own, first)
            for d in np.flatnonzero(use & (unique < size * (100 - percent) // 100 + 2)).tolist():
                a, b = first[d], first[d + 1]
                other = ~own[a:b]
                t, c = tokens[a:b][other], count[a:b][other]
                n, u = int(size[d]), int(unique[d])
                order = np.lexsort((t, c))
                # the largest set that this place in the order leads to, with one token shared before it
                most = ((100 + percent) * (n - (u + np.arange(len(t))) + 1)) // percent - n
                many = int(np.count_nonzero(100 * most >= percent * n))
                if not many:
                    continue
                prefix, often, most = t[order[:many]], c[order[:many]] > RARE, most[:many]
                rare = np.flatnonzero(~often)
                found = [(prefix[rare], most[rare], 0)]
                at = np.flatnonzero(often)
                if len(at):
                    # a small set may be alike with one token shared, which no pair leads to
                    light = len(at) <= LIGHT and percent * (n + -(-percent * n // 100)) > 100 + percent
                    found.append((mixed(prefix[at] ^ np.uint64(0xF4E9)), most[at], 1 if light else 2))
                    if light and len(at) > 1:
                        i, j = np.triu_indices(len(at), 1)
                        x, y = prefix[at[i]], prefix[at[j]]
                        found.append((mixed(np.minimum(x, y) * np.uint64(0x9E3779B97F4A7C15) + np.maximum(x, y)), most[at[j]], 0))
                for keys, m, kind in found:
                    entries.append([keys, np.full(len(keys), ids[d]), np.full(len(keys), n, np.int32), m.astype(np.int32), np.full(len(keys), kind, np.int8)])
                index.append((ids[d], length, len(t), n))
                held.append(t)
                length += len(t)
        if not index:
            return
        save(f"{folder}/{file}.npy", np.concatenate(held))
        e = joined(entries)
        order = np.argsort(e[0])
        for b in blobs(shards, *(x[order] for x in e)):
            yield b.append_column("kind", pa.array([0] * b.num_rows, pa.int32()))
        i = np.array(index, np.int64)
        key = mixed(i[:, 0].astype(np.uint64))
        order = np.argsort(key)
        for b in blobs(shards, key[order], np.full(len(i), file)[order], *(i[order, k] for k in (1, 2, 3))):
            yield b.append_column("kind", pa.array([1] * b.num_rows, pa.int32()))

    docs.mapInArrow(second_pass, f"{BLOBS}, kind int").write.parquet(f"{root}/entries")
    entries = spark.read.parquet(f"{root}/entries")
    index = Store(f"{root}/index", shards, ("file", "at", "n", "size"))
    sets = Sets(folder, index)

    def fold_index(shard, parts):
        key, *values = joined(parts)
        key, at = np.unique(key, return_index=True)
        index.write(shard, key, *(v[at] for v in values))
        yield filled(shard, len(key))

    index.fill(entries.filter("kind = 1"), fold_index)

    # 4. Pairs of small keys, and of each large key its sets with its first one
    def fold_entries(shard, parts):
        keys, node, n, most, kind = joined(parts)
        order = np.lexsort((node, keys))
        keys, node, n, most, kind = (x[order] for x in (keys, node, n, most, kind))
        again = np.concatenate([[False], (keys[1:] == keys[:-1]) & (node[1:] == node[:-1])])  # repeated rows
        keys, node, n, most, kind = (x[~again] for x in (keys, node, n, most, kind))
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(begin, len(keys)))
        first, second, large = [], [], []  # places of entries
        top = np.maximum.reduceat(kind, begin)
        use = (size > 1) & (top != 1)  # frequent tokens alone count where a set has too many for pairs
        for k in range(2, SMALL + 1):
            at = begin[use & (size == k)]
            for i in range(k):
                for j in range(i + 1, k):
                    x, y = at + i, at + j
                    ok = (n[x] <= most[y]) & (n[y] <= most[x]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & ~((kind[x] == 1) & (kind[y] == 1))
                    first.append(x[ok])
                    second.append(y[ok])
                    large.append(np.zeros(int(ok.sum()), bool))
        for b, m in zip(begin[use & (size > SMALL)].tolist(), size[use & (size > SMALL)].tolist(), strict=True):
            first.append(np.full(m - 1, b))
            second.append(np.arange(b + 1, b + m))
            large.append(np.ones(m - 1, bool))
        x, y = (np.concatenate([np.zeros(0, np.int64), *p]) for p in (first, second))
        pairs = pd.DataFrame({"a": node[x], "b": node[y], "na": n[x], "nb": n[y], "large": np.concatenate([np.zeros(0, bool), *large])}).drop_duplicates()
        yield pa.RecordBatch.from_pandas(pairs, preserve_index=False)

    found = reduced(entries.filter("kind = 0"), shards, fold_entries, "a long, b long, na int, nb int, large boolean")
    found.groupBy("a", "b", "na", "nb").agg(F.max("large").alias("large")).write.parquet(f"{root}/pairs")
    remove(f"{root}/entries")
    pairs = spark.read.parquet(f"{root}/pairs")
    width = max(8, shards // 2)
    # a candidate is verified where its second set is; of those with one first set, which may be many, any task takes a part
    pairs.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b").repartition(width, "b").mapInArrow(lambda batches: verified(batches, sets, percent), "a long, b long").write.parquet(f"{root}/links")
    links = spark.read.parquet(f"{root}/links")

    # 5. Large keys in which several components are left: sets outside the largest are compared with all others there whose
    #    size allows it. Sizes fall into bands by the likeness, so that a set's partners are in its own band or the next ones.
    large = pairs.filter("large")
    sized = large.selectExpr("a as id", "na as n").union(large.selectExpr("b as id", "nb as n")).distinct()
    linked = components(links)
    clusters = components(large.select("a", "b")).withColumnRenamed("component", "cluster")
    labelled = clusters.join(sized, "id").join(linked, "id", "left").select("id", "cluster", "n", F.coalesce("component", "id").alias("component"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(np.log(100 / percent) if percent < 100 else 1e-9))
    labelled.withColumn("band", band.cast("long")).write.parquet(f"{root}/clusters")
    labelled = spark.read.parquet(f"{root}/clusters")
    parts = labelled.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("many"))
    main = parts.groupBy("cluster").agg(F.max(F.struct("many", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").drop("kinds")
    rest = labelled.join(main, "cluster")
    chunks = rest.groupBy("cluster", "band").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"), F.ceil(F.count_if(F.col("component") != F.col("main")) / OPENED).alias("parts"))
    spread = rest.join(chunks, ["cluster", "band"])
    one = F.struct("id", "component")
    every = spread.groupBy("cluster", "band", F.pmod(F.xxhash64("id"), "chunks").alias("chunk")).agg(F.collect_list(one).alias("sets"))
    opened = spread.filter("component <> main").groupBy("cluster", "band", F.pmod(F.xxhash64("id"), "parts").alias("part")).agg(F.collect_list(one).alias("open"))
    # an open part goes to every chunk of the bands that its sizes allow, each a key of its own
    near = opened.withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1))).join(chunks.select("cluster", "band", "chunks"), ["cluster", "band"])
    asked = near.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select("cluster", "band", "chunk", "open")

    def compare(batches):
        for batch in batches:
            for row in batch.to_pylist():
                nodes, comps = (np.array([s[c] for s in row["sets"]], np.int64) for c in ("id", "component"))
                held, sizes = sets.get(nodes)
                lens = np.array([len(x) for x in held])
                every_token, codes = np.unique(np.concatenate(held), return_inverse=True)
                begin = np.cumsum(lens) - lens
                own_sets, size = sets.get(np.array([s["id"] for s in row["open"]], np.int64))
                a, b = [], []
                for s, own, n in zip(row["open"], own_sets, size.tolist(), strict=True):
                    mark = np.zeros(len(every_token), bool)
                    i = np.minimum(np.searchsorted(every_token, own), len(every_token) - 1)
                    mark[i[every_token[i] == own]] = True
                    hits = np.add.reduceat(mark[codes], begin, dtype=np.int64)
                    found = np.flatnonzero(alike(hits, n, sizes, percent) & (comps != s["component"]))
                    _, one = np.unique(comps[found], return_index=True)  # a link to each component is enough
                    a += [s["id"]] * len(one)
                    b += nodes[found[one]].tolist()
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    more = asked.join(every, ["cluster", "band", "chunk"]).select("open", "sets").mapInArrow(compare, "a long, b long")
    more.write.parquet(f"{root}/more")
    final = components(linked.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(spark.read.parquet(f"{root}/more")))
    for done in ("sets", "counts", "copies", "index", "pairs", "links", "clusters"):
        remove(f"{root}/{done}")

    # 6. Back to all rows
    named = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = meta.join(named, ["d1", "d2"], "left")
    component = F.when(F.col("id").isNull(), None).when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_first(docs: DataFrame, percent: int = 75, words_each: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, without those that links lead to a smaller id. Rows that share an id stay or go
    together; rows without an id or without words stay. The ids that go are a store that tasks look into, so that no text is
    shuffled for them."""
    shards = shards_for(docs)
    gone = Store(shared_folder(docs.sparkSession, "gone"), shards, ("gone",))
    later = link_documents(docs, percent, words_each, id_column, text_column).filter(f"component_id <> `{id_column}`").select(F.col(id_column).alias("id")).distinct()

    def keys_of(ids) -> np.ndarray:
        return mixed(ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64))

    def hashed(batches):
        for b in batches:
            keys = np.sort(keys_of(b.column("id")))
            yield from blobs(shards, keys, np.ones(len(keys), np.uint8))

    def fold(shard, parts):
        keys = np.unique(joined(parts)[0])
        gone.write(shard, keys, np.ones(len(keys), np.uint8))
        yield filled(shard, len(keys))

    gone.fill(later.mapInArrow(hashed, BLOBS), fold)

    def run(batches):
        for b in batches:
            ids = b.column(id_column)
            (hit,) = gone.find(keys_of(ids), np.uint8(0))
            yield b.filter(pa.array((hit == 0) | ~ids.is_valid().to_numpy(zero_copy_only=False)))

    return docs.mapInArrow(run, docs.schema)
