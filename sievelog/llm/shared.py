"""Sorted hash arrays in the folder that driver and executors share, and the sharded exchange that fills them.

A store is a folder of ``.npy`` files: shard ``s`` holds the sorted 64-bit keys whose high bits fall to ``s``, and one
array for each value. Workers map the files into memory, so a store may be larger than a worker; nothing is broadcast
but the folder's name and the number of keys of each shard. That number is how a look-up knows a shard without keys from
one whose files are lost: the first gives defaults, the second raises. Files are written under another name and then
renamed, so that a task that runs again after an executor was lost leaves the same files.

Shards follow the size of the input, not its partitions. A task makes a payload for each of at most FAN ranges of keys;
where there are more shards than that, a second exchange splits each range, so that rows grow with the input alone.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .arrays import SLICE_BYTES, packed, positions, trim, unpacked

BLOBS = "shard int, payload binary"
#: Bytes of input for each shard, the least number of shards, and the most payloads that a task makes at once.
SHARD_BYTES, LEAST, FAN = 16_000_000, 64, 2048
#: Arrays that a store keeps mapped in a worker.
OPEN = 800

_made: list[tuple[int, str]] = []


class StoreError(RuntimeError):
    """Files of a store are lost, or the store isn't complete. Never answered with defaults."""


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed by ``release`` or when the driver ends. Only a local master may
    leave that unset (tests): its tasks see the temporary folder of this machine, those of a cluster would not."""
    context = ship(spark).sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and (chosen := context._jsc.sc().getCheckpointDir()).isDefined():
        root = chosen.get()
    if not root:
        if not context.master.startswith("local"):
            raise StoreError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = os.environ.get("SIEVELOG_LOCAL_FOLDER") or tempfile.mkdtemp(prefix="sievelog-")
        os.environ["SIEVELOG_LOCAL_FOLDER"] = root
        atexit.register(shutil.rmtree, root, True)
    if not _made:
        atexit.register(release)
    _made.append((os.getpid(), f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"))
    return _made[-1][1]


def release() -> None:
    """Removes all folders that this process has asked for. Frames that operators have returned can't be read any more."""
    while _made:
        pid, folder = _made.pop()
        if pid == os.getpid():
            remove(folder)


def _files(path: str):
    """The file system of a shared path, and the path there. Folders on a mount are used as they are."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def save(path: str, array: np.ndarray) -> None:
    files, at = _files(path)
    folder = at.rpartition("/")[0]
    files.create_dir(folder, recursive=True)
    partial = f"{at}.{uuid.uuid4().hex}.partial"
    sink = pa.BufferOutputStream()
    np.lib.format.write_array(pa.PythonFile(sink, "wb"), np.ascontiguousarray(array), allow_pickle=False)
    with files.open_output_stream(partial) as out:
        out.write(sink.getvalue())
    files.move(partial, at)


def mapped(path: str) -> np.ndarray:
    """The array, mapped into memory; a StoreError if it isn't there. From a store that can't be mapped, a copy without a
    name in the worker's own folder is: a cache, written again wherever it is needed."""
    from pyarrow import fs

    files, at = _files(path)
    try:
        if isinstance(files, fs.LocalFileSystem):
            return np.load(at, mmap_mode="r").view(np.ndarray)  # a plain array over the map: slices cost less
        copy = tempfile.NamedTemporaryFile(suffix=".npy", delete=False)
        try:
            with files.open_input_stream(at) as source:
                shutil.copyfileobj(source, copy)
            copy.close()
            return np.load(copy.name, mmap_mode="r").view(np.ndarray)
        finally:
            os.unlink(copy.name)
    except FileNotFoundError as e:
        raise StoreError(f"{path} is lost; run the operator again") from e


def remove(path: str) -> None:
    try:
        files, at = _files(path)
        files.delete_dir(at)
    except (FileNotFoundError, OSError):
        pass


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards by the keys' high bits, so that the order of the keys is the order of the shards."""
    return (((np.asarray(keys, np.uint64) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def shard_bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """For sorted keys: where each shard's begin, and the end."""
    return np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))


def blobs(shards: int, keys: np.ndarray, *values: np.ndarray, texts: np.ndarray | None = None, keyless: bool = False) -> Iterator[pa.RecordBatch]:
    """Entries with their values, in the order of their keys' shards, as one payload for each range of keys that has any, at
    most FAN. ``texts``: the bytes of all entries, one after the other; then the first of the values are their lengths.
    ``keyless``: the keys only say where an entry goes, and the payloads of the last exchange don't have them."""
    coarse = min(shards, FAN)
    at = shard_bounds(keys, coarse)
    bytes_at = None if texts is None else np.concatenate([[0], np.cumsum(values[0], dtype=np.int64)])[at]
    arrays = values if keyless and coarse == shards else (keys, *values)
    some = np.flatnonzero(at[1:] > at[:-1]).tolist()
    for i in range(0, len(some), 64):
        part = some[i : i + 64]
        made = [packed(*(a[at[s] : at[s + 1]] for a in arrays), *([] if texts is None else [texts[bytes_at[s] : bytes_at[s + 1]]])) for s in part]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(made, pa.binary())], ["shard", "payload"])


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.concatenate([first, [len(keys)]]))


#: Distinct keys that a task holds before it passes them on, and those that it holds before it adds equal ones up.
HELD, FLUSH = 1_200_000, 1_600_000


class Tally:
    """Counts of keys within a task, passed on as payloads once there are many."""

    def __init__(self, shards: int):
        self.shards, self.parts, self.n = shards, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray):
        self.parts.append([keys, counts])
        self.n += len(keys)
        if self.n > FLUSH:
            merged = list(summed(*joined(self.parts)))
            self.parts, self.n = [merged], len(merged[0])
            if self.n > HELD:
                yield from self.flush()

    def flush(self):
        if self.parts:
            keys, counts = summed(*joined(self.parts))
            self.parts, self.n = [], 0
            yield from blobs(self.shards, keys, counts.astype(np.uint32))


def joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _split(shards: int, texts: bool, keyless: bool, keys: list[str]):
    """Payloads of a range of keys, as payloads of its shards."""

    def of(key: tuple, table: pa.Table) -> pa.Table:
        arrays = joined([unpacked(x.as_py()) for x in table.column("payload")])
        flat = arrays.pop() if texts else None
        order = np.argsort(shard_of(arrays[0], shards), kind="stable")
        if texts:
            lens = arrays[1].astype(np.int64)
            flat = flat[positions((np.cumsum(lens) - lens)[order], lens[order])[0]]
        arrays = [a[order] for a in arrays]
        at = shard_bounds(arrays[0], shards)
        bytes_at = np.concatenate([[0], np.cumsum(arrays[1], dtype=np.int64)])[at] if texts else None
        some = np.flatnonzero(at[1:] > at[:-1]).tolist()
        arrays = arrays[1:] if keyless else arrays
        made = [packed(*(a[at[s] : at[s + 1]] for a in arrays), *([flat[bytes_at[s] : bytes_at[s + 1]]] if texts else [])) for s in some]
        same = {k: table.column(k).slice(0, 1).combine_chunks().take(pa.array([0] * len(some))) for k in keys[1:]}
        return pa.table({"shard": pa.array(some, pa.int32()), **same, "payload": pa.array(made, pa.binary())})

    return of


def reduced(frame: DataFrame, shards: int, fold: Callable, schema: str, texts: bool = False, keyless: bool = False, kinds: bool = False) -> DataFrame:
    """``fold(shard, payloads)``, which gives record batches, for each shard that the payloads of a frame of ``blobs`` have keys
    of. With ``kinds`` a column ``kind`` keeps several such exchanges apart, and ``fold`` gets it as a third argument. A key
    has one entry from each flush of a task, so a frequent key weighs little more than a rare one."""
    keys = ["shard", "kind"] if kinds else ["shard"]

    def of(key: tuple, table: pa.Table) -> pa.Table:
        out = list(fold(key[0].as_py(), [unpacked(x.as_py()) for x in table.column("payload")], *(k.as_py() for k in key[1:])))
        trim()
        return pa.Table.from_batches(out)

    frame = frame.select(*keys, "payload")
    if shards > FAN:
        spread = frame.withColumn("part", F.pmod(F.xxhash64("payload"), F.lit(shards // FAN)))
        frame = spread.groupBy(*keys, "part").applyInArrow(_split(shards, texts, keyless, keys), "shard int, " + ("kind int, " if kinds else "") + "payload binary")
    return frame.groupBy(*keys).applyInArrow(of, schema)


def _input_bytes(frame: DataFrame) -> int | None:
    """What Catalyst knows of the size of the tables that a frame reads; None if there is one that it knows nothing of."""
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if all(x < 1 << 60 for x in sizes) else None


def shards_for(frame: DataFrame) -> int:
    """So many shards that each holds what SHARD_BYTES of input give: a multiple of FAN if there are more than FAN."""
    size = _input_bytes(frame)
    shards = max(LEAST, -(-size // SHARD_BYTES) if size is not None else 2 * frame.rdd.getNumPartitions())
    return shards if shards <= FAN else FAN * min(-(-shards // FAN), FAN)


class Store:
    """Look-ups in a folder of sorted hash arrays. Opens its files where it is used, once in each worker."""

    def __init__(self, folder: str, shards: int, values: tuple[str, ...]):
        self.folder, self.shards, self.values = folder, shards, values
        self.sizes: np.ndarray | None = None
        self._open: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    @property
    def slice_bytes(self) -> int:
        """Text to look up together: more where there are many shards, each of which is opened at most once for it."""
        return min(max(SLICE_BYTES, 8_000 * self.shards), 64_000_000)

    def fill(self, frame: DataFrame, fold: Callable, extra: str = "", texts: bool = False, keyless: bool = False) -> list:
        """Runs ``fold`` for each shard, which writes it and gives its row (shard, n, ``extra``), and keeps the sizes."""
        rows = reduced(frame, self.shards, fold, "shard int, n long" + extra, texts, keyless).collect()
        sizes = np.zeros(self.shards, np.int64)
        for r in rows:
            sizes[r["shard"]] = r["n"]
        self.sizes = sizes
        return rows

    def write(self, shard: int, keys: np.ndarray, *values: np.ndarray) -> None:
        for name, a in zip(("keys", *self.values), (keys, *values), strict=True):
            save(f"{self.folder}/{shard:07d}.{name}.npy", a)

    def write_more(self, shard: int, name: str, array: np.ndarray) -> None:
        """An array of another length than the keys, which some value leads into."""
        save(f"{self.folder}/{shard:07d}.{name}.npy", array)

    def array(self, shard: int, name: str) -> np.ndarray:
        if (shard, name) not in self._open:
            if len(self._open) > OPEN:
                self._open.clear()
            self._open[shard, name] = mapped(f"{self.folder}/{shard:07d}.{name}.npy")
        return self._open[shard, name]

    def find(self, keys: np.ndarray, *defaults, check: np.ndarray | None = None) -> list[np.ndarray]:
        """The values of keys in any order; the defaults, which give the type as well, where a key isn't there. With ``check``
        (the last value, 64 bits more of the key) an entry counts only if both are equal."""
        if self.sizes is None:
            raise StoreError(f"{self.folder} isn't filled")
        keys = np.asarray(keys, np.uint64)
        order = np.argsort(keys)
        ranked = keys[order]
        out = [np.full(len(keys), d) for d in defaults]
        at = shard_bounds(ranked, self.shards)
        for s in np.flatnonzero((at[1:] > at[:-1]) & (self.sizes > 0)).tolist():
            have = self.array(s, "keys")
            if len(have) != self.sizes[s]:
                raise StoreError(f"{self.folder}: shard {s} has {len(have)} keys instead of {self.sizes[s]}")
            asked, to = ranked[at[s] : at[s + 1]], order[at[s] : at[s + 1]]
            i = np.minimum(np.searchsorted(have, asked), len(have) - 1)
            hit = have[i] == asked
            if check is not None:
                marks, want = self.array(s, self.values[-1]), check[to]
                while len(on := np.flatnonzero(hit & (marks[i] != want))):  # the next of those with equal first halves
                    i[on] = np.minimum(i[on] + 1, len(have) - 1)
                    hit[on] = (have[i[on]] == asked[on]) & ((i[on] < len(have) - 1) | (marks[i[on]] == want[on]))
            for name, o in zip(self.values, out, strict=False):
                o[to[hit]] = self.array(s, name)[i[hit]]
        return out


class Compact:
    """Hash arrays of n-grams: the keys of a shard sorted by their low halves, of which the first bits are a place in an array
    of buckets; the high halves are kept. So a key takes about five bytes, and one that isn't there is taken for one that is
    with a chance of about 1 in 10^9. Values are numbers of rows in a table of the different ones. The shard of a key is
    that of its ``route``, a hash of its own."""

    def __init__(self, folder: str, shards: int, values: int):
        self.folder, self.shards, self.values = folder, shards, values
        self.sizes = np.zeros(shards, np.int64)
        self._open: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def write(self, shard: int, keys: np.ndarray, *values: np.ndarray) -> None:
        """Distinct keys in any order."""
        code, rows = np.zeros(len(keys), np.int64), np.zeros(1, np.int64)
        for v in values:
            code, rows = pd.factorize(code * (int(v.max(initial=0)) + 1) + v.astype(np.int64))
        first = np.empty(len(rows), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        turned = keys << np.uint64(32) | keys >> np.uint64(32)
        order = np.argsort(turned)
        bits = max(1, min(31, (len(keys) // 3).bit_length()))
        bounds = np.searchsorted(turned[order] >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        made = {"at": bounds.astype(np.uint32), "rest": (keys[order] >> np.uint64(32)).astype(np.uint32), "code": code[order].astype(np.min_scalar_type(len(rows))), "table": np.stack([v[first].astype(np.int64) for v in values])}
        for name, a in made.items():
            save(f"{self.folder}/{shard:07d}.{name}.npy", a)

    def arrays(self, shard: int) -> list[np.ndarray]:
        if shard not in self._open:
            if len(self._open) > OPEN // 4:
                self._open.clear()
            found = [mapped(f"{self.folder}/{shard:07d}.{name}.npy") for name in ("at", "rest", "code", "table")]
            if len(found[1]) != self.sizes[shard]:
                raise StoreError(f"{self.folder}: shard {shard} has {len(found[1])} keys instead of {self.sizes[shard]}")
            self._open[shard] = found
        return self._open[shard]

    def find(self, route: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The values of keys, a row for each value; zeros where a key isn't there."""
        out = np.zeros((self.values, len(keys)), np.int64)
        shard = shard_of(route, self.shards)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero((bounds[1:] > bounds[:-1]) & (self.sizes > 0)).tolist():
            to = order[bounds[s] : bounds[s + 1]]
            at, rest, code, table = self.arrays(s)
            bits = (len(at) - 1).bit_length() - 1
            bucket = ((keys[to] & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.int64)
            want, i, end = (keys[to] >> np.uint64(32)).astype(np.uint32), at[bucket].astype(np.int64), at[bucket + 1].astype(np.int64)
            on = np.flatnonzero(i < end)
            while len(on):
                hit = rest[i[on]] == want[on]
                done = on[hit]
                out[:, to[done]] = table[:, code[i[done]]]
                on = on[~hit]
                i[on] += 1
                on = on[i[on] < end[on]]
        return out
