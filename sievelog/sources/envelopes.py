"""Envelope objects, gzip of ``{"Records": [...]}``, as one row per record with its text as it stands."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strict_json import GzipError, JsonError, TooLarge, gunzip, parses, split_envelope

#: Records that leave a task together.
BATCH = 2_000
RECORDS = "status string, error string, bytes_in long, pos int, raw string, parse_ok boolean"


def located(spark: SparkSession, path: str) -> tuple[str, bool | None]:
    """The full name of a file or folder, and whether it is a folder (None: neither is there). Local names are resolved, links
    and ``..`` included."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getUri().getScheme() == "file":
        at = jvm.Path("file:" + os.path.realpath(re.sub("^file:/*", "/", path)))
    at = files.makeQualified(at)
    return at.toString(), files.getFileStatus(at).isDirectory() if files.exists(at) else None


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, rel, size) of all files below a folder; ``rel`` is the path from there."""
    root, there = located(spark, folder)
    if not there:
        raise FileNotFoundError(f"{folder} is not a folder")
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(re.sub(r"([\[\]{}*?\\])", r"\\\1", root)).select("path", F.col("length").alias("size"))
    rel = F.when(F.col("path").startswith(root + "/"), F.expr(f"substring(path, {len(root) + 2})")).otherwise(F.raise_error(F.concat("path", F.lit(f" is not below {root}"))))
    return files.select("path", rel.alias("rel"), "size")


def opened(data: bytes, cap: int | None) -> tuple[str, str | None, list[str]]:
    """(status, error, records): ok, unrecognized, too_large, gzip_error or json_error."""
    try:
        found = split_envelope(gunzip(data, cap))
    except TooLarge as e:
        return "too_large", str(e), []
    except GzipError as e:
        return "gzip_error", str(e), []
    except JsonError as e:
        return "json_error", str(e), []
    return ("unrecognized", None, []) if found is None else ("ok", None, found)


def files_of(path: str):
    """File system and path there, for local paths and URLs."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def fetched(path: str, cap: int | None) -> bytes | None:
    """The object's bytes, one more than ``cap`` at most; None if it isn't there."""
    files, at = files_of(path)
    try:
        with files.open_input_stream(at, compression=None) as source:
            return source.read(None if cap is None else min(cap + 1, 2**62))
    except FileNotFoundError:
        return None


def records_of(objects: DataFrame, path: str = "path", mode: str = "mode", cap: int = 134_217_728, retry: bool = True, content: str | None = None) -> DataFrame:
    """The columns of ``objects`` with RECORDS: a row per record, and one without ``pos`` for an object that has none.

    ``mode`` is buffer (at most ``cap`` bytes, before and after decompression) or stream (no cap). With ``retry``, a buffered
    object that turns out too large is read as a stream. What is wrong with an object is its status, never an exception, so
    that one object can't fail the others. An object is read by one task, its records leave in batches. ``content``: a column
    that already has the bytes, as Spark's binaryFile source gives them; it is dropped, and ``path`` isn't read.
    """
    names = [c for c in objects.columns if c != content]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in objects.schema.fields if f.name != content) + ", " + RECORDS

    def load(row: pa.RecordBatch, limit: int | None) -> bytes | None:
        if content is None:
            return fetched(row.column(path)[0].as_py(), limit)
        return row.column(content)[0].as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                limit = cap if row.column(mode)[0].as_py() == "buffer" else None
                data = load(row, limit)
                if data is None:
                    status, error, found = "missing", "no such object", []
                else:
                    too_much = limit is not None and len(data) > limit
                    status, error, found = ("too_large", f"over {limit} bytes", []) if too_much else opened(data, limit)
                    if status == "too_large" and retry:
                        data = load(row, None) or b""
                        status, error, found = opened(data, None)
                size = len(data or b"")
                for a in range(0, max(len(found), 1), BATCH):
                    part = found[a : a + BATCH]
                    n = max(len(part), 1)
                    take = pa.array([0] * n)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(row.column(c).take(take) for c in names),
                            pa.array([status] * n), pa.array([error] * n, pa.string()), pa.array([size] * n, pa.int64()),
                            pa.array(range(a, a + n) if part else [None], pa.int32()), pa.array(part or [None], pa.string()), pa.array([parses(x) for x in part] or [None], pa.bool_()),
                        ],
                        [*names, "status", "error", "bytes_in", "pos", "raw", "parse_ok"],
                    )

    return objects.mapInArrow(run, schema)


def sample(path: str) -> list[str]:
    """The records of a single file, every one of which has to parse; raises otherwise."""
    data = fetched(path, None)
    if data is None:
        raise FileNotFoundError(path)
    found = split_envelope(gunzip(data))
    if found is None:
        raise JsonError("no Records array")
    for i, x in enumerate(found):
        if not parses(x):
            raise JsonError(f"record {i + 1} does not parse")
    return found


def stream_of(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as a stream of (path, size), without their content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))
