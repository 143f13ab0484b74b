"""Envelopes of survivors, written whole or not at all."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.envelopes import fetched, files_of

HEAD, TAIL = b'{"Records":[', b"]}"
#: Bytes of an object that are copied at once.
PART = 8_000_000


def envelope_text(pos: Column, raw: Column) -> Column:
    """An aggregate: the envelope of the records of a group in their order, each as it stands."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("pos"), raw.alias("raw")))), lambda x: x["raw"])
    return F.concat(F.lit(HEAD.decode()), F.array_join(ordered, ","), F.lit(TAIL.decode()))


class Upload:
    """A file that is written under another name and renamed once it is whole, so that a reader or a second attempt never sees
    a part of it. ``level``: of gzip; without, bytes are written as they are."""

    def __init__(self, path: str, level: int | None = None):
        self.files, self.at = files_of(path)
        self.files.create_dir(self.at.rpartition("/")[0], recursive=True)
        self.partial = f"{self.at}.{uuid.uuid4().hex}.partial"
        self.out = self.files.open_output_stream(self.partial, compression=None)
        self.packer = None if level is None else zlib.compressobj(level, zlib.DEFLATED, 31)
        self.size = 0

    def _put(self, body: bytes) -> None:
        self.out.write(body)
        self.size += len(body)

    def add(self, body: bytes) -> None:
        self._put(body if self.packer is None else self.packer.compress(body))

    def done(self) -> int:
        """The file's size, once it is there."""
        if self.packer is not None:
            self._put(self.packer.flush())
        self.out.close()
        self.files.move(self.partial, self.at)
        return self.size

    def drop(self) -> None:
        try:
            self.out.close()
            self.files.delete_file(self.partial)
        except OSError:
            pass


def canonical(path: str) -> str:
    """One name for a file however it is written; the file needn't exist, its folder's links are followed all the same."""
    from pyarrow import fs

    files, at = files_of(path)
    if not isinstance(files, fs.LocalFileSystem):
        return path
    return os.path.realpath(at)


def copied(source: str, target: str) -> int | None:
    """Copies an object as it is, in parts; None if it isn't there."""
    files, at = files_of(source)
    try:
        reader = files.open_input_stream(at, compression=None)
    except FileNotFoundError:
        return None
    out = Upload(target)
    try:
        with reader:
            while part := reader.read(PART):
                out.add(part)
        return out.done()
    except BaseException:
        out.drop()
        raise


RESULT = "outcome string, error string, records_in long, records_kept long, records_dropped long, parse_errors long, bytes_in long, bytes_out long, drops map<int,long>"
_COUNTS = ("records_in", "records_kept", "records_dropped", "parse_errors")


class _Object:
    """An object while its rows come in: counts, and the file that its survivors go to."""

    def __init__(self, row: pa.RecordBatch, keys: list[str], source: str, target: str, level: int, dry_run: bool):
        one = {c: row.column(c)[0].as_py() for c in dict.fromkeys([*keys, source, target, "status", "error", "bytes_in"])}
        self.keys, self.source, self.target = [one[k] for k in keys], one[source], one[target]
        self.status, self.error, self.bytes_in = one["status"], one["error"], one["bytes_in"]
        self.level, self.dry_run, self.upload, self.failure = level, dry_run, None, None
        self.counts, self.drops = np.zeros(4, np.int64), {}

    def guard(self) -> None:
        if canonical(self.source) == canonical(self.target):
            raise ValueError("would overwrite its source")

    def add(self, rows: pa.RecordBatch) -> None:
        """Rows of records, in their order."""
        if self.status != "ok" or self.failure or rows.column("pos").null_count:
            return
        rule = rows.column("rule_idx")
        raw = rows.column("raw").filter(rule.is_null())
        self.counts += [rows.num_rows, len(raw), rows.num_rows - len(raw), pc.sum(pc.equal(rows.column("parse_ok"), False)).as_py() or 0]
        for x in rule.drop_null().value_counts().to_pylist():
            self.drops[x["values"]] = self.drops.get(x["values"], 0) + x["counts"]
        if not len(raw) or self.dry_run:
            return
        try:
            lead = b","
            if self.upload is None:
                self.guard()
                self.upload, lead = Upload(self.target, self.level), HEAD
            self.upload.add(lead)
            self.upload.add(",".join(raw.to_pylist()).encode())
        except Exception as e:  # of this object alone
            self.fail(e)

    def fail(self, e: Exception) -> None:
        self.failure = f"{e}" if isinstance(e, ValueError) else f"{type(e).__name__}: {e}"
        if self.upload is not None:
            self.upload.drop()

    def result(self, on_unrecognized: str, on_missing: str) -> list:
        outcome, error, out = "failed", self.error, 0
        try:
            if self.failure is None and self.status == "ok":
                outcome = "written" if self.counts[1] else "nothing_kept"
                if self.upload is not None:
                    self.upload.add(TAIL)
                    out = self.upload.done()
            elif self.status == "unrecognized":
                outcome = {"copy": "copied", "skip": "skipped_unrecognized", "error": "failed"}[on_unrecognized]
                error = "no Records array" if outcome == "failed" else None
                if outcome == "copied" and not self.dry_run:
                    self.guard()
                    out = copied(self.source, self.target) or 0
            elif self.status == "missing" and on_missing == "skip":
                outcome, error = "skipped_missing", None
        except Exception as e:  # of this object alone
            self.fail(e)
        if self.failure is not None:
            outcome, error, out = "failed", self.failure, 0
        done = outcome in ("written", "nothing_kept")
        return [*self.keys, outcome, error, *(self.counts if done else np.zeros(4, np.int64)).tolist(), self.bytes_in, out, list(self.drops.items()) if done else [], self.status == "unrecognized"]


def write_objects(decisions: DataFrame, keys: list[str], source: str, target: str, level: int = 6, dry_run: bool = False, on_unrecognized: str = "copy", on_missing: str = "error") -> DataFrame:
    """One row per object (``keys``) with RESULT, after its survivors were written to the path in ``target``.

    ``decisions`` are rows of sources.envelopes.records_of with rule_idx, straight from there: the rows of an object follow
    each other in one task, the first has position 0 or none. So nothing is shuffled, and survivors are compressed as they
    come; a task holds a batch of an object. Nothing kept writes nothing. Counts are those of the object if it was written
    or had nothing to keep, else zero. A failing write is the object's error, and no other's; an object is never written
    over its own source, by whatever name. A dry run writes nothing and says what it would.
    """
    shape = ", ".join(f"`{k}` {decisions.schema[k].dataType.simpleString()}" for k in keys)
    columns = list(dict.fromkeys([*keys, source, target, "status", "error", "bytes_in", "pos", "raw", "parse_ok", "rule_idx"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Object | None = None
        for batch in batches:
            pos = batch.column("pos")
            starts = np.flatnonzero(pc.fill_null(pc.equal(pos, 0), True).to_numpy(zero_copy_only=False)).tolist()
            kinds = [batch.schema.field(k).type for k in keys]
            cuts = [0, *(s for s in starts if s), batch.num_rows]
            made = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b and a in starts:
                    if now is not None:
                        made.append(now.result(on_unrecognized, on_missing))
                    now = _Object(batch.slice(a, 1), keys, source, target, level, dry_run)
                now.add(batch.slice(a, b - a))
            if made:
                yield _results(made, keys, kinds)
        if now is not None:
            yield _results([now.result(on_unrecognized, on_missing)], keys, kinds)

    return decisions.select(*columns).mapInArrow(run, f"{shape}, {RESULT}, unrecognized boolean")


def _results(rows: list[list], keys: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    kinds = [*kinds, pa.string(), pa.string()] + [pa.int64()] * 6 + [pa.map_(pa.int32(), pa.int64()), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*keys, "outcome", "error", *_COUNTS, "bytes_in", "bytes_out", "drops", "unrecognized"])


def copy_objects(objects: DataFrame, keys: list[str], source: str, target: str, dry_run: bool = False, on_missing: str = "error") -> DataFrame:
    """RESULT rows after the objects were copied as they are."""
    shape = ", ".join(f"`{k}` {objects.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for b in batches:
            rows = []
            for row in b.to_pylist():  # a row is an object
                outcome, error, n = "copied", None, 0
                try:
                    if not dry_run and canonical(row[source]) == canonical(row[target]):
                        raise ValueError("would overwrite its source")
                    found = copied(row[source], row[target]) if not dry_run else (None if (data := fetched(row[source], None)) is None else len(data))
                    n = found or 0
                    if found is None:
                        outcome, error = ("skipped_missing", None) if on_missing == "skip" else ("failed", "no such object")
                except Exception as e:  # of this object alone
                    outcome, error = "failed", f"{type(e).__name__}: {e}"
                rows.append([*(row[k] for k in keys), outcome, error, 0, 0, 0, 0, n, 0 if dry_run else n, [], False])
            if rows:
                yield _results(rows, keys, [b.schema.field(k).type for k in keys])

    return objects.select(*dict.fromkeys([*keys, source, target])).mapInArrow(run, f"{shape}, {RESULT}, unrecognized boolean")
