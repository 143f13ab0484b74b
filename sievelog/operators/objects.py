"""Column expressions on object references: which are processed, how, and where to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.regexes import translated
from ..plans.settings import Processing, Source


def key_accepted(key: Column, source: Source) -> Column:
    return key.rlike(translated(source.include_key_regex)) & ~key.rlike(translated(source.exclude_key_regex))


def destination_key(key: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), key)


def mode(size: Column, processing: Processing) -> Column:
    """buffer or stream; of unknown size: buffer."""
    if processing.mode != "auto":
        return F.lit(processing.mode)
    return F.when(size > processing.stream_threshold_bytes, "stream").otherwise("buffer")


def triggers_itself(bucket: Column, key: Column, to_bucket: str, prefix: str) -> Column:
    """Whether writing the result would notify about it again."""
    same = destination_key(key, prefix) == key
    return (bucket == to_bucket) & (same | (key.startswith(prefix) if prefix else F.lit(False)))


def contained(rel: Column) -> Column:
    """Whether a relative key stays below the folder that it is written to."""
    return ~rel.startswith("/") & ~F.exists(F.split(rel, "/"), lambda s: s == "..")


def joined_key(folder: Column, rel: Column) -> Column:
    trimmed = F.regexp_replace(folder, "/+$", "")
    return F.when(trimmed == "", rel).otherwise(F.concat_ws("/", trimmed, rel))
