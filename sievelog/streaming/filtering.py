"""Continuous filtering: every micro-batch of payloads or of new files is a run of its own.

The checkpoint remembers which input a batch had, and a batch that is repeated writes the same bytes to the same places, so
that a restart neither loses an object nor doubles one. Objects that fail go to the failures table, not to an exception.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..pipeline import AuditPipeline, Outcome


def _start(stream: DataFrame, run: Callable[[DataFrame], Outcome], checkpoint: str, failures: str | None, once: bool) -> StreamingQuery:
    def batch(frame: DataFrame, epoch: int) -> None:
        if frame.isEmpty():
            return
        out = run(frame)
        if failures:
            bad = out.results.filter("outcome = 'failed'").select("ack_id", "bucket", "key", "error").withColumn("epoch", F.lit(epoch))
            bad.write.mode("overwrite").parquet(f"{failures}/epoch={epoch}")
        out.results.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def filter_payloads(payloads: DataFrame, pipeline: AuditPipeline, trigger: str, checkpoint: str, failures: str | None = None, once: bool = False) -> StreamingQuery:
    """``payloads``: a stream with a ``payload`` column."""
    return _start(payloads, lambda frame: pipeline.handle(frame.sparkSession, frame, trigger), checkpoint, failures, once)


def filter_files(files: DataFrame, pipeline: AuditPipeline, bucket: str, checkpoint: str, failures: str | None = None, once: bool = False) -> StreamingQuery:
    """``files``: sources.envelopes.stream_of a bucket's folder."""
    inside = F.regexp_replace("path", rf"^.*?/{bucket}/", "")
    objects = files.select(F.xxhash64("path").alias("item"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("ack_id"), F.lit(bucket).alias("bucket"), inside.alias("key"), "size")
    return _start(objects, lambda frame: pipeline.filter_objects(frame, pipeline.store.get()), checkpoint, failures, once)
