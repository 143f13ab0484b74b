"""A run: notification payloads or listed objects in, filtered objects and counters out."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import objects as ops
from .operators.counting import COUNTERS, metric_lines
from .operators.sink import copy_objects, write_objects
from .plans.compiler import decided
from .plans.config_store import ConfigStore
from .plans.rules import ConfigError, RuleSet
from .plans.settings import Settings
from .session import ship
from .sources.envelopes import listed, located, records_of
from .sources.notifications import DECODERS, exploded

KEYS = ["item", "place", "ack_id", "bucket", "key"]


class RunError(RuntimeError):
    """The whole run has to be repeated."""


@dataclass
class Outcome:
    """``results``: a row for each object; ``snapshot``: the counters of this run; ``failed``: ids to deliver again."""

    results: DataFrame
    snapshot: dict[str, int]
    rule_drops: dict[str, int]
    failed: list[str]
    lines: list[str] = field(default_factory=list)

    @property
    def response(self) -> dict:
        return {"batchItemFailures": [{"itemIdentifier": x} for x in self.failed]}


@dataclass
class AuditPipeline:
    """``address``: (bucket, key) -> path, here as a folder with a folder for each bucket."""

    settings: Settings
    store: ConfigStore
    root: str
    emit: Callable[[str], None] = print
    _runs: int = 0

    def handle(self, spark: SparkSession, payloads: DataFrame, trigger: str = "sqs") -> Outcome:
        """Decodes notifications and filters their objects; publishes counters whether that succeeds or not."""
        counts = dict.fromkeys(COUNTERS, 0)
        drops: dict[str, int] = {}
        ship(spark)
        try:
            return self._handle(spark, payloads, trigger, counts, drops)
        finally:
            counts["config_load_errors"] += self.store.taken_failures()
            if self.settings.observability.metrics == "emf":
                for line in metric_lines(counts, drops, self.settings.observability.namespace, int(time.time() * 1000), self._runs == 0):
                    self.emit(line)
            self._runs += 1

    def _handle(self, spark, payloads, trigger, counts, drops) -> Outcome:
        s = self.settings
        decode = DECODERS[trigger]
        items = decode(payloads, s.sqs.body_format) if trigger == "sqs" else decode(payloads)
        items = items.withColumn("item", F.monotonically_increasing_id()).persist()
        errors = items.filter("decode_error is not null").select("ack_id", "decode_error")
        counts["decode_errors"] += errors.count()
        counts["items_without_objects"] += items.filter("decode_error is null and size(objects) = 0").count()
        if trigger != "sqs" and counts["decode_errors"]:
            raise RunError(f"a payload can't be decoded: {errors.first()['decode_error']}")
        rules = self.store.get()
        if rules is None and s.behavior.on_config_error == "closed":
            raise ConfigError("no rules could be loaded")
        objects = exploded(items.drop("payload")).filter("bucket is not null")
        out = self.filter_objects(objects, rules, counts, drops)
        failed = out.results.filter("outcome = 'failed'").select("ack_id", "error")
        if not s.behavior.partial_batch_failures or failed.filter("ack_id is null").head(1):
            first = failed.head(1) or errors.withColumnRenamed("decode_error", "error").head(1)
            if first:
                raise RunError(first[0]["error"])
        # as many as the messages of this run at most
        out.failed = sorted(r[0] for r in failed_ids(failed, errors).collect())
        items.unpersist()
        return out

    def filter_objects(self, objects: DataFrame, rules: RuleSet | None, counts: dict[str, int] | None = None, drops: dict[str, int] | None = None) -> Outcome:
        """Filters objects (item, place, ack_id, bucket, key, size). Guards are evaluated for all of them before anything is
        written. Without rules, objects are copied as they are."""
        s, counts, drops = self.settings, dict.fromkeys(COUNTERS, 0) if counts is None else counts, {} if drops is None else drops
        accepted = ops.key_accepted(F.col("key"), s.source)
        wanted = objects.filter(accepted).persist()
        counts["objects_excluded_by_key"] += objects.filter(~accepted).count()
        guard = ops.triggers_itself(F.col("bucket"), F.col("key"), s.destination.bucket, s.destination.key_prefix)
        if bad := wanted.filter(guard).head(1):
            counts["objects_failed"] += 1
            raise RunError(f"writing {bad[0]['key']} would notify about it again")
        target = F.concat(F.lit(f"{self.root}/{s.destination.bucket}/"), ops.destination_key(F.col("key"), s.destination.key_prefix))
        todo = wanted.withColumn("path", F.concat(F.lit(f"{self.root}/"), "bucket", F.lit("/"), "key")).withColumn("target", target).withColumn("mode", ops.mode(F.col("size"), s.processing))
        if rules is None:
            results = copy_objects(todo, KEYS, "path", "target", s.behavior.dry_run, s.behavior.on_missing_object)
        else:
            p, b = s.processing, s.behavior
            spread = todo.repartition(*([F.col("path")]))  # an object is a unit of work
            records = records_of(spread, cap=p.max_object_bytes, retry=p.mode == "auto")
            results = write_objects(decided(records, rules, parse_ok=F.col("parse_ok")), KEYS, "path", "target", p.gzip_level, b.dry_run, b.on_unrecognized_object, b.on_missing_object)
        results = results.persist()  # writing again after a loss gives the same bytes
        counted(results, rules, counts, drops)
        wanted.unpersist()
        return Outcome(results, counts, drops, [])


def failed_ids(failed: DataFrame, errors: DataFrame) -> DataFrame:
    """Ids of the messages to deliver again: of failed objects, and of bodies that can't be decoded."""
    return failed.select("ack_id").unionByName(errors.select("ack_id")).filter("ack_id is not null").distinct()


def counted(results: DataFrame, rules: RuleSet | None, counts: dict[str, int], drops: dict[str, int]) -> None:
    """Adds what RESULT rows say to the counters of a run."""
    done = results.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS[:6]),
        F.count_if(F.col("outcome").isin("written", "nothing_kept", "copied", "skipped_unrecognized")).alias("objects_processed"),
        F.count_if(F.col("outcome") == "skipped_missing").alias("objects_skipped"),
        F.count_if(F.col("outcome") == "failed").alias("objects_failed"),
        F.count_if("unrecognized").alias("unrecognized_objects"),
    ).first()
    for c in done.asDict():
        counts[c] += done[c]
    if rules is not None:
        for r in results.select(F.explode("drops").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():  # one for each rule at most
            name = rules.rules[r["i"]].name
            drops[name] = drops.get(name, 0) + r["n"]


def filter_folder(spark: SparkSession, source: str, target: str, rules: RuleSet, settings: Settings) -> Outcome:
    """Filters all objects below a folder into another, or a single named file into ``target``; for that one the key filter and
    the prefix don't count. A failing object never stops the others."""
    ship(spark)
    s, counts, drops = settings, dict.fromkeys(COUNTERS, 0), {}
    at, folder = located(spark, source)
    if folder is None:
        raise FileNotFoundError(f"{source} does not exist")
    to = located(spark, target)[0]
    to = re.sub("^file:/*", "/", to).rstrip("/")
    if folder:
        found = listed(spark, source)
        accepted, key = ops.key_accepted(F.col("rel"), s.source), ops.destination_key(F.col("rel"), s.destination.key_prefix)
        counts["objects_excluded_by_key"] = found.filter(~accepted).count()
        todo = found.filter(accepted).withColumn("target", ops.joined_key(F.lit(to), key))
        if bad := todo.filter(~ops.contained(key)).head(1):
            raise RunError(f"{bad[0]['rel']} would be written outside the target")
    else:
        size = spark.read.format("binaryFile").load(at).select("length").first()[0]
        todo = spark.createDataFrame([(at, source, size, to)], "path string, rel string, size long, target string")
    todo = todo.withColumn("mode", ops.mode(F.col("size"), s.processing))
    records = records_of(todo.repartition(F.col("path")), cap=s.processing.max_object_bytes, retry=s.processing.mode == "auto")
    decisions = decided(records, rules, parse_ok=F.col("parse_ok"))
    results = write_objects(decisions, ["rel"], "path", "target", s.processing.gzip_level, s.behavior.dry_run, s.behavior.on_unrecognized_object).persist()
    counted(results, rules, counts, drops)
    return Outcome(results, counts, drops, [])
