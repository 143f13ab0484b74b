"""Per-object tallies, and what a run publishes of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters of a run, in the order in which they are published.
COUNTERS = (
    "records_in", "records_kept", "records_dropped", "parse_errors", "bytes_in", "bytes_out", "objects_processed", "objects_skipped", "objects_failed",
    "objects_excluded_by_key", "unrecognized_objects", "decode_errors", "items_without_objects", "config_load_errors",
)


def tally(decisions: DataFrame, *keys: str) -> DataFrame:
    """records_in, records_kept, records_dropped and parse_errors by ``keys``; ``rule_idx`` null is kept."""
    kept = F.col("rule_idx").isNull()
    broken = F.count_if(~F.col("parse_ok")) if "parse_ok" in decisions.columns else F.lit(0).cast("long")
    return decisions.groupBy(*keys).agg(F.count(F.lit(1)).alias("records_in"), F.count_if(kept).alias("records_kept"), F.count_if(~kept).alias("records_dropped"), broken.alias("parse_errors"))


def rule_drops(decisions: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """Dropped records by ``keys`` and the name of the first rule that matched."""
    named = F.element_at(F.array(*map(F.lit, names)) if names else F.array(F.lit("")), F.col("rule_idx") + 1)
    return decisions.filter("rule_idx is not null").groupBy(*keys, named.alias("rule")).agg(F.count(F.lit(1)).alias("drops"))


def metric_lines(snapshot: dict, drops: dict[str, int], namespace: str, timestamp_ms: int, cold_start: bool) -> list[str]:
    """Embedded-metric lines: one with all counters, one more for each rule that dropped records, in the order of names."""

    def line(dimensions: list[list[str]], units: dict[str, str], values: dict) -> str:
        metrics = [{"Name": k, "Unit": u} for k, u in units.items()]
        head = {"_aws": {"Timestamp": timestamp_ms, "CloudWatchMetrics": [{"Namespace": namespace, "Dimensions": dimensions, "Metrics": metrics}]}}
        return json.dumps(head | values, separators=(",", ":"))

    camel = lambda s: "".join(w.capitalize() for w in s.split("_"))
    units = {camel(c): "Bytes" if c.startswith("bytes") else "Count" for c in COUNTERS} | {"ColdStart": "Count"}
    out = [line([[]], units, {camel(c): snapshot.get(c, 0) for c in COUNTERS} | {"ColdStart": int(cold_start)})]
    return out + [line([["Rule"]], {"RuleDrops": "Count"}, {"Rule": k, "RuleDrops": v}) for k, v in sorted(drops.items()) if v]
