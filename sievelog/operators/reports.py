"""Reports of a dry run over a sample: a line for each record, and the totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def record_lines(decisions: DataFrame, names: list[str], pos: str = "pos") -> DataFrame:
    """(record_no, decision, rule, line) with records counted from 1."""
    rule = F.when(F.col("rule_idx").isNotNull(), F.element_at(F.array(*map(F.lit, names)), F.col("rule_idx") + 1)) if names else F.lit(None).cast("string")
    no = (F.col(pos) + 1).cast("long")
    line = F.when(rule.isNull(), F.concat(F.lit("KEEP record "), no)).otherwise(F.concat(F.lit("DROP record "), no, F.lit(' (rule: "'), rule, F.lit('")')))
    return decisions.select(no.alias("record_no"), F.when(rule.isNull(), "KEEP").otherwise("DROP").alias("decision"), rule.alias("rule"), line.alias("line"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / whole, 1))


def summary(decisions: DataFrame) -> DataFrame:
    """One row: kept and dropped records with their percentages, to one decimal."""
    kept, total = F.count_if(F.col("rule_idx").isNull()), F.count(F.lit(1))
    return decisions.agg(kept.alias("kept"), percent(kept, total).alias("kept_percent"), (total - kept).alias("dropped"), percent(total - kept, total).alias("dropped_percent"))
