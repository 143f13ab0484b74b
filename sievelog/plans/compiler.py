"""Rules as Catalyst expressions, and their plain Python meaning."""

from __future__ import annotations

import re
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import Path, fast_scalar, get, resolved, scalar, slot_schema
from ..functions.regexes import translated
from ..functions.strict_json import JsonError, parse_record
from .rules import Match, Rule, RuleSet

#: Strict parsing keeps the last of duplicate keys.
CONF = {"spark.sql.variant.allowDuplicateKeys": "true"}


def condition(m: Match, text: Column) -> Column:
    """The bare test of a scalar; ``absent`` is tested on whether there is one."""
    if m.kind == "regex":
        return text.rlike(translated(m.value))
    if m.kind == "equals":
        return text == F.lit(m.value)
    return text.isin(*m.value) if m.kind == "any_of" else text.isNotNull()


def _test(m: Match, slots: dict[Path, Column], variant: Column) -> Column:
    if m.path in slots:
        found = F.coalesce(condition(m, slots[m.path]), F.lit(False))
    else:
        found = resolved(variant, m.path, lambda text: condition(m, text))
    if m.kind == "absent" and m.value:
        found = ~found
    return ~found if m.negate else found


def once(value: Column) -> Column:
    """The same value, which the optimizer computes where it stands: the only element of an array, by a place that is 0 in every
    row, but formally random. The value is always evaluated, so what it has in common with others still is computed once."""
    return F.get(F.array(value), (F.rand(0) * 0).cast("int"))


def decided(records: DataFrame, rules: RuleSet, raw: str = "raw", parse_ok: Column | None = None, out: str = "rule_idx") -> DataFrame:
    """``records`` with the number of the first rule that matches, null to keep. A record that doesn't parse is kept.

    All key paths are read in one pass over the text, into a struct with just those leaves; paths with subscripts share one
    variant. Both are columns of a lower projection, so that each is computed once however many rules use it. The decision is
    formally not deterministic, which keeps filters on it from being pushed below that projection with the parse inlined;
    filters on other columns belong before this.
    """
    for k, v in CONF.items():
        records.sparkSession.conf.set(k, v)
    simple = [p for p in rules.paths if p.keys and "`" not in p.text]
    schema = slot_schema(simple) if simple else None
    names = records.columns
    if schema is None:
        simple = []
    frame = records
    if simple:
        frame = frame.withColumn("__parsed", F.from_json(F.col(raw), schema))
    others = [p for p in rules.paths if p not in simple]
    if others:
        frame = frame.withColumn("__variant", F.try_parse_json(F.col(raw)))
    slots, picked = {}, []
    for i, p in enumerate(simple):
        picked.append(fast_scalar(F.col("__parsed"), F.col(raw), p).alias(f"__slot{i}"))
        slots[p] = F.col(f"__slot{i}")
    for i, p in enumerate(x for x in others if not x.wild):
        picked.append(scalar(F.col("__variant"), p.steps).alias(f"__deep{i}"))
        slots[p] = F.col(f"__deep{i}")
    frame = frame.select("*", *picked)
    variant = F.col("__variant")

    def matches(r: Rule) -> Column:
        return reduce(lambda a, b: a & b, [_test(m, slots, variant) for m in r.ordered()])

    decision = F.lit(None).cast("int")
    if rules.rules:
        chain = None
        for i, r in enumerate(rules.rules):
            chain = F.when(matches(r), F.lit(i)) if chain is None else chain.when(matches(r), F.lit(i))
        decision = chain.cast("int")
    if parse_ok is not None:
        decision = F.when(parse_ok, decision)
    return frame.select(*names, once(decision).alias(out))


@cache
def _python(pattern: str) -> re.Pattern:
    return re.compile(translated(pattern, java=False))


def evaluate(text: str, rules: RuleSet) -> int | None:
    """The first rule that a record matches, rule by rule in Python: what the expressions are held against in tests."""
    try:
        value = parse_record(text)
    except JsonError:
        return None
    for i, r in enumerate(rules.rules):
        for m in r.matches:
            texts = get(value, m.path.steps)
            found = any(
                {"regex": lambda t=t, m=m: bool(_python(m.value).search(t)), "equals": lambda t=t, m=m: t == m.value, "any_of": lambda t=t, m=m: t in m.value, "absent": lambda: True}[m.kind]() for t in texts
            )
            if m.kind == "absent" and m.value:
                found = not found
            if found == m.negate:
                break
        else:
            return i
    return None
