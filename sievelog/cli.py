"""Command line: validate, validate-settings, test and filter."""

from __future__ import annotations

import argparse
import os
import sys

from .plans.config_store import source_for
from .plans.rules import ConfigError, parse_rules, validation_report
from .plans.settings import Settings, from_parts, load


def _rules(uri: str):
    return parse_rules(source_for(uri).read()[0])


def _session():
    from pyspark.sql import SparkSession

    from .session import ship

    return ship(SparkSession.builder.appName("sievelog").getOrCreate())


def validate(args, say) -> int:
    lines, ok = validation_report(_rules(args.rules), args.max_unindexed)
    for line in lines:
        say(line)
    return 0 if ok else 1


def validate_settings(args, say) -> int:
    if args.path:
        with open(args.path, "rb") as f:
            from_parts(f.read(), os.environ)
    else:
        load()
    say("settings are valid")
    return 0


def test(args, say) -> int:
    from pyspark.sql import functions as F

    from .operators.reports import record_lines, summary
    from .plans.compiler import decided
    from .sources.envelopes import sample

    rules, texts = _rules(args.rules), sample(args.sample)
    spark = _session()
    frame = spark.createDataFrame(list(enumerate(texts)), "pos int, raw string")
    decisions = decided(frame, rules).persist()
    for r in record_lines(decisions, [r.name for r in rules.rules]).orderBy("record_no").toLocalIterator():
        say(r["line"])
    s = summary(decisions.select(F.col("rule_idx"))).first()
    say(f"{s['kept']} kept ({s['kept_percent']:.1f}%), {s['dropped']} dropped ({s['dropped_percent']:.1f}%)")
    return 0


def filter_(args, say) -> int:
    from .pipeline import filter_folder

    settings = Settings()
    if args.settings:
        with open(args.settings, "rb") as f:
            settings = from_parts(f.read(), os.environ)
    out = filter_folder(_session(), args.source, args.target, _rules(args.rules), settings)
    counts: dict[str, int] = {}
    for r in out.results.select("rel", "outcome", "error").orderBy("rel").toLocalIterator():
        counts[r["outcome"]] = counts.get(r["outcome"], 0) + 1
        say(f"{r['outcome']}: {r['rel']}" + (f" ({r['error']})" if r["error"] else ""))
    if not counts:
        say("no in-scope objects found")
    say(", ".join(f"{n} {k}" for k, n in sorted(counts.items())) + f"; {out.snapshot['records_kept']} of {out.snapshot['records_in']} records kept")
    for name, n in sorted(out.rule_drops.items()):
        say(f"{n} dropped by \"{name}\"")
    return 1 if counts.get("failed") else 0


def main(argv: list[str] | None = None, say=print) -> int:
    parser = argparse.ArgumentParser(prog="sievelog")
    sub = parser.add_subparsers(required=True)
    p = sub.add_parser("validate")
    p.add_argument("rules")
    p.add_argument("--max-unindexed", type=int)
    p.set_defaults(run=validate)
    p = sub.add_parser("validate-settings")
    p.add_argument("path", nargs="?")
    p.set_defaults(run=validate_settings)
    p = sub.add_parser("test")
    p.add_argument("rules")
    p.add_argument("sample")
    p.set_defaults(run=test)
    p = sub.add_parser("filter")
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--rules", required=True)
    p.add_argument("--settings")
    p.set_defaults(run=filter_)
    args = parser.parse_args(argv)
    try:
        return args.run(args, say)
    except (ConfigError, OSError, ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
