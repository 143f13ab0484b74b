"""Registered queries of the filtering engine over the driver's tables, and the SQL that they have to agree with.

``events`` stands in for audit records: each row becomes a JSON record, fields left out where they are null, and the SQL
states what a rule means on the plain columns, so that it checks the way through JSON and doesn't repeat it.
"""

from __future__ import annotations

import gzip
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import objects as ops
from .operators.counting import COUNTERS, metric_lines, rule_drops, tally
from .operators.reports import record_lines, summary
from .operators.sink import envelope_text, write_objects
from .pipeline import counted, failed_ids
from .plans.compiler import decided
from .plans.rules import RuleSet, parse_rules
from .plans.settings import Processing, Source
from .session import ship
from .sources.envelopes import records_of
from .sources.notifications import decode_eventbridge, decode_s3, decode_sns, decode_sqs, exploded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: What a record has, as SQL over ``events`` for both engines.
FIELDS = {
    "source": "concat('svc', cast(user_id % 5 as string), '.example.com')",
    "kind": "case when user_id % 3 = 0 then 'AssumedRole' when user_id % 3 = 1 then 'User' end",
    "role": "case when user_id % 2 = 0 then concat('role-', cast(user_id % 7 as string)) end",
    "error": "case when event_id % 5 = 0 then 'AccessDenied' when event_id % 5 = 1 then 'Throttling' end",
    "first_arn": "case when event_id % 4 <> 0 then concat('arn:', event_type) end",
    "second_arn": "case when event_id % 3 = 0 then 'arn:extra' end",
}


#: Decisions as numbers without null, as engines differ in how they hand those over: -1 is kept.
KEPT = "coalesce(rule_idx, -1) as rule_idx"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, raw): a JSON record for each event."""
    e = table(spark, sf_dir, "events")
    f = {k: F.expr(v) for k, v in FIELDS.items()}
    issuer = F.when(f["role"].isNotNull(), F.struct(F.struct(f["role"].alias("userName")).alias("sessionIssuer")))
    arns = F.filter(F.array(F.struct(f["first_arn"].alias("ARN")), F.struct(f["second_arn"].alias("ARN"))), lambda x: x["ARN"].isNotNull())
    record = F.struct(
        F.col("event_type").alias("eventName"), f["source"].alias("eventSource"), F.struct(f["kind"].alias("type"), issuer.alias("sessionContext")).alias("userIdentity"), F.from_json("props", "k long").alias("requestParameters"),
        arns.alias("resources"), f["error"].alias("errorCode"), (F.col("event_id") % 2 == 0).alias("readOnly"), (F.col("event_id") % 8 / 4.0).alias("ratio"), F.concat(F.lit("req "), F.col("event_id").cast("string")).alias("requestID"), F.struct(F.lit(1).alias("x")).alias("nested"),
    )
    return e.select("event_id", "user_id", F.to_json(record).alias("raw"))


def _columns() -> str:
    return ", ".join(f"{v.replace(' as string)', ' as varchar)')} as {k}_" for k, v in FIELDS.items())


BASE = f"(select *, cast(json_extract_string(props, '$.k') as bigint) as k_, {_columns()} from events) e"


def rules_of(*rules: tuple[str, str], version: str = "2.0.0") -> RuleSet:
    return parse_rules(f"version: {version}\nrules:\n" + "\n".join(f"  - {{name: '{n}', matches: [{m}]}}" for n, m in rules))


def _rule(name: str, sql: str | list[str], *rules: str, version: str = "2.0.0") -> None:
    """A query that returns the decision on each event, against the conditions of its rules in SQL."""
    sets = rules_of(*((f"r{i}", r) for i, r in enumerate(rules)), version=version)
    QUERIES[name] = lambda spark, d: decided(records(spark, d), sets).selectExpr("event_id", KEPT)
    cases = " ".join(f"when {s} then {i}" for i, s in enumerate([sql] if isinstance(sql, str) else sql))
    SQL[name] = f"select event_id, cast(case {cases} else -1 end as integer) as rule_idx from {BASE}"


ALL = (
    "{field: eventName, equals: purchase}, {field: errorCode, absent: true}",
    "{field: eventSource, regex: '^svc(1|3)\\.example\\.com$'}, {field: eventName, any_of: [view, click]}",
    "{field: 'resources[*].ARN', equals: 'arn:extra'}, {field: userIdentity.sessionContext.sessionIssuer.userName, regex: '[2-4]$'}",
    "{field: errorCode, regex: Denied, negate: true}, {field: userIdentity.type, equals: User}, {field: readOnly, equals: 'true'}",
    "{field: requestParameters.k, any_of: ['7', '42']}",
)
ALL_SQL = [
    "event_type = 'purchase' and error_ is null",
    "user_id % 5 in (1, 3) and event_type in ('view', 'click')",
    "second_arn_ is not null and user_id % 2 = 0 and user_id % 7 in (2, 3, 4)",
    "coalesce(error_, '') <> 'AccessDenied' and kind_ = 'User' and event_id % 2 = 0",
    "k_ in (7, 42)",
]
NAMES = [f"r{i}" for i in range(len(ALL))]

_rule("rule_equals", "event_type = 'purchase'", "{field: eventName, equals: purchase}")
_rule("rule_any_of", "event_type in ('click', 'view')", "{field: eventName, any_of: [click, view]}")
_rule("rule_regex_anchored", "user_id % 5 in (1, 3)", "{field: eventSource, regex: '^svc(1|3)\\.example\\.com$'}")
_rule("rule_regex_search", "regexp_matches(event_type, 'i[eg]')", "{field: eventName, regex: 'i[eg]'}")
_rule("rule_absent_true", "error_ is null", "{field: errorCode, absent: true}")
_rule("rule_absent_false", "error_ is not null", "{field: errorCode, absent: false}")
_rule("rule_absent_object", "true", "{field: nested, absent: true}")
_rule("rule_negate_regex", "coalesce(error_ <> 'AccessDenied', true)", "{field: errorCode, regex: Denied, negate: true}")
_rule("rule_negate_equals", "coalesce(kind_ <> 'User', true)", "{field: userIdentity.type, equals: User, negate: true}")
_rule("rule_negate_any_of", "coalesce(error_ not in ('AccessDenied'), true)", "{field: errorCode, any_of: [AccessDenied, Other], negate: true}")
_rule("rule_negate_absent", "role_ is not null", "{field: userIdentity.sessionContext.sessionIssuer.userName, absent: true, negate: true}")
_rule("rule_and_or_first_match", ALL_SQL, *ALL)
_rule("path_nested", "role_ = 'role-4'", "{field: userIdentity.sessionContext.sessionIssuer.userName, equals: role-4}")
_rule("path_index", "coalesce(first_arn_, second_arn_) = 'arn:extra'", "{field: 'resources[0].ARN', equals: 'arn:extra'}")
_rule("path_wildcard", "second_arn_ = 'arn:extra'", "{field: 'resources[*].ARN', equals: 'arn:extra'}")
_rule("path_wildcard_negated", "second_arn_ is null", "{field: 'resources[*].ARN', equals: 'arn:extra', negate: true}")
_rule("path_wildcard_absent", "first_arn_ is null and second_arn_ is null", "{field: 'resources[*].ARN', absent: true}")
_rule("path_v1_literal", "kind_ = 'AssumedRole'", "{field_name: userIdentity.type, regex: '^AssumedRole$'}", version="1.0.0")
_rule("path_v1_no_subscript", "false", "{field_name: 'resources[0].ARN', regex: '.*'}", version="1.0.0")
_rule("scalar_coercion", ["k_ = 42", "event_id % 8 = 2", "event_id % 8 = 4", "event_id % 2 = 1"], "{field: requestParameters.k, equals: '42'}", "{field: ratio, equals: '0.5'}", "{field: ratio, equals: '1.0'}", "{field: readOnly, equals: 'false'}")


def _query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


@_query("props_json_filter", "select event_id, cast(case when regexp_matches(json_extract_string(props, '$.k'), '^[1-3]') then 0 else -1 end as integer) as rule_idx from events")
def props_json_filter(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("props").alias("raw"))
    return decided(e, rules_of(("r0", "{field: k, regex: '^[1-3]'}"))).selectExpr("event_id", KEPT)


DECIDED = f"(select event_id, user_id, case {' '.join(f'when {s} then {i}' for i, s in enumerate(ALL_SQL))} end as rule_idx from {BASE}) x"


def _decisions(spark, d) -> DataFrame:
    return decided(records(spark, d), rules_of(*zip(NAMES, ALL, strict=True))).withColumn("object", (F.col("user_id") % 16).cast("long"))


@_query("rule_drops", f"select 'r' || rule_idx as rule, count(*) as drops from {DECIDED} where rule_idx is not null group by 1")
def rule_drops_(spark, d):
    return rule_drops(_decisions(spark, d), NAMES)


TALLY = "count(*) as records_in, count(*) filter (rule_idx is null) as records_kept, count(*) filter (rule_idx is not null) as records_dropped"


@_query("tally_by_object", f"select user_id % 16 as object, {TALLY}, cast(0 as bigint) as parse_errors from {DECIDED} group by 1")
def tally_by_object(spark, d):
    return tally(_decisions(spark, d), "object")


@_query("reconciliation", f"select {TALLY}, (select count(*) from {DECIDED} where rule_idx is not null) as sum_rule_drops from {DECIDED}")
def reconciliation(spark, d):
    x = _decisions(spark, d)
    return tally(x.withColumn("all", F.lit(0)), "all").select("records_in", "records_kept", "records_dropped").crossJoin(rule_drops(x, NAMES).agg(F.sum("drops").alias("sum_rule_drops")))  # a row each


@_query("key_filter", "select page_id, regexp_matches(key, '\\.json\\.gz$') and not regexp_matches(key, '(/CloudTrail-Digest/|/CloudTrail-Insight/|/$)') as accepted from (select page_id, url || case page_id % 4 when 0 then '/CloudTrail-Digest/a.json.gz' when 1 then '/a.json.gz' when 2 then '/a.json' else '/' end as key from pages) k")
def key_filter(spark, d):
    tails = F.element_at(F.array(*map(F.lit, ("/CloudTrail-Digest/a.json.gz", "/a.json.gz", "/a.json", "/"))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", ops.key_accepted(F.concat("url", tails), Source()).alias("accepted"))


@_query("dest_key", "select page_id, 'filtered/' || url as dest, case when page_id % 2 = 0 then 'base/' || url else url end as joined from pages")
def dest_key(spark, d):
    folder = F.when(F.col("page_id") % 2 == 0, "base/").otherwise("")
    return table(spark, d, "pages").select("page_id", ops.destination_key(F.col("url"), "filtered/").alias("dest"), ops.joined_key(folder, F.col("url")).alias("joined"))


@_query("self_trigger_flags", "select s_suppkey, s_suppkey % 3 = 0 and s_suppkey % 2 = 0 as with_prefix, s_suppkey % 3 = 0 as without_prefix from supplier")
def self_trigger_flags(spark, d):
    bucket = F.when(F.col("s_suppkey") % 3 == 0, "out").otherwise("in")
    key = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "filtered/").otherwise("raw/"), F.col("s_name"))
    return table(spark, d, "supplier").select("s_suppkey", ops.triggers_itself(bucket, key, "out", "filtered/").alias("with_prefix"), ops.triggers_itself(bucket, key, "out", "").alias("without_prefix"))


@_query("containment", "select s_suppkey, s_suppkey % 4 not in (1, 2) as contained from supplier")
def containment(spark, d):
    head = F.element_at(F.array(*map(F.lit, ("a/b..c/", "a/../", "/", "..a/"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", ops.contained(F.concat(head, F.col("s_name"))).alias("contained"))


def _created(e: DataFrame) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("ObjectCreated:Put", "s3:ObjectCreated:Copy", "ObjectRemoved:Delete"))), (F.col("event_id") % 3 + 1).cast("int"))
    key = F.concat(F.lit("a+b%3D"), F.col("event_id").cast("string"), F.lit("%zz.json.gz"))
    record = F.struct(name.alias("eventName"), F.struct(F.struct(F.col("event_type").alias("name")).alias("bucket"), F.struct(key.alias("key"), F.col("user_id").alias("size")).alias("object")).alias("s3"))
    return e.select("event_id", F.to_json(F.struct(F.array(record).alias("Records"))).alias("payload"))


CREATED = "'a b=' || event_id || '%zz.json.gz'"


@_query("decode_s3", f"select event_id, event_type as bucket, {CREATED} as key, user_id as size from events where event_id % 3 <> 2")
def decode_s3_(spark, d):
    return exploded(decode_s3(_created(table(spark, d, "events")))).select("event_id", "bucket", "key", "size")


@_query("decode_sns", f"select event_id, case when event_id % 7 <> 0 and event_id % 3 <> 2 then event_type end as bucket, case when event_id % 7 <> 0 and event_id % 3 <> 2 then {CREATED} end as key, event_id % 7 = 0 as failed from events")
def decode_sns_(spark, d):
    inner = _created(table(spark, d, "events"))
    message = F.when(F.col("event_id") % 7 == 0, "garbage").otherwise(F.col("payload"))
    outer = inner.select("event_id", F.to_json(F.struct(F.array(F.struct(F.struct(message.alias("Message")).alias("Sns"))).alias("Records"))).alias("payload"))
    return exploded(decode_sns(outer)).select("event_id", "bucket", "key", F.col("decode_error").isNotNull().alias("failed"))


def _queue(spark, d, body: str) -> DataFrame:
    inner = _created(table(spark, d, "events"))
    wrapped = F.to_json(F.struct(F.lit("Notification").alias("Type"), F.col("payload").alias("Message")))
    text = F.when(F.col("event_id") % 7 == 0, "garbage").when(F.col("event_id") % 2 == 0, wrapped).otherwise(F.col("payload"))
    message = F.struct(F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("messageId"), text.alias("body"))
    return exploded(decode_sqs(inner.select("event_id", F.to_json(F.struct(F.array(message).alias("Records"))).alias("payload")), body)).select("event_id", "ack_id", "bucket", F.col("decode_error").isNotNull().alias("failed"))


QUEUE = "select event_id, 'm' || event_id as ack_id, case when not ({0}) and event_id % 3 <> 2 then event_type end as bucket, {0} as failed from events"


@_query("decode_sqs", QUEUE.format("event_id % 7 = 0"))
def decode_sqs_(spark, d):
    return _queue(spark, d, "auto")


@_query("decode_sqs_direct", QUEUE.format("event_id % 7 = 0 or event_id % 2 = 0"))
def decode_sqs_direct(spark, d):
    return _queue(spark, d, "s3")


@_query("decode_sqs_topic", QUEUE.format("event_id % 7 = 0 or event_id % 2 = 1"))
def decode_sqs_topic(spark, d):
    return _queue(spark, d, "sns")


@_query("decode_eventbridge", "select event_id, case when event_id % 5 <> 2 then event_type end as bucket, case when event_id % 5 <> 2 then 'a+b%3D' || event_id end as key, event_id % 5 = 2 as failed from events where event_id % 5 <> 1")
def decode_eventbridge_(spark, d):
    e = table(spark, d, "events")
    version = F.when(F.col("event_id") % 5 == 2, "2.0").otherwise("1.3")
    detail = F.struct(version.alias("event-version"), F.struct(F.col("event_type").alias("name")).alias("bucket"), F.struct(F.concat(F.lit("a+b%3D"), F.col("event_id").cast("string")).alias("key"), F.col("user_id").alias("size")).alias("object"))
    kind = F.when(F.col("event_id") % 5 == 1, "Object Deleted").otherwise("Object Created")
    return exploded(decode_eventbridge(e.select("event_id", F.to_json(F.struct(kind.alias("detail-type"), detail.alias("detail"))).alias("payload")))).select("event_id", "bucket", "key", F.col("decode_error").isNotNull().alias("failed"))


INDEX_RULES = (
    ("exact", "{field: eventSource, equals: svc1.example.com}, {field: eventName, any_of: [click, view]}"),
    ("source", "{field: eventSource, regex: '^svc(0|1)\\.example\\.com$'}"),
    ("name", "{field: eventName, regex: '^purchase$'}"),
    ("open", "{field: eventSource, regex: 'svc.*'}"),
    ("negated", "{field: eventName, equals: click, negate: true}"),
)


@_query("report_lines", f"select event_id + 1 as record_no, case when rule_idx is null then 'KEEP' else 'DROP' end as decision, 'r' || rule_idx as rule, case when rule_idx is null then 'KEEP record ' || (event_id + 1) else 'DROP record ' || (event_id + 1) || ' (rule: \"r' || rule_idx || '\")' end as line from {DECIDED}")
def report_lines(spark, d):
    return record_lines(_decisions(spark, d), NAMES, "event_id")


@_query("test_summary", f"select count(*) filter (rule_idx is null) as kept, round(100.0 * count(*) filter (rule_idx is null) / count(*), 1) as kept_percent, count(*) filter (rule_idx is not null) as dropped, round(100.0 * count(*) filter (rule_idx is not null) / count(*), 1) as dropped_percent from {DECIDED}")
def test_summary(spark, d):
    return summary(_decisions(spark, d))


@_query("envelope_roundtrip", "select user_id % 16 as object, '{\"Records\":[' || string_agg('{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}', ',' order by event_id) || ']}' as body from events where event_type <> 'error' group by 1")
def envelope_roundtrip(spark, d):
    """Survivors of a rule, put together again by object in their order."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 16).cast("long").alias("object"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("raw"))
    kept = decided(e, rules_of(("r0", "{field: type, equals: error}"))).filter("rule_idx is null")
    return kept.groupBy("object").agg(envelope_text(F.col("event_id"), F.col("raw")).alias("body"))


def _bodies(spark, d, *, keep: str | None = None) -> DataFrame:
    """(object, content): an envelope for each object, whole or damaged in a way that depends on its number."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 16).cast("long").alias("object"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("raw"))
    texts = e.groupBy("object").agg(envelope_text(F.col("event_id"), F.col("raw")).alias("body"))

    @F.pandas_udf("binary")
    def content(number: pd.Series, body: pd.Series) -> pd.Series:
        def one(n: int, text: str) -> bytes:
            b = text.encode()
            packed = gzip.compress(b, 1, mtime=0)
            half = len(b) // 2
            return {
                1: gzip.compress(b[:half], 1, mtime=0) + gzip.compress(b[half:] + b" \n", 1, mtime=0), 2: packed[:-4], 3: packed + packed, 4: b, 5: gzip.compress(b"[" + b + b"]"), 6: gzip.compress(b'{"a":1,' + b[1:] + b"x"), 7: gzip.compress(b[:-1] + b',"Records":[]}'),
            }.get(n, packed)

        return pd.Series([one(n, t) for n, t in zip(number, body, strict=True)])

    return texts.select("object", content("object", "body").alias("content"), F.lit("buffer").alias("mode"), *([keep] if keep else []))


@_query("envelope_statuses", "select distinct user_id % 16 as object, case user_id % 16 when 2 then 'gzip_error' when 3 then 'json_error' when 4 then 'gzip_error' when 5 then 'unrecognized' when 6 then 'json_error' when 7 then 'unrecognized' else 'ok' end as status from events")
def envelope_statuses(spark, d):
    return records_of(_bodies(spark, d), content="content").select("object", "status").distinct()


@_query("envelope_filter", "select user_id % 16 as object, count(*) as records_in, count(*) filter (event_type <> 'error') as records_kept, count(*) filter (event_type = 'error') as records_dropped, cast(0 as bigint) as parse_errors from events where user_id % 16 not between 2 and 7 group by 1")
def envelope_filter(spark, d):
    """From compressed envelopes to the tallies of those that can be read."""
    r = records_of(_bodies(spark, d), content="content").filter("pos is not null")
    return tally(decided(r, rules_of(("r0", "{field: type, equals: error}")), parse_ok=F.col("parse_ok")), "object")


@_query("envelope_verbatim", "select user_id % 16 as object, row_number() over (partition by user_id % 16 order by event_id) - 1 as pos, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' as raw from events where user_id % 16 not between 2 and 7")
def envelope_verbatim(spark, d):
    return records_of(_bodies(spark, d), content="content").filter("pos is not null").select("object", F.col("pos").cast("long").alias("pos"), "raw")


def _results(spark, d, **behavior) -> DataFrame:
    """What a run says of the envelopes of ``_bodies``, as a dry run: they are opened, decided and counted by object."""
    bodies = _bodies(spark, d).withColumn("ack_id", F.concat(F.lit("m"), "object")).withColumn("path", F.lit("/in")).withColumn("target", F.lit("/out"))
    decisions = decided(records_of(bodies, content="content"), ERRORS, parse_ok=F.col("parse_ok"))
    return write_objects(decisions, ["object", "ack_id"], "path", "target", dry_run=True, **behavior)


ERRORS = rules_of(("r0", "{field: type, equals: error}"))
#: Of an object whose envelope can be read, and of the others.
OUTCOME = "case when o in (2, 3, 4, 6) then 'failed' when o in (5, 7) then {} when count(*) filter (event_type <> 'error') > 0 then 'written' else 'nothing_kept' end"
OBJECTS = "(select user_id % 16 as o, event_type from events) e"
READ = "o not between 2 and 7"


@_query("commit_gate", f"select o as object, {OUTCOME.format(repr('copied'))} as outcome, count(*) filter ({READ}) as records_in, count(*) filter ({READ} and event_type <> 'error') as records_kept, count(*) filter ({READ} and event_type = 'error') as records_dropped, cast(0 as bigint) as parse_errors, o in (5, 7) as unrecognized from {OBJECTS} group by o")
def commit_gate(spark, d):
    """Counts by object: those of objects that can't be read stay out."""
    return _results(spark, d).select("object", "outcome", "records_in", "records_kept", "records_dropped", "parse_errors", "unrecognized")


@_query("object_rule_drops", f"select o as object, cast(0 as bigint) as rule, count(*) as drops from {OBJECTS} where {READ} and event_type = 'error' group by o")
def object_rule_drops(spark, d):
    return _results(spark, d).select("object", F.explode("drops").alias("rule", "drops")).select("object", F.col("rule").cast("long").alias("rule"), "drops")


@_query("unrecognized_policy", f"select policy, o as object, {OUTCOME.format('min(done)')} as outcome from {OBJECTS}, (values ('copy', 'copied'), ('skip', 'skipped_unrecognized'), ('error', 'failed')) p(policy, done) group by policy, o")
def unrecognized_policy(spark, d):
    one = [_results(spark, d, on_unrecognized=p).select(F.lit(p).alias("policy"), "object", "outcome") for p in ("copy", "skip", "error")]
    return one[0].union(one[1]).union(one[2])


@_query("missing_object", "select policy, outcome, s_suppkey as object, error from supplier, (values ('skip', 'skipped_missing', ''), ('error', 'failed', 'no such object')) p(policy, outcome, error)")
def missing_object(spark, d):
    """Names that lead nowhere, fetched and reported by either policy."""
    named = table(spark, d, "supplier").select(F.col("s_suppkey").alias("object"), F.concat(F.lit("/no/such/folder/"), F.col("s_name")).alias("path"), F.lit("/out").alias("target"), F.lit("buffer").alias("mode"))
    decisions = decided(records_of(named), ERRORS, parse_ok=F.col("parse_ok"))
    one = [write_objects(decisions, ["object"], "path", "target", dry_run=True, on_missing=p).select(F.lit(p).alias("policy"), "outcome", "object", F.coalesce("error", F.lit("")).alias("error")) for p in ("skip", "error")]
    return one[0].union(one[1])


@_query("oversize_retry", f"select o as object, case when size > 2000 and o % 2 = 0 then 'stream' else 'buffer' end as mode, 'ok' as retried, case when size > 2000 and o % 2 = 1 then 'too_large' else 'ok' end as refused from (select o, sum(length(r) + 1) + 13 as size from (select user_id % 16 as o, '{{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}}' as r from events) e where {READ} group by o) s")
def oversize_retry(spark, d):
    """Buffered objects over the cap: read as a stream, or refused. Even ones are known to be large before."""
    p = Processing(stream_threshold_bytes=2000, max_object_bytes=2000)
    size = F.length(F.col("body"))
    bodies = _bodies(spark, d, keep="body").filter("object not between 2 and 7").withColumn("mode", ops.mode(F.when(F.col("object") % 2 == 0, size), p)).drop("body").persist()
    retried, refused = (records_of(bodies, cap=p.max_object_bytes, retry=r, content="content").select("object", "mode", "status").distinct() for r in (True, False))
    return retried.withColumnRenamed("status", "retried").join(refused.withColumnRenamed("status", "refused"), ["object", "mode"])


@_query("mode_select", "select doc_id, case when n_chars > 2000 then 'stream' else 'buffer' end as mode, 'buffer' as explicit from documents")
def mode_select(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", ops.mode(n, Processing(stream_threshold_bytes=2000)).alias("mode"), ops.mode(n, Processing(mode="buffer")).alias("explicit"))


@_query("partial_batch_failures", f"select distinct 'm' || o as ack_id from {OBJECTS} where o in (2, 3, 4, 6) union select 'm' || event_id from events where event_id % 7 = 0")
def partial_batch_failures(spark, d):
    """Messages of failed objects, and messages whose body is no notification."""
    return failed_ids(_results(spark, d).filter("outcome = 'failed'"), _queue(spark, d, "auto").filter("failed"))


@_query("snapshot", f"select count(*) filter ({READ}) as records_in, count(*) filter ({READ} and event_type <> 'error') as records_kept, count(*) filter ({READ} and event_type = 'error') as records_dropped, count(distinct o) filter (o not in (2, 3, 4, 6)) as objects_processed, count(distinct o) filter (o in (2, 3, 4, 6)) as objects_failed, count(distinct o) filter (o in (5, 7)) as unrecognized_objects, count(*) filter ({READ} and event_type = 'error') as dropped_by_r0 from {OBJECTS}")
def snapshot(spark, d):
    """The counters that a run of the engine publishes."""
    counts, drops = dict.fromkeys(COUNTERS, 0), {}
    counted(_results(spark, d), ERRORS, counts, drops)
    names = ("records_in", "records_kept", "records_dropped", "objects_processed", "objects_failed", "unrecognized_objects")
    return spark.createDataFrame([(*(counts[n] for n in names), drops.get("r0", 0))], ", ".join(f"{n} long" for n in (*names, "dropped_by_r0")))


INDEX_RULES = (
    ("exact", "{field: eventSource, equals: svc1.example.com}, {field: eventName, any_of: [click, view]}"),
    ("source", "{field: eventSource, regex: '^svc(0|1)\\.example\\.com$'}"),
    ("name", "{field: eventName, regex: '^purchase$'}"),
    ("open", "{field: eventSource, regex: 'svc.*'}"),
    ("negated", "{field: eventName, equals: click, negate: true}"),
)


@_query("index_candidates", "select s as source, n as name, unnest(list_filter([0, 1, 2, 3, 4], lambda i: (i <> 0 or (s = 'svc1.example.com' and n in ('click', 'view'))) and (i <> 1 or s in ('svc0.example.com', 'svc1.example.com')) and (i <> 2 or n = 'purchase'))) as rule_idx from (select distinct 'svc' || (user_id % 5) || '.example.com' as s, event_type as n from events) t")
def index_candidates(spark, d):
    rules = rules_of(*INDEX_RULES)
    pairs = table(spark, d, "events").select(F.expr(FIELDS["source"]).alias("source"), F.col("event_type").alias("name")).distinct()

    @F.pandas_udf("array<int>")
    def candidates(source: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([rules.candidates(s, n) for s, n in zip(source, name, strict=True)])

    return pairs.select("source", "name", F.explode(candidates("source", "name")).alias("rule_idx"))


EMF = """
with c as (select count(*) as n, count(*) filter (rule_idx is null) as kept, count(*) filter (rule_idx is not null) as dropped from {0}),
r as (select 'r' || rule_idx as rule, count(*) as drops from {0} where rule_idx is not null group by 1),
h as (select '{{"_aws":{{"Timestamp":0,"CloudWatchMetrics":[{{"Namespace":"sievelog","Dimensions":' as head),
u as (select ['RecordsIn', 'RecordsKept', 'RecordsDropped', 'ParseErrors', 'BytesIn', 'BytesOut', 'ObjectsProcessed', 'ObjectsSkipped', 'ObjectsFailed', 'ObjectsExcludedByKey', 'UnrecognizedObjects', 'DecodeErrors', 'ItemsWithoutObjects', 'ConfigLoadErrors', 'ColdStart'] as names)
select 0 as no, head || '[[]],"Metrics":[' || array_to_string(list_transform(names, lambda x: '{{"Name":"' || x || '","Unit":"' || case when x like 'Bytes%' then 'Bytes' else 'Count' end || '"}}'), ',') || ']}}]}},'
    || array_to_string(list_transform(names, lambda x: '"' || x || '":' || case x when 'RecordsIn' then n when 'RecordsKept' then kept when 'RecordsDropped' then dropped when 'ColdStart' then 1 else 0 end), ',') || '}}' as line
from c, h, u
union all select row_number() over (order by rule), head || '[["Rule"]],"Metrics":[{{"Name":"RuleDrops","Unit":"Count"}}]}}]}},"Rule":"' || rule || '","RuleDrops":' || drops || '}}' from r, h
"""


@_query("emf_lines", EMF.format(DECIDED))
def emf_lines(spark, d):
    """The lines that a run publishes: one of all counters, one of each rule."""
    x = _decisions(spark, d)
    counts = tally(x.withColumn("all", F.lit(0)), "all").first().asDict()
    drops = {r["rule"]: r["drops"] for r in rule_drops(x, NAMES).collect()}  # one for each rule at most
    return spark.createDataFrame(list(enumerate(metric_lines(counts, drops, "sievelog", 0, True))), "no long, line string")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
