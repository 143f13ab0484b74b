"""Storage notifications (direct, via topic, via queue, via event bus) as object references.

Every decoder takes a frame with a ``payload`` column and returns, per item, (payload columns..., item, ack_id, objects,
decode_error): ``objects`` is an array of struct<bucket, key, size>. ``exploded`` makes a row for each object of them. All is
done in column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import once

OBJECTS = "array<struct<bucket:string,key:string,size:bigint>>"


class DecodeError(ValueError):
    pass


def _text(v: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))


def decoded_key(key: Column) -> Column:
    """Form decoding: plus is a space, escapes that aren't ones stay; null if the bytes aren't UTF-8."""
    literal = F.regexp_replace(F.regexp_replace(key, r"\+", " "), "%(?![0-9A-Fa-f]{2})", "%25")
    out = F.try_url_decode(F.regexp_replace(literal, " ", "%20"))
    marks = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    return F.when(marks(out, "�") <= marks(literal, "�|(?i)%EF%BF%BD"), out)


def _result(error: Column, objects: Column) -> Column:
    return F.struct(F.when(error.isNull(), objects).otherwise(F.array().cast(OBJECTS)).alias("objects"), error.alias("decode_error"))


def s3_event(v: Column) -> Column:
    """struct<objects, decode_error> of a direct notification, parsed: objects that were created; a test event has none."""
    test = F.coalesce(_text(v, "$.Event") == "s3:TestEvent", F.lit(False))
    records = F.try_variant_get(v, "$.Records", "array<variant>")
    created = F.filter(records, lambda r: F.coalesce(F.regexp_replace(_text(r, "$.eventName"), "^s3:", "").startswith("ObjectCreated:"), F.lit(True)))
    objects = F.transform(created, lambda r: F.struct(_text(r, "$.s3.bucket.name").alias("bucket"), decoded_key(_text(r, "$.s3.object.key")).alias("key"), F.try_variant_get(r, "$.s3.object.size", "bigint").alias("size")))
    shape = F.forall(records, lambda r: _text(r, "$.s3.bucket.name").isNotNull() & _text(r, "$.s3.object.key").isNotNull())
    error = (
        F.when(v.isNull(), F.lit("not a JSON document"))
        .when(test, F.lit(None))
        .when(records.isNull(), F.lit("no Records"))
        .when(~shape, F.lit("a record without bucket or key"))
        .when(F.exists(objects, lambda o: o["key"].isNull()), F.lit("a key that is not UTF-8"))
        .otherwise(F.lit(None))
    )
    return _result(error.cast("string"), F.when(test, F.array().cast(OBJECTS)).otherwise(objects.cast(OBJECTS)))


def _items(frame: DataFrame, found: Column, ack: Column) -> DataFrame:
    return frame.select("*", ack.cast("string").alias("ack_id"), once(found).alias("__found")).select("*", "__found.objects", "__found.decode_error").drop("__found")


def decode_s3(payloads: DataFrame) -> DataFrame:
    """One item per payload that has objects or an error."""
    parsed = payloads.withColumn("item", F.lit(0)).withColumn("__v", _parsed(F.col("payload")))
    return _items(parsed, s3_event(F.col("__v")), F.lit(None)).drop("__v").filter("decode_error is not null or size(objects) > 0")


def _parsed(text: Column) -> Column:
    """A parsed text as a column that is computed once, however often it is used above."""
    return once(F.try_parse_json(text))


def _outer(payloads: DataFrame) -> DataFrame:
    """A row for each of the payload's records, none for a payload without."""
    v = F.col("__v")
    parsed = payloads.withColumn("__v", _parsed(F.col("payload")))
    records = F.when(v.isNull(), F.array(F.lit(None).cast("variant"))).otherwise(F.try_variant_get(v, "$.Records", "array<variant>"))
    return parsed.select(*payloads.columns, F.posexplode(records).alias("item", "__record"))


def decode_sns(payloads: DataFrame) -> DataFrame:
    """One item per record. A bad message fails its whole payload: each of its items has the error then."""
    v = F.col("__v")
    none = F.array(F.lit(None).cast("variant"))
    # all messages of a payload are decoded in its row, before they become rows of their own, so each sees the others' errors
    records = F.when(v.isNull(), none).otherwise(F.try_variant_get(v, "$.Records", "array<variant>"))
    texts = payloads.withColumn("__v", _parsed(F.col("payload"))).withColumn("__records", records)
    parsed = texts.withColumn("__messages", once(F.transform("__records", lambda r: F.struct(_text(r, "$.Sns.Message").isNull().alias("none"), F.try_parse_json(_text(r, "$.Sns.Message")).alias("v")))))
    found = parsed.withColumn("__found", once(F.transform("__messages", lambda m: F.when(m["none"], _result(F.lit("no message"), F.array().cast(OBJECTS))).otherwise(s3_event(m["v"])))))
    error = F.aggregate("__found", F.lit(None).cast("string"), lambda a, x: F.coalesce(a, x["decode_error"]))
    rows = found.withColumn("__error", error).select(*payloads.columns, "__error", F.posexplode("__found").alias("item", "__one"))
    return rows.select(*payloads.columns, "item", F.lit(None).cast("string").alias("ack_id"), F.when(F.col("__error").isNull(), F.col("__one.objects")).otherwise(F.array().cast(OBJECTS)).alias("objects"), F.col("__error").alias("decode_error"))


def decode_sqs(payloads: DataFrame, body_format: str = "auto") -> DataFrame:
    """One item per message, acknowledged by its messageId; a bad body is its own item's error only."""
    record, v, inner = F.col("__record"), F.col("__body"), F.col("__inner")
    body = _text(record, "$.body")
    rows = _outer(payloads).withColumn("__body", _parsed(body))
    rows = rows.withColumn("__inner", _parsed(_text(v, "$.Message")))
    wrapped = F.coalesce(_text(v, "$.Type") == "Notification", F.lit(False))
    missing = _result(F.lit("no message in the notification"), F.array().cast(OBJECTS))
    unwrapped = F.when(_text(v, "$.Message").isNull(), missing).otherwise(s3_event(inner))
    if body_format == "auto":
        found = F.when(wrapped, unwrapped).otherwise(s3_event(v))
    elif body_format == "s3":
        found = F.when(wrapped, _result(F.lit("a topic envelope, where a direct event is expected"), F.array().cast(OBJECTS))).otherwise(s3_event(v))
    else:
        found = unwrapped
    found = F.when(body.isNull(), _result(F.lit("no body"), F.array().cast(OBJECTS))).otherwise(found)
    return _items(rows, found, _text(record, "$.messageId")).drop("__record", "__body", "__inner")


def decode_eventbridge(payloads: DataFrame) -> DataFrame:
    """Only created objects of event version 1; the key is taken as it stands."""
    v = F.col("__v")
    kind, version = _text(v, "$['detail-type']"), _text(v, "$.detail['event-version']")
    bucket, key = _text(v, "$.detail.bucket.name"), _text(v, "$.detail.object.key")
    size = F.try_variant_get(v, "$.detail.object.size", "bigint")
    error = (
        F.when(v.isNull(), F.lit("not a JSON document"))
        .when(kind.isNull() | version.isNull() | bucket.isNull() | key.isNull(), F.lit("not an object event"))
        .when(kind != "Object Created", F.lit(None))
        .when(F.split(version, "\\.")[0] != "1", F.concat(F.lit("unsupported event version "), version))
        .otherwise(F.lit(None))
    )
    objects = F.when(kind == "Object Created", F.array(F.struct(bucket.alias("bucket"), key.alias("key"), size.alias("size"))).cast(OBJECTS)).otherwise(F.array().cast(OBJECTS))
    parsed = payloads.withColumn("item", F.lit(0)).withColumn("__v", _parsed(F.col("payload")))
    return _items(parsed, _result(error.cast("string"), objects), F.lit(None)).drop("__v").filter("decode_error is not null or size(objects) > 0")


DECODERS = {"s3": decode_s3, "sns": decode_sns, "sqs": decode_sqs, "eventbridge": decode_eventbridge}


def exploded(items: DataFrame) -> DataFrame:
    """A row for each object of an item, one without object for items that have none."""
    kept = [c for c in items.columns if c != "objects"]
    return items.select(*kept, F.posexplode_outer("objects").alias("place", "object")).select(*kept, "place", "object.bucket", "object.key", "object.size")
