"""Chat formatting: tool calls linked to their results, put in order, validated, and written as canonical JSON.

Everything is DataFrame expressions. Calls and results meet in equi-joins on the conversation and the identifier, of which
only the distinct keys take part; the order is an expression of a message's own columns and of its call's turn, so no
conversation has to be gathered in one task for it. Positions in a conversation are counted in two steps, within spans of
turns and over the spans' totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A tool's arguments: name -> (kind, required). Kinds: string, integer, number, boolean.
Schema = dict[str, tuple[str, bool]]
_KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "boolean": ("BOOLEAN",)}
_SQL = {"string": "string", "integer": "long", "number": "double", "boolean": "boolean"}
#: Turns that are counted together.
SPAN = 64


def valid_arguments(arguments: Column, schema: Schema) -> Column:
    """Whether a JSON text is an object with the required arguments, all of the right kind, and no others."""
    v = F.try_parse_json(arguments)
    tests = [F.coalesce(F.forall(F.json_object_keys(arguments), lambda k: k.isin(*schema)), F.lit(False)) if schema else F.coalesce(F.size(F.json_object_keys(arguments)) == 0, F.lit(False))]
    for name, (kind, required) in schema.items():
        found = F.schema_of_variant(F.try_variant_get(v, f"$['{name}']", "variant"))
        right = F.lit(False)
        for k in _KINDS[kind]:
            right = right | found.startswith(k)
        tests.append(F.coalesce(right, F.lit(not required)))
    out = v.isNotNull()
    for t in tests:
        out = out & t
    return F.coalesce(out, F.lit(False))


def canonical_arguments(arguments: Column, schema: Schema) -> Column:
    """A valid JSON object again, with its keys in order and without white space."""
    return F.to_json(F.from_json(arguments, ", ".join(f"`{k}` {_SQL[schema[k][0]]}" for k in sorted(schema)) or "_ string"))


def format_chat(messages: DataFrame, tools: dict[str, Schema], arguments: Column | None = None) -> DataFrame:
    """One row per distinct message of (conv_id, turn, role, text, call_id, tool, arguments): ``tool`` set makes it a call,
    ``call_id`` without ``tool`` a result. Returns conv_id, turn, role, call_id, kind (message, call, result), linked,
    valid, position (from 0, in the conversation), copies and json.

    ``arguments``: an expression of the other six instead of a column; it is evaluated last, so that it isn't shuffled.

    A result comes right after its call, wherever it stands; else order follows the turns, calls and messages before results,
    then role, call_id, tool and a digest of the rest. If an identifier is called more than once, its first call counts;
    further results follow each other. ``linked``: a call has a result, a result has a call (null for messages). ``valid``: a
    call's arguments match the tool's schema; an unknown tool or null arguments don't (null for others). Rows that are equal
    in all seven columns are one message with ``copies``; null text is kept as JSON null. Without a conversation or turn a
    message has no links and no position. Columns besides the seven are dropped.

    Links and positions are found on rows without text; texts are shuffled once, to meet them by a digest of the row.
    """
    columns = ["conv_id", "turn", "role", "text", "call_id", "tool"] + ["arguments"] * (arguments is None)
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    whole = messages.select(*columns, F.md5(F.concat(*parts).cast("binary")).alias("row"))
    slim = ["conv_id", "turn", "role", "call_id", "tool"]
    m = whole.groupBy("row", *slim).agg(F.count(F.lit(1)).alias("copies"))
    m = m.withColumn("kind", F.when(F.col("tool").isNotNull(), "call").when(F.col("call_id").isNotNull(), "result").otherwise("message"))
    keyed = messages.select("conv_id", "turn", "call_id", F.col("tool").isNotNull().alias("is_call")).filter("conv_id is not null and turn is not null and call_id is not null")
    links = keyed.groupBy("conv_id", "call_id").agg(F.min(F.when(F.col("is_call"), F.col("turn"))).alias("call_turn"), F.max(~F.col("is_call")).alias("answered"))
    m = m.join(links, ["conv_id", "call_id"], "left")
    linked = F.when((F.col("kind") == "call") & F.col("turn").isNotNull(), F.coalesce("answered", F.lit(False))).when((F.col("kind") == "result") & F.col("turn").isNotNull(), F.col("call_turn").isNotNull())
    m = m.withColumn("linked", F.when(F.col("kind") != "message", F.coalesce(linked, F.lit(False))))
    m = m.withColumn("anchor", F.when((F.col("kind") == "result") & F.col("linked"), F.col("call_turn")).otherwise(F.col("turn"))).withColumn("depth", (F.col("kind") == "result").cast("int"))
    m = m.withColumn("span", F.floor(F.col("anchor") / SPAN)).withColumn("placed", F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    # rows without a place are dealt evenly, as nothing orders them
    deal = F.when(~F.col("placed"), F.col("row"))
    m = m.withColumn("inside", F.row_number().over(Window.partitionBy("conv_id", "span", deal).orderBy("anchor", "depth", "turn", "role", "call_id", "tool", "row")) - 1)
    totals = m.filter("placed").groupBy("conv_id", "span").agg(F.count(F.lit(1)).alias("n"))
    earlier = totals.select("conv_id", "span", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    m = m.join(earlier, ["conv_id", "span"], "left")
    m = m.select("row", *slim, "copies", "kind", "linked", F.when(F.col("placed"), F.col("earlier") + F.col("inside")).cast("long").alias("position"))
    rest = [c for c in columns if c not in slim]
    m = m.join(whole.groupBy("row").agg(*(F.first(c).alias(c) for c in rest)), "row")
    if arguments is not None:
        m = m.withColumn("arguments", arguments)

    valid, body = F.lit(False), F.col("arguments")
    for name, schema in tools.items():
        own = F.col("tool") == name
        valid = F.when(own, valid_arguments(F.col("arguments"), schema)).otherwise(valid)
    m = m.withColumn("valid", F.when(F.col("kind") == "call", valid))
    for name, schema in tools.items():
        body = F.when((F.col("tool") == name) & F.col("valid"), canonical_arguments(F.col("arguments"), schema)).otherwise(body)

    def text(c: Column) -> Column:  # a JSON string, or null
        return F.coalesce(F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null"))

    def number(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("null"))

    tail = [F.lit(',"role":'), text(F.col("role"))]
    head = [F.lit(',"conv_id":'), number("conv_id")]
    identity = [F.lit(',"id":'), text(F.col("call_id"))]
    turn = [F.lit(',"turn":'), number("turn")]
    # arguments that aren't valid stay as the text that they are
    call = F.concat(F.lit('{"arguments":'), F.when(F.col("valid"), body).otherwise(text(F.col("arguments"))), F.lit(',"content":'), text(F.col("text")), *head, *identity, *tail, F.lit(',"tool":'), text(F.col("tool")), *turn, F.lit(',"valid":'), F.col("valid").cast("string"), F.lit("}"))
    result = F.concat(F.lit('{"content":'), text(F.col("text")), *head, *identity, F.lit(',"linked":'), F.col("linked").cast("string"), *tail, *turn, F.lit("}"))
    plain = F.concat(F.lit('{"content":'), text(F.col("text")), *head, *tail, *turn, F.lit("}"))
    m = m.withColumn("json", F.when(F.col("kind") == "call", call).when(F.col("kind") == "result", result).otherwise(plain))
    return m.select("conv_id", "turn", "role", "call_id", "kind", "linked", "valid", "position", "copies", "json")
