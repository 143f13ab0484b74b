"""The registered queries of this subpackage: each applies an operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import bpe, chat_format, chunk_dedup, jaccard_join, kneser_ney, order_minhash, packing, quality_trees, repetition, token_counts

BYTE_BPE_JSON = "byte_bpe_50k.json"
BYTE_BPE_RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # texts are long: batches of ten thousand rows would take most of a small executor's memory outside the heap
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE_JSON), capacity=1024, end_id=2)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"), percent=75, words_each=5)


#: The call that a turn of a user makes, in the terms of chat formatting.
REPLY: chat_format.Schema = {"n_chars": ("integer", True), "prompt": ("string", True)}


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users as calls of ``reply``, the turns of assistants as results of the call one turn earlier."""
    c = table(spark, sf_dir, "conversations")
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    identity = F.when(user, F.concat_ws(":", "conv_id", "turn")).when(assistant, F.concat_ws(":", F.col("conv_id"), F.col("turn") - 1))
    arguments = F.when(user, F.to_json(F.struct(F.length("text").alias("n_chars"), F.col("text").alias("prompt"))))
    messages = c.select("conv_id", "turn", "role", "text", identity.alias("call_id"), F.when(user, "reply").alias("tool"))
    out = chat_format.format_chat(messages, {"reply": REPLY}, arguments)
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("linked", "valid")})


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = kneser_ney.held_out("doc_id", 10)
    model = kneser_ney.train(docs.filter(~out))
    scores = kneser_ney.score_documents(docs, model)
    return scores.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def quality_forest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_trees.Forest:
    return quality_trees.train(docs, table(spark, sf_dir, "labels"), sample=quality_trees.SAMPLE, folds=5)


def op5_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = quality_trees.score_documents(docs, quality_forest(spark, docs, sf_dir))
    return scores.select("doc_id", (quality_trees.fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chunks", "n_cut", "cut_spans")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE_JSON))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = repetition.judge_documents(table(spark, sf_dir, "documents"))
    base = [F.col("words").alias("n_words"), "word_chars", F.col("symbols").alias("n_symbols"), F.col("dup_lines").alias("n_dup_lines"), F.col("repeat_words").alias("n_repeat_words")]
    return m.select("doc_id", *base, "base_failed", "kept", *(c for c in m.columns if c.startswith("dup_")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE_RANKS))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP3_SQL = """
with m as (
    select conv_id, turn, role, text, count(*) as copies,
        case role when 'user' then conv_id || ':' || turn when 'assistant' then conv_id || ':' || (turn - 1) end as call_id,
        case role when 'user' then 'call' when 'assistant' then 'result' else 'message' end as kind
    from conversations group by all),
l as (
    select m.*, case kind
        when 'call' then exists (select 1 from conversations o where o.conv_id = m.conv_id and o.turn = m.turn + 1 and o.role = 'assistant')
        when 'result' then exists (select 1 from conversations o where o.conv_id = m.conv_id and o.turn = m.turn - 1 and o.role = 'user') end as linked,
        case when kind = 'call' then text is not null end as valid
    from m)
select conv_id, turn, role, call_id, kind, coalesce(cast(linked as varchar), '') as linked, coalesce(cast(valid as varchar), '') as valid, copies,
    row_number() over (partition by conv_id order by case when kind = 'result' and l.linked then turn - 1 else turn end, kind = 'result', turn, role, call_id, text) - 1 as position,
    case kind
        when 'call' then '{"arguments":' || case when l.valid then '{"n_chars":' || length(text) || ',"prompt":' || to_json(text) || '}' else to_json('{}') end
            || ',"content":' || coalesce(to_json(text), 'null') || ',"conv_id":' || conv_id || ',"id":' || to_json(call_id) || ',"role":' || to_json(role) || ',"tool":"reply","turn":' || turn || ',"valid":' || l.valid || '}'
        when 'result' then '{"content":' || coalesce(to_json(text), 'null') || ',"conv_id":' || conv_id || ',"id":' || to_json(call_id) || ',"linked":' || l.linked || ',"role":' || to_json(role) || ',"turn":' || turn || '}'
        else '{"content":' || coalesce(to_json(text), 'null') || ',"conv_id":' || conv_id || ',"role":' || to_json(role) || ',"turn":' || turn || '}' end as json
from l
"""


WORDS = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP2_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all({LOWER}, {WORDS}) as ws from documents),
s as (
    select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as shingle from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)
    union select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 4),
n as (select doc_id, count(*) as n from s group by 1),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
reach as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce((select min(b) from reach where reach.a = d.doc_id), d.doc_id)) as component_id
from documents d left join n using (doc_id)
"""


def _op9_sql(rules: repetition.Rules) -> str:
    sizes = [3, *(n for n, _ in rules.ngrams)]
    grams = ", ".join("case when lead(word, %d) over o is not null then " % (n - 1) + " || ' ' || ".join(["word", *(f"lead(word, {k}) over o" for k in range(1, n))]) + f" end as g{n}" for n in sizes)
    flags = ", ".join(f"g{n} is not null and count(*) over (partition by doc_id, g{n}) > 1 as f{n}" for n in sizes)
    inside = ", ".join(f"bool_or(f{n}) over (partition by doc_id order by i rows between {n - 1} preceding and current row) as c{n}" for n in sizes)
    dups = ", ".join(f"coalesce(dup_chars_{n}, 0)::bigint as dup_chars_{n}" for n, _ in rules.ngrams)
    kept = " and ".join([*(f"dup_chars_{n} <= {most}::double * word_chars" for n, most in rules.ngrams), f"dup_line_chars <= {rules.lines}::double * word_chars", f"dup_lines <= {rules.line_count}::double * lines", f"n_symbols <= {rules.symbols}::double * n_words"])
    return rf"""
with w as (select doc_id, generate_subscripts(ws, 1) as i, unnest(ws) as word from (select doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) as ws from documents)),
g as (select *, {grams} from w window o as (partition by doc_id order by i)),
f as (select *, {flags} from g),
c as (select *, {inside} from f),
t as (
    select doc_id, count(*) as n_words, sum(length(word)) as word_chars, count(*) filter (c3) as n_repeat_words, {", ".join(f"sum(length(word)) filter (c{n}) as dup_chars_{n}" for n, _ in rules.ngrams)}
    from c group by 1),
l as (select doc_id, line, row_number() over (partition by doc_id, line) as k from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents) where regexp_matches(line, {WORDS})),
m as (select doc_id, count(*) as lines, count(*) filter (k > 1) as dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) filter (k > 1) as dup_line_chars from l group by 1),
u as (
    select doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0)::bigint as word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dup_lines, 0) as n_dup_lines,
        coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(dup_lines, 0) as dup_lines, coalesce(dup_line_chars, 0)::bigint as dup_line_chars, coalesce(lines, 0) as lines, {dups}
    from documents left join t using (doc_id) left join m using (doc_id)),
v as (select *, n_words < {rules.least_words} or 100 * n_repeat_words > {rules.repeat_words} * n_words as base_failed from u)
select * exclude (lines), not base_failed and {kept} as kept from v
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": OP2_SQL, "op3_chat_format": OP3_SQL, "op9_quality_rules": _op9_sql(repetition.Rules())}
