import os

import duckdb
import pytest

import corpus_pipeline
from sievelog.llm import chat_format, repetition
from sievelog.llm import queries as q

SCHEMA = "conv_id long, turn long, role string, text string, call_id string, tool string, arguments string, json string"
TOOLS = {"add": {"a": ("integer", True), "b": ("number", False), "why": ("string", False)}, "stop": {}}


def test_calls(spark):
    rows = [
        (1, 0, "system", "be brief", None, None, None), (1, 1, "user", "1+2", None, None, None),
        (1, 2, "assistant", None, "c1", "add", '{"why" : "q\\"x", "a": 1}'), (1, 3, "assistant", "", "c2", "add", '{"a":"1"}'),
        (1, 4, "tool", "two", "c2", None, None), (1, 5, "tool", "one", "c1", None, None), (1, 5, "tool", "one", "c1", None, None),
        (1, 6, "tool", "lost", "c9", None, None), (1, 7, "assistant", "x", "c3", "stop", "{}"), (1, 8, "assistant", "x", "c4", "stop", '{"z":1}'), (1, 9, "assistant", "x", "c5", "what", "{}"),
        (1, 10, "assistant", "x", "c6", "add", "[1"), (1, 11, "assistant", "x", "c7", "add", None), (2, 1, "tool", "early", "c1", None, None), (2, 2, "assistant", "late", "c1", "add", '{"a":2,"b":2.5}'),
        (None, 1, "user", "no place", None, None, None), (3, None, "tool", "no turn", "c1", None, None), (4, 500, "user", "far", None, None, None), (4, 1, "user", "near", None, None, None),
    ]
    got = chat_format.format_chat(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA), TOOLS).collect()
    assert len(got) == len(rows) - 1
    by = {(r["conv_id"], r["turn"], r["call_id"]): r for r in got}
    order = [(r["turn"], r["call_id"]) for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["position"])]
    assert order == [(0, None), (1, None), (2, "c1"), (5, "c1"), (3, "c2"), (4, "c2"), (6, "c9"), (7, "c3"), (8, "c4"), (9, "c5"), (10, "c6"), (11, "c7")]
    assert by[2, 2, "c1"]["position"] == 0 and by[2, 1, "c1"]["position"] == 1
    assert by[4, 500, None]["position"] == 1 and by[None, 1, None]["position"] is None and by[3, None, "c1"]["position"] is None and by[3, None, "c1"]["linked"] is False
    assert by[1, 5, "c1"]["copies"] == 2 and by[1, 5, "c1"]["linked"] and not by[1, 6, "c9"]["linked"] and by[1, 2, "c1"]["linked"] and not by[1, 7, "c3"]["linked"]
    assert {k[2]: r["valid"] for k, r in by.items() if k[0] == 1 and r["kind"] == "call"} == {"c1": True, "c2": False, "c3": True, "c4": False, "c5": False, "c6": False, "c7": False}
    assert by[1, 2, "c1"]["json"] == '{"arguments":{"a":1,"why":"q\\"x"},"content":null,"conv_id":1,"id":"c1","role":"assistant","tool":"add","turn":2,"valid":true}'
    assert by[1, 3, "c2"]["json"] == '{"arguments":"{\\"a\\":\\"1\\"}","content":"","conv_id":1,"id":"c2","role":"assistant","tool":"add","turn":3,"valid":false}'
    assert by[1, 5, "c1"]["json"] == '{"content":"one","conv_id":1,"id":"c1","linked":true,"role":"tool","turn":5}'
    assert by[1, 0, None]["json"] == '{"content":"be brief","conv_id":1,"role":"system","turn":0}' and by[None, 1, None]["json"] == '{"content":"no place","conv_id":null,"role":"user","turn":1}'
    assert by[1, 7, "c3"]["json"].startswith('{"arguments":{},')
    assert chat_format.format_chat(spark.createDataFrame([], SCHEMA), TOOLS).collect() == []


def test_calls_run_no_python(spark):
    plan = chat_format.format_chat(spark.createDataFrame([], SCHEMA), TOOLS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_conversations_against_sql(spark):
    d, con = "/root/testdata/sf0.001", duckdb.connect()
    con.sql(f"create view conversations as from '{d}/conversations.parquet'")
    frame, got = q.op3_chat_format(spark, d), con.sql(q.oracle_sql()["op3_chat_format"])
    at = [got.columns.index(c) for c in frame.columns]
    assert sorted((tuple(r) for r in frame.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_stages_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer
    import public_tokenizers

    from .test_duplicates import groups
    from .test_tokens import check_packing

    d = "/root/testdata/sf0.001"
    first = docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {None: {r["doc_id"]: r for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert docs.columns == first.columns
            seen[name] = {r["doc_id"]: r for r in docs.collect()}
    scores = {r["doc_id"]: r["predicted"] for r in q.op5_quality_trees(spark, d).collect()}
    assert seen["quality_classifier"] == {i: r for i, r in seen[None].items() if scores[i] == 1}
    kept = {r["doc_id"] for r in repetition.judge_documents(spark.read.parquet(str(tmp_path / "quality_classifier"))).filter("kept").collect()}
    assert seen["quality_rules"] == {i: r for i, r in seen["quality_classifier"].items() if i in kept}
    linked = groups([(i, r["text"]) for i, r in seen["quality_rules"].items()])
    assert seen["near_duplicates"] == {i: r for i, r in seen["quality_rules"].items() if linked[i][1] == i}
    assert set(seen["substring_dedup"]) <= set(seen["near_duplicates"]) and all(r["n_chars"] == len(r["text"]) for i, r in seen["substring_dedup"].items() if r["text"] != seen[None][i]["text"])
    check_packing(docs.collect(), {i: r["text"] for i, r in seen["substring_dedup"].items()}, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 1024)
    whole = corpus_pipeline.run(spark, d)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "length", "ids_crc32").collect()))
