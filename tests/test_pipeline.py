import gzip
import json
import os

import pytest

from sievelog.cli import main
from sievelog.operators.counting import metric_lines
from sievelog.pipeline import AuditPipeline, RunError, filter_folder
from sievelog.plans.config_store import ConfigStore, FileSource, parse_uri, source_for
from sievelog.plans.rules import ConfigError, parse_rules
from sievelog.plans.settings import Settings, from_parts

RULES = "version: 2.0.0\nrules:\n  - {name: drop, matches: [{field: eventName, equals: Decrypt}]}\n  - {name: late, matches: [{field: eventName, regex: '^(Decrypt|List)'}]}\n"
DECRYPT, LOGIN = '{"eventName":"Decrypt"}', '{"eventName": "ConsoleLogin",  "n":1.50, "s":"\\u00e9\\/é"}'


def body(*records: str, head: str = "", tail: str = "") -> bytes:
    return gzip.compress(('{%s"Records":[%s]}%s' % (head, ",".join(records), tail)).encode())


CASES = {
    "two": (body(LOGIN, LOGIN), "written", [LOGIN, LOGIN], 0),
    "middle": (body(DECRYPT, " " + LOGIN + "\n", DECRYPT), "written", [LOGIN], 2),
    "none-kept": (body(DECRYPT, DECRYPT), "nothing_kept", None, 2),
    "empty": (body(), "nothing_kept", None, 0),
    "siblings": (body(LOGIN, head='"x":{"Records":1},'), "written", [LOGIN], 0),
    "space-after": (body(LOGIN, tail="\n  \n"), "written", [LOGIN], 0),
    "scalars": (body("42", '"text"', DECRYPT), "written", ["42", '"text"'], 1),
    "surrogate": (body(LOGIN, '{"eventName":"\\ud800"}', LOGIN), "written", [LOGIN, '{"eventName":"\\ud800"}', LOGIN], 0),
    "members": (gzip.compress(b'{"Records":[' + LOGIN.encode()) + gzip.compress(b"]}"), "written", [LOGIN], 0),
    "twice": (gzip.compress(b'{"Records":[],"Records":[]}'), "copied", "same", 0),
    "other": (gzip.compress(b'{"something":"else"}'), "copied", "same", 0),
    "list": (gzip.compress(b"[1]"), "copied", "same", 0),
    "second-envelope": (body(DECRYPT, LOGIN) + body(LOGIN), "failed", None, 0),
    "text-after": (body(DECRYPT, tail=" x"), "failed", None, 0),
    "cut": (body(LOGIN)[:-4], "failed", None, 0),
    "plain": (b'{"Records":[]}', "failed", None, 0),
    "not-json": (gzip.compress(b'{"Records":[1'), "failed", None, 0),
}


def make(tmp_path, **behavior):
    (tmp_path / "rules.yaml").write_text(RULES)
    lines = []
    settings = from_parts(json.dumps({"destination": {"bucket": "out"}, "behavior": behavior, "processing": {"max_object_bytes": 10_000_000}}), {})
    return AuditPipeline(settings, ConfigStore(FileSource(str(tmp_path / "rules.yaml"))), str(tmp_path), lines.append), lines


def put(tmp_path, name, data, bucket="in"):
    p = tmp_path / bucket / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data)


def event(*keys, bucket="in"):
    return json.dumps({"Records": [{"eventName": "ObjectCreated:Put", "s3": {"bucket": {"name": bucket}, "object": {"key": k, "size": 10}}} for k in keys]})


def queue(*bodies):
    return json.dumps({"Records": [{"messageId": f"m{i}", "body": b} for i, b in enumerate(bodies)]})


def payloads(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "payload string")


@pytest.mark.parametrize("mode", ["buffer", "stream", "auto"])
def test_all_kinds_of_objects(spark, tmp_path, mode):
    pipeline, lines = make(tmp_path)
    pipeline.settings.processing.mode = mode
    for name, (data, *_) in CASES.items():
        put(tmp_path, f"{name}.json.gz", data)
    out = pipeline.handle(spark, payloads(spark, queue(*(event(f"{n}.json.gz") for n in CASES))))
    got = {r["key"].removesuffix(".json.gz"): r for r in out.results.collect()}
    for name, (data, outcome, kept, dropped) in CASES.items():
        r, at = got[name], tmp_path / "out" / f"{name}.json.gz"
        assert r["outcome"] == outcome, name
        assert at.exists() == (kept is not None), name
        if kept is not None:
            assert at.read_bytes() == data if kept == "same" else gzip.decompress(at.read_bytes()) == ('{"Records":[' + ",".join(kept) + "]}").encode()
        assert r["records_dropped"] == dropped and r["records_in"] == r["records_kept"] + r["records_dropped"], name
    c = out.snapshot
    assert c["records_in"] == c["records_kept"] + c["records_dropped"] and sum(out.rule_drops.values()) == c["records_dropped"]
    assert out.rule_drops == {"drop": 5} and c["parse_errors"] == 1 and c["objects_failed"] == 5 and c["unrecognized_objects"] == 3
    assert c["objects_processed"] == len(CASES) - 5
    assert out.failed == sorted(f"m{i}" for i, (n, x) in enumerate(CASES.items()) if x[1] == "failed")
    assert out.response["batchItemFailures"][0] == {"itemIdentifier": out.failed[0]}
    assert len(lines) == 2 and json.loads(lines[0])["RecordsDropped"] == 5 and json.loads(lines[1])["Rule"] == "drop"
    assert not [f for f in os.listdir(tmp_path / "out") if "partial" in f]


def test_policies(spark, tmp_path):
    pipeline, _ = make(tmp_path, on_missing_object="skip", on_unrecognized_object="error", dry_run=True)
    put(tmp_path, "a.json.gz", body(LOGIN))
    put(tmp_path, "b.json.gz", gzip.compress(b"{}"))
    out = pipeline.handle(spark, payloads(spark, queue(event("a.json.gz", "gone.json.gz"), event("b.json.gz", "b.txt"), "garbage", json.dumps({"Event": "s3:TestEvent"}))))
    got = {r["key"]: r["outcome"] for r in out.results.collect()}
    assert got == {"a.json.gz": "written", "gone.json.gz": "skipped_missing", "b.json.gz": "failed"}
    assert out.failed == ["m1", "m2"] and not (tmp_path / "out").exists()
    c = out.snapshot
    assert (c["bytes_out"], c["objects_skipped"], c["objects_excluded_by_key"], c["decode_errors"], c["items_without_objects"], c["unrecognized_objects"]) == (0, 1, 1, 1, 1, 1)


def test_self_trigger_stops_before_anything_is_written(spark, tmp_path):
    pipeline, lines = make(tmp_path)
    put(tmp_path, "a.json.gz", body(LOGIN))
    with pytest.raises(RunError):
        pipeline.handle(spark, payloads(spark, queue(event("a.json.gz"), event("x.json.gz", bucket="out"))))
    assert not (tmp_path / "out").exists() and json.loads(lines[0])["ObjectsFailed"] == 1


def test_without_rules(spark, tmp_path):
    pipeline, _ = make(tmp_path)
    data = body(DECRYPT)
    put(tmp_path, "a.json.gz", data)
    (tmp_path / "rules.yaml").write_text("version: 9.0.0")
    out = pipeline.handle(spark, payloads(spark, event("a.json.gz")), "s3")
    assert (tmp_path / "out/a.json.gz").read_bytes() == data and out.snapshot["config_load_errors"] == 1
    assert pipeline.store.failures == 0 and [r["outcome"] for r in out.results.collect()] == ["copied"]
    pipeline.settings.behavior.on_config_error = "closed"
    with pytest.raises(ConfigError):
        pipeline.handle(spark, payloads(spark, event("a.json.gz")), "s3")


def test_failure_without_acknowledgement_fails_the_run(spark, tmp_path):
    pipeline, _ = make(tmp_path)
    put(tmp_path, "a.json.gz", b"x")
    with pytest.raises(RunError):
        pipeline.handle(spark, payloads(spark, event("a.json.gz")), "s3")


def test_config_store(tmp_path):
    now, reads = [0.0], []

    class Source:
        document, label = RULES.encode(), "1"

        def version(self):
            return self.label

        def read(self):
            reads.append(self.label)
            return self.document, self.label

    source = Source()
    store = ConfigStore(source, 300, lambda: now[0])
    first = store.get()
    now[0] = 299
    source.label = "2"
    assert store.get() is first and reads == ["1"]
    now[0] = 301
    assert store.get() is not first and reads == ["1", "2"]
    now[0], source.label, source.document = 700, "3", b"broken: ["
    kept = store.get()
    assert kept is not None and store.failures == 1 and store.get() is kept and store.taken_failures() == 2
    assert parse_uri("s3://b/k/x") == ("s3", "b", "k/x") and parse_uri("ssm://p") == ("ssm", "p")
    for bad in ("s3://b", "http://x", "x"):
        with pytest.raises(ConfigError):
            parse_uri(bad)
    assert isinstance(source_for("/a/b.yaml"), FileSource)


def test_settings():
    s = from_parts("destination: {bucket: b}\nprocessing: {mode: stream}", {"CT_GZIP_LEVEL": "9", "CT_DRY_RUN": "true", "CT_PROCESSING_MODE": "buffer"})
    assert (s.processing.gzip_level, s.behavior.dry_run, s.processing.mode, s.rules.ttl_seconds) == (9, True, "buffer", 300)
    for document, env in (
        (None, {}), ("destination: {bucket: b}\nversion: 2", {}), ("destination: {bucket: b}\nextra: 1", {}), ("destination: {bucket: b, x: 1}", {}), ("destination: {bucket: b}", {"CT_DRY_RUN": "True"}), ("destination: {bucket: b}", {"CT_GZIP_LEVEL": "10"}),
        ("destination: {bucket: b}", {"CT_SOURCE_INCLUDE_KEY_REGEX": "("}), ("destination: {bucket: b}", {"CT_MAX_OBJECT_BYTES": "1"}), ("destination: {bucket: b}", {"CT_MULTIPART_PART_BYTES": "1"}), ("destination: {bucket: b}", {"CT_METRICS": "x"}),
    ):
        with pytest.raises(ConfigError):
            from_parts(document, env)


def test_metric_lines():
    a, b, c = metric_lines({"records_in": 3}, {"z": 1, "a": 2, "none": 0}, "ns", 5, True)
    assert json.loads(a)["RecordsIn"] == 3 and json.loads(a)["ColdStart"] == 1 and json.loads(b)["Rule"] == "a" and json.loads(c)["RuleDrops"] == 1


def test_command_line(spark, tmp_path):
    (tmp_path / "rules.yaml").write_text(RULES)
    put(tmp_path, "x/a.json.gz", body(DECRYPT, LOGIN))
    put(tmp_path, "x/skip.txt", b"")
    put(tmp_path, "bad.json.gz", b"x")
    said = []
    rules = str(tmp_path / "rules.yaml")
    assert main(["validate", rules], said.append) == 0 and said[0] == "2 rules, 2 patterns compiled"
    assert main(["validate", rules, "--max-unindexed", "10"], said.append) == 1
    said.clear()
    assert main(["test", rules, str(tmp_path / "in/x/a.json.gz")], said.append) == 0
    assert said == ['DROP record 1 (rule: "drop")', "KEEP record 2", "1 kept (50.0%), 1 dropped (50.0%)"]
    said.clear()
    assert main(["filter", str(tmp_path / "in"), str(tmp_path / "done"), "--rules", rules], said.append) == 1
    assert said[0].startswith("failed: bad.json.gz") and said[1] == "written: x/a.json.gz"
    assert json.loads(gzip.decompress((tmp_path / "done/x/a.json.gz").read_bytes()))["Records"][0]["eventName"] == "ConsoleLogin"
    assert main(["validate", str(tmp_path / "none")], said.append) == 1


def test_streams(spark, tmp_path):
    from sievelog.sources.envelopes import stream_of
    from sievelog.streaming.filtering import filter_files, filter_payloads

    pipeline, _ = make(tmp_path)
    put(tmp_path, "a.json.gz", body(DECRYPT, LOGIN))
    put(tmp_path, "b.json.gz", b"x")
    filter_files(stream_of(spark, str(tmp_path / "in")), pipeline, "in", str(tmp_path / "check"), str(tmp_path / "failures"), once=True).awaitTermination(120)
    assert gzip.decompress((tmp_path / "out/a.json.gz").read_bytes()) == ('{"Records":[' + LOGIN + "]}").encode()
    assert [r["key"] for r in spark.read.parquet(str(tmp_path / "failures")).collect()] == ["b.json.gz"]
    (tmp_path / "out/a.json.gz").unlink()
    (tmp_path / "events").mkdir()
    (tmp_path / "events/1.txt").write_text(queue(event("a.json.gz")) + "\n")
    lines = spark.readStream.schema("payload string").text(str(tmp_path / "events"))
    filter_payloads(lines, pipeline, "sqs", str(tmp_path / "check2"), once=True).awaitTermination(120)
    assert (tmp_path / "out/a.json.gz").exists()


RULE = "version: 2.0.0\nrules: [{name: drop, matches: [{field: a, equals: x}]}]"
BODY = '{"Records":[{"a":"x"},{"a":"y","b":"1"},{"a":"z"}]}'


@pytest.fixture
def logs(tmp_path, monkeypatch):
    import gzip

    (tmp_path / "logs" / "in [1]").mkdir(parents=True)
    for name in ("a.json.gz", "in [1]/b.json.gz", "notes.txt"):
        (tmp_path / "logs" / name).write_bytes(gzip.compress(BODY.encode()))
    (tmp_path / "link").symlink_to(tmp_path / "logs")
    monkeypatch.chdir(tmp_path)
    return tmp_path


def _sieved(path):
    import gzip

    return gzip.decompress(path.read_bytes()).decode() == '{"Records":[{"a":"y","b":"1"},{"a":"z"}]}'


@pytest.mark.parametrize("source", ["logs", "logs/", "./logs", "link", "logs/../logs", "{abs}/logs", "file:{abs}/logs"])
def test_folders_by_any_name(spark, logs, source):
    out = filter_folder(spark, source.format(abs=logs), "out", parse_rules(RULE), Settings())
    assert sorted((r["rel"], r["outcome"]) for r in out.results.collect()) == [("a.json.gz", "written"), ("in [1]/b.json.gz", "written")]
    assert _sieved(logs / "out" / "a.json.gz") and _sieved(logs / "out" / "in [1]" / "b.json.gz")
    s = out.snapshot
    assert (s["records_in"], s["records_kept"], s["objects_processed"], s["objects_failed"], s["objects_excluded_by_key"]) == (6, 4, 2, 0, 1)
    assert out.rule_drops == {"drop": 2}


@pytest.mark.parametrize(("source", "target"), [("logs", "logs"), ("logs", "link"), ("link", "logs"), ("logs", "out/../logs"), ("{abs}/logs", "./logs/"), ("logs/a.json.gz", "link/a.json.gz"), ("logs/a.json.gz", "logs/a.json.gz"), ("link/a.json.gz", "logs/../logs/a.json.gz")])
def test_no_object_is_written_over_itself(spark, logs, source, target):
    (logs / "out").mkdir()
    before = {p: p.read_bytes() for p in (logs / "logs").rglob("*") if p.is_file()}
    out = filter_folder(spark, source.format(abs=logs), target, parse_rules(RULE), Settings())
    assert {(r["outcome"], r["error"]) for r in out.results.collect()} == {("failed", "would overwrite its source")}
    assert {p: p.read_bytes() for p in (logs / "logs").rglob("*") if p.is_file()} == before
    assert out.snapshot["objects_failed"] >= 1 and out.snapshot["records_in"] == 0


def test_a_single_file_goes_where_it_is_told(spark, logs):
    """Whatever its name: the key filter is for folders."""
    out = filter_folder(spark, "logs/notes.txt", "picked/one", parse_rules(RULE), Settings())
    assert [(r["rel"], r["outcome"]) for r in out.results.collect()] == [("logs/notes.txt", "written")] and _sieved(logs / "picked" / "one")
    with pytest.raises(FileNotFoundError):
        filter_folder(spark, "nothing/here", "out", parse_rules(RULE), Settings())


def test_objects_of_many_batches_are_written_without_a_shuffle(spark, tmp_path):
    import gzip
    import json

    from sievelog.operators.sink import write_objects
    from sievelog.plans.compiler import decided
    from sievelog.sources.envelopes import records_of
    from pyspark.sql import functions as F

    for k, n in enumerate((0, 1, 2000, 2001, 7000)):
        (tmp_path / f"{k}.gz").write_bytes(gzip.compress(json.dumps({"Records": [{"a": "x" if i % 3 else "y", "i": i} for i in range(n)]}).encode()))
    objects = spark.createDataFrame([(k, f"{tmp_path}/{k}.gz", f"{tmp_path}/out/{k}.gz", "buffer") for k in range(5)], "object int, path string, target string, mode string").coalesce(1)
    frame = write_objects(decided(records_of(objects), parse_rules(RULE), parse_ok=F.col("parse_ok")), ["object"], "path", "target")
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    got = {r["object"]: (r["outcome"], r["records_in"], r["records_kept"]) for r in frame.collect()}
    for k, n in enumerate((0, 1, 2000, 2001, 7000)):
        kept = [i for i in range(n) if i % 3 == 0]
        assert got[k] == ("written" if kept else "nothing_kept", n, len(kept))
        if kept:
            assert [r["i"] for r in json.loads(gzip.decompress((tmp_path / "out" / f"{k}.gz").read_bytes()))["Records"]] == kept


def test_a_filter_on_the_decision_parses_once(spark):
    from sievelog.plans.compiler import decided

    rules = parse_rules("version: 2.0.0\nrules: [" + ", ".join(f"{{name: r{i}, matches: [{{field: a.b{i}, equals: x}}, {{field: c, any_of: [u, v]}}]}}" for i in range(9)) + "]")
    frame = decided(spark.range(9).selectExpr("cast(id as string) as raw"), rules).filter("rule_idx is not null")
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
