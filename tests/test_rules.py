import json
import random

import pytest

from sievelog.functions.paths import PathError, parse_path
from sievelog.functions.regexes import PatternError, checked, literals
from sievelog.functions.strict_json import GzipError, JsonError, gunzip, parses, split_envelope
from sievelog.plans.compiler import decided, evaluate
from sievelog.plans.rules import ConfigError, parse_rules, validation_report

OPERATORS = r"""
version: 2.0.0
meta: {owner: tests, created_at: 2024-01-01}
rules:
  - name: equals
    matches: [{field: eventName, equals: Decrypt}, {field: eventSource, equals: kms.example.com}]
  - name: any of
    matches: [{field: eventName, any_of: [GetObject, HeadObject]}]
  - name: search
    matches: [{field: userAgent, regex: "agent-[0-9]+"}]
  - name: anchored
    matches: [{field: eventName, regex: "^Describe.*s$"}]
  - name: number
    matches: [{field: data.size, equals: "42"}]
  - name: float
    matches: [{field: data.ratio, any_of: ["1.0", "1.5e-7", "-0.0", "0.00001", "10000000.0", "1e16"]}]
  - name: boolean
    matches: [{field: readOnly, equals: "true"}, {field: kind, absent: true}]
  - name: nested
    matches: [{field: user.session.issuer.name, regex: "^role/(a|b)$"}]
  - name: index
    matches: [{field: "resources[1].ARN", regex: "^arn:one"}]
  - name: any element
    matches: [{field: "resources[*].ARN", equals: "arn:two"}]
  - name: inner any
    matches: [{field: "groups[*].members[*]", equals: "x"}]
  - name: no element
    matches: [{field: "tags[*]", equals: "keep", negate: true}, {field: kind, equals: tagged}]
  - name: missing is true when negated
    matches: [{field: errorCode, regex: "Denied", negate: true}, {field: kind, equals: errors}]
  - name: present
    matches: [{field: marker, absent: false}]
  - name: no marker
    matches: [{field: other.marker, absent: true, negate: true}]
  - name: looks like json
    matches: [{field: blob, regex: '^\{"a'}]
  - name: unicode
    matches: [{field: note, regex: '(?i)^été\d$'}]
"""

SHAPES = [
    {"eventName": "Decrypt", "eventSource": "kms.example.com"}, {"eventName": "Decrypt"}, {"eventName": "decrypt", "eventSource": "kms.example.com"}, {"eventName": "HeadObject"},
    {"eventName": ["HeadObject"]}, {"eventName": {"a": "HeadObject"}}, {"eventName": None}, {"userAgent": "my agent-12 x"}, {"userAgent": "agent-"}, {"eventName": "DescribeThings"},
    {"eventName": "DescribeThings\n"}, {"data": {"size": 42}}, {"data": {"size": "42"}}, {"data": {"size": 42.0}}, {"data": "size"}, {"data": [{"size": 42}]},
    {"readOnly": True}, {"readOnly": "true", "kind": "x"}, {"readOnly": False}, {"user": {"session": {"issuer": {"name": "role/b"}}}}, {"user": {"session": {"issuer": {"name": "role/c"}}}},
    {"resources": [{"ARN": "arn:two"}]}, {"resources": [{}, {"ARN": "arn:one:x"}]}, {"resources": [{"ARN": "arn:one"}]}, {"resources": {"ARN": "arn:two"}}, {"resources": []},
    {"groups": [{"members": ["a"]}, {"members": ["b", "x"]}]}, {"groups": [{"members": "x"}]}, {"kind": "tagged", "tags": ["a", "b"]}, {"kind": "tagged", "tags": ["a", "keep"]}, {"kind": "tagged"},
    {"kind": "errors"}, {"kind": "errors", "errorCode": "AccessDenied"}, {"kind": "errors", "errorCode": None}, {"kind": "errors", "errorCode": {"x": "Denied"}}, {"marker": ""}, {"marker": None}, {"marker": 0}, {"marker": {}},
    {"other": {"marker": 1}}, {"other": {"marker": [1]}}, {"blob": '{"a":1}'}, {"blob": {"a": 1}}, {"blob": "[x"}, {"note": "ÉTÉ٣"}, {"note": "été"}, {}, [1], "text", 5, None,
]
RAW = ['{"data":{"ratio":%s}}' % x for x in ("1.0", "1", "1.5e-7", "-0.0", "1e-5", "1e7", "1E16", "0.00001", '"1.5e-7"', "1.50")] + [
    '{"eventName":"GetObject","eventName":"x"}', '{"eventName":"x","eventName":"GetObject"}', '{"user":{"session":{"issuer":{"name":"role/a"}}},"user":{}}', '{"marker":1} x', "{'marker':1}", '{"marker":1,"n":1e400}', '{"marker":"\\ud800"}', '{"marker":NaN}',
]


def test_expressions_agree_with_python(spark):
    rules = parse_rules(OPERATORS)
    texts = [json.dumps(s, ensure_ascii=False) for s in SHAPES] + RAW
    rnd = random.Random(5)
    fields = ["eventName", "eventSource", "userAgent", "readOnly", "kind", "errorCode", "marker", "resources", "tags", "data", "blob"]
    values = ["Decrypt", "kms.example.com", "agent-1", True, False, None, 42, 1.0, "tagged", "errors", "AccessDenied", [{"ARN": "arn:two"}], ["keep"], {"size": 42}, {"ratio": 1.5e-7}, '{"a":2}']
    texts += [json.dumps({f: rnd.choice(values) for f in rnd.sample(fields, rnd.randint(0, 5))}) for _ in range(400)]
    frame = spark.createDataFrame([(i, t, parses(t)) for i, t in enumerate(texts)], "i int, raw string, ok boolean")
    got = {r["i"]: r["rule_idx"] for r in decided(frame, rules, parse_ok=frame["ok"]).collect()}
    wrong = [(t, evaluate(t, rules), got[i]) for i, t in enumerate(texts) if evaluate(t, rules) != got[i]]
    assert not wrong
    assert {evaluate(t, rules) for t in texts} == {None, *range(len(rules.rules))}  # every rule fires


def test_version_one_paths_are_literal(spark):
    rules = parse_rules('version: 1.2.3\nrules: [{name: a, matches: [{field_name: "resources[0]", regex: "^x$"}]}, {name: b, matches: [{field_name: "u..v", regex: "y"}]}]')
    texts = ['{"resources[0]":"x"}', '{"resources":["x"]}', '{"u":{"":{"v":"y"}}}', "{}"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    got = {r["i"]: r["rule_idx"] for r in decided(frame, rules).collect()}
    assert [got[i] for i in range(4)] == [evaluate(t, rules) for t in texts] == [0, None, 1, None]


def test_no_rules_keep_everything(spark):
    rules = parse_rules("version: 2.0.0")
    assert [r["rule_idx"] for r in decided(spark.createDataFrame([('{"a":1}',)], "raw string"), rules).collect()] == [None]


def _mangled():
    """Paths of the grammar with one thing wrong: a step without a name, or a subscript that isn't a number or a star."""
    whole = "userIdentity.sessionContext[3].tags[*].value"
    steps = whole.split(".")
    out = {".".join([*steps[:i], "", *steps[i:]]) for i in range(len(steps) + 1)}
    out |= {whole.replace("[3]", f"[{x}]") for x in ("", "three", "+3", "-3", "3.5", "**", "3*", " 3")}
    out |= {whole.replace("[3]", x) for x in ("[3", "[3]tail", "[3]4", "[3][", "[*]tail", "[3]tail]")}
    return sorted(out | {""})


@pytest.mark.parametrize("path", _mangled())
def test_paths_that_are_refused(path):
    with pytest.raises(PathError):
        parse_path(path)


@pytest.mark.parametrize(
    "document",
    [
        "version: 3.0.0", "version: 1", "version: 1.0", "rules: []", "version: 1.0.0\nextra: 1", "version: 1.0.0\nrules: [{name: a, matches: [{field_names: x, regex: y}]}]",
        "version: 1.0.0\nrules: [{name: a, matches: [{field_name: x, regexp: y}]}]", "version: 1.0.0\nrules: [{name: a, matches: [{field_name: x, regex: '('}]}]", "version: 1.0.0\nrules: [{name: a, matches: []}]",
        "version: 1.0.0\nrules: [{name: '', matches: [{field_name: x, regex: y}]}]", "version: 1.0.0\nrules: [{name: a, matches: [{field_name: x, regex: y}]}, {name: a, matches: [{field_name: x, regex: y}]}]",
        "version: 2.0.0\nrules: [{name: a, matches: [{field: x}]}]", "version: 2.0.0\nrules: [{name: a, matches: [{field: x, regex: a, equals: b}]}]", "version: 2.0.0\nrules: [{name: a, matches: [{field: x, any_of: []}]}]",
        "version: 2.0.0\nrules: [{name: a, matches: [{field_name: x, regex: a}]}]", "version: 2.0.0\nrules: [{name: a, matches: [{field: 'x[y]', equals: a}]}]", "version: 2.0.0\nrules: [{name: a, matches: [{field: x, regex: '(a{900}){900}'}]}]",
    ],
)
def test_documents_that_are_refused(document):
    with pytest.raises(ConfigError):
        parse_rules(document)


@pytest.mark.parametrize("pattern", ["(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", "(?>a)", r"(a)\1", r"\k<n>", "a++", "a*+", "a{2", "[a", "a)", "*a", r"\y", r"\Z"])
def test_patterns_that_are_refused(pattern):
    with pytest.raises(PatternError):
        checked(pattern)


@pytest.mark.parametrize("pattern", ["", "^a$", "(?i)a|b", "(?P<n>a)", "[[:alpha:]_]+", r"\p{Greek}\pL", "a{2,}", "[^]a]", r"[\]\-a]", "(?s:.)", r"\x{41}"])
def test_patterns_that_are_allowed(pattern):
    checked(pattern)


def test_literals_are_all_that_a_pattern_matches():
    """Whatever is listed for a pattern has to be every text over a small alphabet that it matches; else nothing is listed."""
    import itertools
    import re

    texts = ["".join(t) for n in range(5) for t in itertools.product("uvz.", repeat=n)]
    atoms = ["u", "v", r"\.", "(u|v)", "(uv|z|)", "z?", "u*", "[uv]", "."]
    listed = 0
    for n in (1, 2, 3):
        for parts in itertools.product(atoms, repeat=n):
            for head, tail in (("^", "$"), ("", "$"), ("^", "")):
                pattern = head + "".join(parts) + tail
                found = literals(pattern)
                if found is None:
                    continue
                listed += 1
                assert sorted(set(found)) == sorted(t for t in texts if re.search(pattern, t)), pattern
    assert listed > 20  # plain texts, and alternatives of plain texts


def test_literals_of_common_rules():
    assert literals(r"^logs\.example\.net$") == ["logs.example.net"] and sorted(literals("^(Get|Put)Item$") or []) == ["GetItem", "PutItem"]
    assert literals("(?i)^GetItem$") is None and literals(r"^Get\w+$") is None


def test_validation_and_candidates():
    rules = parse_rules(r"""
version: 2.0.0
rules:
  - {name: a, matches: [{field: eventSource, equals: s1}, {field: eventName, any_of: [n1, n2]}]}
  - {name: b, matches: [{field: eventSource, regex: '^s(1|2)$'}]}
  - {name: c, matches: [{field: eventSource, regex: 's.*'}]}
  - {name: d, matches: [{field: eventName, equals: n1, negate: true}]}
""")
    assert rules.candidates("s1", "n1") == [0, 1, 2, 3] and rules.candidates("s2", "n1") == [1, 2, 3] and rules.candidates(None, "n9") == [2, 3]
    lines, ok = validation_report(rules, 49)
    assert lines[0] == "4 rules, 5 patterns compiled" and rules.unindexed_percent() == 50 and not ok and len(lines) == 4
    assert validation_report(rules, 50)[1]


def test_envelopes():
    import gzip

    assert split_envelope(b' {"x":1, "Records" : [ {"a":  1.50} ,"t", 4 ] } \n') == ['{"a":  1.50}', '"t"', "4"]
    assert split_envelope(b'{"Records":[]}') == []
    for body in (b'{"a":1}', b'{"Records":{}}', b'{"Records":"x"}', b'{"Records":[],"Records":[]}', b"[[{}]]", b"42", b"null"):
        assert split_envelope(body) is None
    for body in (b"", b"{", b'{"Records":[1,]}', b'{"Records":[1]', b'{"Records":[1]}{"Records":[]}', b'{"Records":[NaN]}', b'{"Records":["\xff"]}', b'{"Records":["\n"]}', b'{"Records":[1]} x'):
        with pytest.raises(JsonError):
            split_envelope(body)
    two = gzip.compress(b'{"Records":') + gzip.compress(b"[]}")
    assert gunzip(two) == b'{"Records":[]}'
    for bad in (two[:-4], b"plain", b"", two + b"x"):
        with pytest.raises(GzipError):
            gunzip(bad)
    assert not parses('"\\ud800"') and parses('"\\ud83d\\ude00"') and not parses("1e400") and parses("[" * 127 + "]" * 127) and not parses("[" * 128 + "]" * 128)
