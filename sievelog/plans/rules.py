"""Rules documents: exclusion rules of conjunctive conditions, in two versions of syntax with one meaning."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from ..functions.paths import Path, PathError, literal_path, parse_path
from ..functions.regexes import PatternError, checked, literals

#: The record fields that candidate rules are found by.
INDEXED = ("eventSource", "eventName")
_SEMVER = re.compile(r"(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Match:
    """``kind``: regex, equals, any_of or absent; ``value``: text, texts or a boolean."""

    path: Path
    kind: str
    value: str | tuple[str, ...] | bool
    negate: bool = False

    def described(self) -> str:
        if self.kind == "any_of":
            return f"any_of [{', '.join(f'"{v}"' for v in self.value)}]"
        return f"absent {str(self.value).lower()}" if self.kind == "absent" else f'{self.kind} "{self.value}"'

    def literals(self) -> list[str] | None:
        """The texts that make it true, if they can be listed."""
        return {"equals": lambda: [self.value], "any_of": lambda: list(self.value), "regex": lambda: literals(self.value)}.get(self.kind, lambda: None)()


@dataclass(frozen=True)
class Rule:
    name: str
    matches: tuple[Match, ...]

    def ordered(self) -> list[Match]:
        """The conditions as they are evaluated: patterns that match nearly anything last."""
        return sorted(self.matches, key=lambda m: m.kind == "regex" and m.value in (".*", "^.*"))

    def index_literals(self, field: str) -> list[str] | None:
        """Texts of ``field`` without which the rule can't match; None if they can't be listed."""
        own = next((m for m in self.matches if not m.negate and m.path.steps == (("key", field),)), None)
        return own.literals() if own else None

    def key_description(self) -> str | None:
        parts = []
        for field in INDEXED:
            if own := next((m for m in self.matches if not m.negate and m.path.text == field), None):
                parts.append(f"{field} {own.described()}")
        return ", ".join(parts) or None


@dataclass(frozen=True)
class RuleSet:
    version: str
    rules: tuple[Rule, ...]
    meta: dict | None = None

    @property
    def paths(self) -> list[Path]:
        """The different paths, in order of use."""
        return list(dict.fromkeys(m.path for r in self.rules for m in r.matches))

    def unindexed(self) -> list[Rule]:
        """Rules that are candidates for every record."""
        return [r for r in self.rules if all(r.index_literals(f) is None for f in INDEXED)]

    def unindexed_percent(self) -> int:
        return math.ceil(100 * len(self.unindexed()) / len(self.rules)) if self.rules else 0

    def candidates(self, source: str | None, name: str | None) -> list[int]:
        """Numbers of the rules that a record with these fields could match."""
        out = []
        for i, r in enumerate(self.rules):
            a, b = (r.index_literals(f) for f in INDEXED)
            if (a is None or source in a) and (b is None or name in b):
                out.append(i)
        return out


def _only(value: dict, allowed: dict[str, type | tuple], required: set[str], what: str) -> None:
    if not isinstance(value, dict):
        raise ConfigError(f"{what}: expected a mapping")
    if unknown := set(value) - set(allowed):
        raise ConfigError(f"{what}: unknown key {sorted(map(str, unknown))[0]!r}")
    if missing := required - set(value):
        raise ConfigError(f"{what}: missing key {sorted(missing)[0]!r}")
    for k, v in value.items():
        if v is not None and not isinstance(v, allowed[k]) or v is None and k in required:
            raise ConfigError(f"{what}: {k} has the wrong type")


def _match(raw: dict, rule: str, major: int) -> Match:
    what = f"rule {rule!r}"
    if major == 1:
        _only(raw, {"field_name": str, "regex": str}, {"field_name", "regex"}, what)
        return Match(literal_path(raw["field_name"]), "regex", raw["regex"])
    _only(raw, {"field": str, "regex": str, "equals": str, "any_of": list, "absent": bool, "negate": bool}, {"field"}, what)
    kinds = [k for k in ("regex", "equals", "any_of", "absent") if raw.get(k) is not None]
    if len(kinds) != 1:
        raise ConfigError(f"{what}: field {raw['field']!r}: expected exactly one of regex/equals/any_of/absent, found {len(kinds)}")
    value = raw[kinds[0]]
    if kinds[0] == "any_of":
        if not value or not all(isinstance(v, str) for v in value):
            raise ConfigError(f"{what}: field {raw['field']!r}: any_of must be a list of texts that is not empty")
        value = tuple(value)
    try:
        path = parse_path(raw["field"])
    except PathError as e:
        raise ConfigError(f"{what}: invalid field path {raw['field']!r}: {e}") from e
    return Match(path, kinds[0], value, bool(raw.get("negate")))


def parse_rules(document: bytes | str) -> RuleSet:
    """Reads and checks a rules document; raises ConfigError for anything that could make a rule mean something else."""
    import yaml

    try:
        doc = yaml.safe_load(document)
    except yaml.YAMLError as e:
        raise ConfigError(str(e)) from e
    _only(doc, {"version": str, "meta": dict, "rules": list}, {"version"}, "rules document")
    m = _SEMVER.fullmatch(doc["version"])
    if not m:
        raise ConfigError(f"invalid version {doc['version']!r}")
    if int(m[1]) not in (1, 2):
        raise ConfigError(f"unsupported rules version {doc['version']}: the major version must be 1 or 2")
    rules, names = [], set()
    for raw in doc.get("rules") or []:
        _only(raw, {"name": str, "matches": list}, {"name", "matches"}, "rule")
        if not raw["name"] or raw["name"] in names:
            raise ConfigError(f"rule names must be different and not empty: {raw['name']!r}")
        names.add(raw["name"])
        if not raw["matches"]:
            raise ConfigError(f"rule {raw['name']!r} has no matches and would drop every record")
        rules.append(Rule(raw["name"], tuple(_match(x, raw["name"], int(m[1])) for x in raw["matches"])))
        for x in rules[-1].matches:
            if x.kind == "regex":
                try:
                    checked(x.value)
                except PatternError as e:
                    raise ConfigError(f"rule {raw['name']!r}: invalid regex {x.value!r}: {e}") from e
    return RuleSet(doc["version"], tuple(rules), doc.get("meta"))


def validation_report(rules: RuleSet, max_unindexed: int | None = None) -> tuple[list[str], bool]:
    """Lines about a rules document, and whether the share of unindexed rules is allowed."""
    many = sum(len(r.matches) for r in rules.rules)
    lines = [f"{len(rules.rules)} rules, {many} patterns compiled"]
    for r in rules.unindexed():
        lines.append(f"warning: rule \"{r.name}\" is evaluated against every record ({r.key_description() or 'no eventSource or eventName condition'})")
    percent = rules.unindexed_percent()
    if ok := max_unindexed is None or percent <= max_unindexed:
        return lines, ok
    return [*lines, f"{percent}% of the rules are unindexed, over the limit of {max_unindexed}%"], False
