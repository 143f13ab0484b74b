"""Where rules come from, and how long they are kept."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from .rules import ConfigError, RuleSet, parse_rules


class RulesSource(Protocol):
    def version(self) -> str | None:
        """What changes when the document does; None if that can't be told."""

    def read(self) -> tuple[bytes, str | None]:
        """The document and its version."""


@dataclass
class FileSource:
    path: str

    def version(self) -> str:
        return str(int(os.stat(self.path).st_mtime))

    def read(self) -> tuple[bytes, str]:
        version = self.version()
        with open(self.path, "rb") as f:
            return f.read(), version


def parse_uri(uri: str) -> tuple[str, ...]:
    """("file", path), ("s3", bucket, key) or ("ssm", path); raises ConfigError."""
    scheme, found, rest = uri.partition("://")
    if found and scheme == "s3":
        bucket, slash, key = rest.partition("/")
        if not (bucket and slash and key):
            raise ConfigError(f"not a bucket and key: {uri}")
        return ("s3", bucket, key)
    if found and scheme in ("file", "ssm") and rest:
        return (scheme, rest)
    raise ConfigError(f"not a rules address: {uri}")


def source_for(uri: str, others: dict[str, Callable[..., RulesSource]] | None = None) -> RulesSource:
    """A source for an address, or for a plain local path. ``others``: by scheme, what reads object or parameter stores."""
    if "://" not in uri:
        return FileSource(uri)
    scheme, *rest = parse_uri(uri)
    if scheme == "file":
        return FileSource(rest[0])
    if not others or scheme not in others:
        raise ConfigError(f"no reader for {scheme}:// here")
    return others[scheme](*rest)


@dataclass
class ConfigStore:
    """Keeps the last good rules: asks for the version again after ``ttl`` seconds, reads again if it changed, and goes on
    with what it has when that fails (the failure is counted, and the next call asks again)."""

    source: RulesSource
    ttl: float = 300
    clock: Callable[[], float] = time.monotonic
    failures: int = 0
    _rules: RuleSet | None = field(default=None, repr=False)
    _version: str | None = None
    _asked: float | None = None

    def get(self) -> RuleSet | None:
        now = self.clock()
        if self._rules is not None and self._asked is not None and now - self._asked < self.ttl:
            return self._rules
        try:
            version = self.source.version()
            if self._rules is None or version is None or version != self._version:
                document, version = self.source.read()
                self._rules, self._version = parse_rules(document), version
            self._asked = now
        except (OSError, ConfigError):
            self.failures += 1
        return self._rules

    def taken_failures(self) -> int:
        """Failures since the last call."""
        n, self.failures = self.failures, 0
        return n
