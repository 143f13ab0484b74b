"""Settings: a YAML document, then environment variables, then checks that would otherwise fail on the first object."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, is_dataclass

from ..functions.regexes import PatternError, checked
from .rules import ConfigError

#: The least size of a part of an upload in several parts, and the highest level of gzip.
LEAST_PART, TOP_LEVEL = 5 * 1024 * 1024, 9


def _choice(*allowed: str):
    return field(default=allowed[0], metadata={"allowed": frozenset(allowed)})


@dataclass
class Source:
    include_key_regex: str = r"\.json\.gz$"
    exclude_key_regex: str = r"(/CloudTrail-Digest/|/CloudTrail-Insight/|/$)"


@dataclass
class Destination:
    bucket: str = ""
    key_prefix: str = ""


@dataclass
class Processing:
    mode: str = _choice("auto", "buffer", "stream")
    stream_threshold_bytes: int = 8_388_608
    max_object_bytes: int = 134_217_728
    multipart_part_bytes: int = 8_388_608
    gzip_level: int = 6


@dataclass
class Behavior:
    dry_run: bool = False
    on_config_error: str = _choice("open", "closed")
    on_missing_object: str = _choice("error", "skip")
    on_unrecognized_object: str = _choice("copy", "skip", "error")
    partial_batch_failures: bool = True


@dataclass
class Sqs:
    body_format: str = _choice("auto", "s3", "sns")


@dataclass
class RulesAt:
    uri: str = "file:///etc/sievelog/rules.yaml"
    ttl_seconds: int = 300


@dataclass
class Observability:
    metrics: str = _choice("emf", "none")
    namespace: str = "sievelog"
    log_level: str = "info"


@dataclass
class Settings:
    version: int = 1
    source: Source = field(default_factory=Source)
    destination: Destination = field(default_factory=Destination)
    processing: Processing = field(default_factory=Processing)
    behavior: Behavior = field(default_factory=Behavior)
    sqs: Sqs = field(default_factory=Sqs)
    rules: RulesAt = field(default_factory=RulesAt)
    observability: Observability = field(default_factory=Observability)

    def check(self) -> Settings:
        if self.version != 1:
            raise ConfigError(f"unsupported settings version {self.version}: must be 1")
        if not self.destination.bucket:
            raise ConfigError("destination.bucket is required")
        for name in ("include_key_regex", "exclude_key_regex"):
            try:
                checked(getattr(self.source, name))
            except PatternError as e:
                raise ConfigError(f"source.{name}: {e}") from e
        p = self.processing
        if p.gzip_level > TOP_LEVEL:
            raise ConfigError(f"processing.gzip_level {p.gzip_level} is out of range: at most {TOP_LEVEL}")
        if p.max_object_bytes < p.stream_threshold_bytes:
            raise ConfigError("processing.max_object_bytes is smaller than processing.stream_threshold_bytes: every object between them would fail")
        if p.multipart_part_bytes < LEAST_PART:
            raise ConfigError(f"processing.multipart_part_bytes is below {LEAST_PART}")
        return self


#: Variables that take the place of a setting (fixed names).
VARIABLES = {
    "CT_DEST_BUCKET": "destination.bucket",
    "CT_KEY_PREFIX": "destination.key_prefix",
    "CT_SOURCE_INCLUDE_KEY_REGEX": "source.include_key_regex",
    "CT_SOURCE_EXCLUDE_KEY_REGEX": "source.exclude_key_regex",
    "CT_PROCESSING_MODE": "processing.mode",
    "CT_STREAM_THRESHOLD_BYTES": "processing.stream_threshold_bytes",
    "CT_MAX_OBJECT_BYTES": "processing.max_object_bytes",
    "CT_MULTIPART_PART_BYTES": "processing.multipart_part_bytes",
    "CT_GZIP_LEVEL": "processing.gzip_level",
    "CT_DRY_RUN": "behavior.dry_run",
    "CT_ON_CONFIG_ERROR": "behavior.on_config_error",
    "CT_ON_MISSING_OBJECT": "behavior.on_missing_object",
    "CT_ON_UNRECOGNIZED_OBJECT": "behavior.on_unrecognized_object",
    "CT_PARTIAL_BATCH_FAILURES": "behavior.partial_batch_failures",
    "CT_SQS_BODY_FORMAT": "sqs.body_format",
    "CT_RULES_URI": "rules.uri",
    "CT_RULES_TTL_SECONDS": "rules.ttl_seconds",
    "CT_METRICS": "observability.metrics",
    "CT_METRICS_NAMESPACE": "observability.namespace",
    "CT_LOG_LEVEL": "observability.log_level",
}


def _put(target, name: str, value, where: str) -> None:
    own = next((f for f in fields(target) if f.name == name), None)
    if own is None:
        raise ConfigError(f"{where}: unknown key")
    now = getattr(target, name)
    kind = type(now)
    if type(value) is not kind or (kind is int and name != "version" and value < 0):
        raise ConfigError(f"{where}: {value!r} is not a valid {kind.__name__}")
    if (allowed := own.metadata.get("allowed")) and value not in allowed:
        raise ConfigError(f"{where}: {value!r} is not one of {', '.join(sorted(allowed))}")
    setattr(target, name, value)


def _fill(target, values, where: str = "") -> None:
    if not isinstance(values, dict):
        raise ConfigError(f"{where or 'settings'}: expected a mapping")
    for k, v in values.items():
        at = f"{where}.{k}".lstrip(".")
        if is_dataclass(getattr(target, str(k), None)):
            _fill(getattr(target, k), v, at)
        else:
            _put(target, k, v, at)


def from_parts(document: bytes | str | None, env: Mapping[str, str] | Callable[[str], str | None], check: bool = True) -> Settings:
    """Defaults, then the document, then the environment; unknown keys and bad values raise ConfigError."""
    import yaml

    out = Settings()
    if document is not None:
        try:
            values = yaml.safe_load(document)
        except yaml.YAMLError as e:
            raise ConfigError(str(e)) from e
        _fill(out, values if values is not None else {})
    look = env if callable(env) else env.get
    for name, at in VARIABLES.items():
        raw = look(name)
        if raw is None:
            continue
        section, key = at.split(".")
        target = getattr(out, section)
        kind = type(getattr(target, key))
        try:
            value = {"true": True, "false": False}[raw] if kind is bool else kind(raw)
        except (KeyError, ValueError) as e:
            raise ConfigError(f"invalid {name}={raw!r}") from e
        _put(target, key, value, name)
    return out.check() if check else out


def load(env: Mapping[str, str] = os.environ) -> Settings:
    """From the file that SETTINGS_URI names, if it does, and the environment."""
    document = None
    if uri := env.get("SETTINGS_URI"):
        if not uri.startswith("file://"):
            raise ConfigError(f"only file:// settings can be read here: {uri}")
        with open(uri.removeprefix("file://"), "rb") as f:
            document = f.read()
    return from_parts(document, env)
