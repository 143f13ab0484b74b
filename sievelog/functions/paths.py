"""Field paths: keys, fixed subscripts and ``[*]``, as columns over a JSON record."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Any element of an array.
ANY = "*"
_SEGMENT = re.compile(r"([^.\[]+)((?:\[(?:\d+|\*)\])*)", re.S)


class PathError(ValueError):
    pass


@dataclass(frozen=True)
class Path:
    """Steps: a text is a key, a number an index, ANY any element."""

    text: str
    steps: tuple[tuple[str, str | int], ...]

    @property
    def wild(self) -> bool:
        return any(kind == "any" for kind, _ in self.steps)

    @property
    def keys(self) -> tuple[str, ...] | None:
        """The keys, if there is nothing else."""
        return tuple(str(v) for _, v in self.steps) if all(kind == "key" for kind, _ in self.steps) else None


def parse_path(text: str) -> Path:
    """``key([N]|[*])*`` joined by dots; raises PathError for anything else."""
    steps: list[tuple[str, str | int]] = []
    for segment in text.split("."):
        m = _SEGMENT.fullmatch(segment)
        if not m:
            raise PathError(f"not a field path: {text!r}")
        steps.append(("key", m[1]))
        for s in re.findall(r"\[(.*?)\]", m[2]):
            steps.append(("any", ANY) if s == ANY else ("index", int(s)))
    return Path(text, tuple(steps))


def literal_path(text: str) -> Path:
    """Dotted keys without subscripts: never fails."""
    return Path(text, tuple(("key", k) for k in text.split(".")))


def _variant_path(steps) -> str:
    """The bracket form, with a quote that the key doesn't have."""
    out = "$"
    for kind, v in steps:
        out += f"[{v}]" if kind == "index" else f"['{v}']" if "'" not in str(v) else f'["{v}"]'
    return out


def _quotable(steps) -> bool:
    return not any(kind == "key" and ("'" in str(v) and '"' in str(v) or "\\" in str(v) or "]" in str(v)) for kind, v in steps)


def number_text(text: Column) -> Column:
    """A number as the reference format has it: shortest digits, plain between 1e-5 and 1e16, else ``1.5e-7``."""
    mantissa, exponent = F.regexp_extract(text, r"^(-?[0-9.]+)E(-?[0-9]+)$", 1), F.regexp_extract(text, r"^(-?[0-9.]+)E(-?[0-9]+)$", 2).try_cast("int")
    plain = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    short = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), exponent.cast("string"))
    return F.when(exponent.isNull(), text).when(exponent.between(-5, 15), plain).otherwise(short)


def scalar(variant: Column, steps) -> Column:
    """Text of the string, boolean or number at ``steps`` (keys and indices); null for anything else."""
    where = _variant_path(steps)
    kind = F.schema_of_variant(F.try_variant_get(variant, where, "variant"))
    text = F.try_variant_get(variant, where, "string")
    is_text = kind == "STRING"
    number = kind.rlike("^(DOUBLE|FLOAT)")
    plain = kind.rlike("^(BIGINT|BOOLEAN)")
    # decimals come without the fraction of whole numbers
    decimal = kind.startswith("DECIMAL")
    as_double = number_text(F.try_variant_get(variant, where, "double").cast("string"))
    return F.when(is_text | plain, text).when(number | decimal, as_double)


def resolved(variant: Column, path: Path, test) -> Column:
    """``test`` of the scalar at ``path``, existentially over every ``[*]``; false where there is none."""
    at = next((i for i, (kind, _) in enumerate(path.steps) if kind == "any"), None)
    if at is None:
        if not path.steps:
            return F.coalesce(test(scalar_of(variant)), F.lit(False))
        return F.coalesce(test(scalar(variant, path.steps)), F.lit(False))
    items = F.try_variant_get(variant, _variant_path(path.steps[:at]), "array<variant>")
    rest = Path(path.text, path.steps[at + 1 :])
    return F.coalesce(F.exists(items, lambda x: resolved(x, rest, test)), F.lit(False))


def scalar_of(variant: Column) -> Column:
    """Text of a variant that is itself a scalar."""
    return scalar(variant, ())


def slot_schema(paths: list[Path]) -> str | None:
    """A from_json schema with string leaves for all key paths; None if one is a leaf and a prefix of another."""
    tree: dict = {}
    for p in paths:
        node = tree
        for k in p.keys[:-1]:
            node = node.setdefault(k, {})
            if node is None:
                return None
        if node.get(p.keys[-1], None) is not None:
            return None
        node[p.keys[-1]] = None

    def build(node: dict) -> str:
        return ", ".join(f"`{k.replace('`', '``')}`: " + ("string" if v is None else f"struct<{build(v)}>") for k, v in node.items())

    return f"struct<{build(tree)}>" if tree else None


def fast_scalar(parsed: Column, raw: Column, path: Path) -> Column:
    """The slot of a from_json struct. Only where its text could also come from an object, an array or a number with an
    exponent is the record parsed once more, as a variant, to tell."""
    slot = parsed
    for k in path.keys:
        slot = slot.getField(k)
    doubtful = slot.rlike(r"^[\[{]|^-?[0-9][0-9.]*E-?[0-9]+$")
    return F.when(doubtful, scalar(F.try_parse_json(raw), path.steps)).otherwise(slot)


def get(value, steps) -> list[str]:
    """All scalar texts at ``steps`` of a parsed record: the plain Python meaning of a path, for tests."""
    if not steps:
        if isinstance(value, bool):
            return ["true" if value else "false"]
        if isinstance(value, str):
            return [value]
        if isinstance(value, int):
            return [str(value) if -(2**63) <= value < 2**64 else float_text(float(value))]
        return [float_text(value)] if isinstance(value, float) else []
    (kind, v), rest = steps[0], steps[1:]
    if kind == "key":
        return get(value[v], rest) if isinstance(value, dict) and v in value else []
    if not isinstance(value, list):
        return []
    if kind == "index":
        return get(value[v], rest) if v < len(value) else []
    return [t for x in value for t in get(x, rest)]


def float_text(x: float) -> str:
    digits, _, exponent = f"{x!r}".partition("e")
    if not exponent and (x == 0 or 1e-5 <= abs(x) < 1e16):
        return digits
    if exponent and -5 <= int(exponent) <= 15:
        return f"{x:.{max(1, len(digits.replace('-', '').replace('.', '')) - 1 - int(exponent))}f}"
    if not exponent:
        digits, _, exponent = f"{x:.17e}".partition("e")
        digits = repr(float(digits))
    return f"{digits.removesuffix('.0')}e{int(exponent)}"


def quote(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)
