"""Strict JSON: whether a record parses, and where the records of an envelope stand in its text."""

from __future__ import annotations

import json
import re
import zlib
from json.decoder import scanstring

#: Nesting that a record may have.
DEPTH = 127
_BLANK = re.compile(r"[ \t\n\r]*")
_LONE = re.compile(r"\\(?:u([dD][89abAB][0-9a-fA-F]{2})(\\u[dD][c-fC-F][0-9a-fA-F]{2})?|u([dD][c-fC-F][0-9a-fA-F]{2})|.)", re.S)


class JsonError(ValueError):
    pass


class GzipError(ValueError):
    pass


class TooLarge(ValueError):
    pass


def _refuse(text: str):
    raise JsonError(f"not a JSON value: {text}")


def _finite(text: str) -> float:
    x = float(text)
    if x in (float("inf"), float("-inf")):
        raise JsonError("number out of range")
    return x


_decoder = json.JSONDecoder(parse_constant=_refuse)
_record = json.JSONDecoder(parse_constant=_refuse, parse_float=_finite)


def _depth(text: str) -> int:
    most = now = 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', text, re.S):
        if m[0] in "[{":
            now += 1
            most = max(most, now)
        elif m[0] in "]}":
            now -= 1
    return most


def parse_record(text: str):
    """The value of a record; raises JsonError for what strict JSON doesn't allow, numbers out of range and lone surrogates."""
    if text.count("[") + text.count("{") > DEPTH and _depth(text) > DEPTH:
        raise JsonError("nested too deeply")
    if "\\u" in text and any(m[1] and not m[2] or m[3] for m in _LONE.finditer(text)):
        raise JsonError("lone surrogate")
    try:
        at = _BLANK.match(text).end()
        value, end = _record.raw_decode(text, at)
    except JsonError:
        raise
    except (ValueError, RecursionError) as e:
        raise JsonError(str(e)) from e
    if _BLANK.match(text, end).end() != len(text):
        raise JsonError("text after the value")
    return value


def parses(text: str) -> bool:
    try:
        parse_record(text)
    except JsonError:
        return False
    return True


def split_envelope(body: bytes) -> list[str] | None:
    """The texts of the elements of ``Records``, as they stand; None for valid JSON that has no such array, or it twice.
    Raises JsonError."""
    try:
        text = body.decode("utf-8")
        at = _BLANK.match(text).end()
        if text[at : at + 1] != "{":
            _, at = _decoder.raw_decode(text, at)
            found = None
        else:
            found, at = _members(text, at + 1)
        if _BLANK.match(text, at).end() != len(text):
            raise JsonError("text after the envelope")
        return found
    except JsonError:
        raise
    except (ValueError, RecursionError, IndexError) as e:
        raise JsonError(str(e)) from e


def _members(text: str, at: int) -> tuple[list[str] | None, int]:
    found, seen = None, 0
    at = _BLANK.match(text, at).end()
    if text[at : at + 1] == "}":
        return None, at + 1
    while True:
        if text[at : at + 1] != '"':
            raise JsonError(f"expected a key at {at}")
        key, at = scanstring(text, at + 1, True)
        at = _BLANK.match(text, at).end()
        if text[at : at + 1] != ":":
            raise JsonError(f"expected a colon at {at}")
        at = _BLANK.match(text, at + 1).end()
        if key == "Records":
            seen += 1
        if key == "Records" and text[at : at + 1] == "[":
            found, at = _elements(text, at + 1)
        else:
            _, at = _decoder.raw_decode(text, at)
        at = _BLANK.match(text, at).end()
        mark, at = text[at : at + 1], _BLANK.match(text, at + 1).end()
        if mark == "}":
            return (found if seen == 1 else None), at
        if mark != ",":
            raise JsonError(f"expected a comma at {at}")


def _elements(text: str, at: int) -> tuple[list[str], int]:
    out: list[str] = []
    at = _BLANK.match(text, at).end()
    if text[at : at + 1] == "]":
        return out, at + 1
    while True:
        _, end = _decoder.raw_decode(text, at)
        out.append(text[at:end])
        at = _BLANK.match(text, end).end()
        mark, at = text[at : at + 1], _BLANK.match(text, at + 1).end()
        if mark == "]":
            return out, at
        if mark != ",":
            raise JsonError(f"expected a comma at {at}")


def gunzip(data: bytes, most: int | None = None) -> bytes:
    """All members as one stream; raises TooLarge beyond ``most`` bytes, GzipError for anything incomplete or else."""
    parts, size, rest = [], 0, data
    while rest or not parts:
        member = zlib.decompressobj(31)
        try:
            while True:
                part = member.decompress(rest, 1 << 20)
                parts.append(part)
                size += len(part)
                if most is not None and size > most:
                    raise TooLarge(f"over {most} bytes")
                rest = member.unconsumed_tail
                if member.eof or not (rest or part):
                    break
        except zlib.error as e:
            raise GzipError(str(e)) from e
        if not member.eof:
            raise GzipError("the data ends too early")
        rest = member.unused_data
    return b"".join(parts)
