"""Rule patterns: a linear-time dialect, translated for the JVM (rlike) and for Python (the oracle), or refused.

A pattern is searched anywhere in the text. ``$`` is the end of the text only; ``.`` stops at a line feed only; ``\\d \\w \\s``
and case folding are Unicode. What backtracking engines have besides (look-around, back references, possessive
quantifiers) is refused at load, so that no rule means something else here than where it was written.
"""

from __future__ import annotations

import re

#: Bound on the text of a pattern with its counted repetitions written out.
SIZE_LIMIT = 60_000
#: ASCII classes by their bracket names (fixed values).
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_TOKEN = re.compile(
    r"""(?P<escape>\\(?:x\{[0-9A-Fa-f]+\}|u\{[0-9A-Fa-f]+\}|U\{[0-9A-Fa-f]+\}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[pP](?:\{\^?[^}]*\}|.)|.))
    |(?P<posix>\[:\^?[a-z]+:\])|(?P<group>\((?:\?(?:P?<[A-Za-z_][A-Za-z0-9_.\[\]]*>|[a-zA-Z]*(?:-[a-zA-Z]+)?[:)]|.?.?))?)
    |(?P<count>\{\d*,?\d*\})|(?P<plain>.)""",
    re.X | re.S,
)


class PatternError(ValueError):
    pass


def _escape(text: str, in_class: bool, java: bool) -> str:
    kind = text[1]
    if kind in "pP":
        name = text[2:].strip("{}")
        negative, name = (kind == "P") != name.startswith("^"), name.lstrip("^")
        if not java:
            inner = {"L": "^\\W\\d_", "Lu": "A-Z", "Ll": "a-z", "N": "0-9", "Nd": "0-9"}.get(name, "\\w")  # near enough for a syntax check
            return inner if in_class and inner[0] != "^" else f"[{inner}]"
        if not re.fullmatch(r"[A-Z][a-z]?", name):
            name = "Is" + name.split("=")[-1]
        return f"\\{'P' if negative else 'p'}{{{name}}}"
    if m := re.fullmatch(r"\\[xuU]\{?([0-9A-Fa-f]+)\}?", text):
        point = int(m[1], 16)
        if point > 0x10FFFF or 0xD800 <= point < 0xE000:
            raise PatternError(f"no such character: {text}")
        return f"\\x{{{point:X}}}" if java else re.escape(chr(point))
    if kind == "v":
        return r"\x0B"
    if kind == "z" and not in_class:
        return r"\z" if java else r"\Z"
    if kind in "dDwWsSnrtfa" or (kind in "bBA" and not in_class):
        return text
    if kind.isalnum() or kind in "<>":
        raise PatternError(f"not an escape here: {text}")
    return text


def translated(pattern: str, java: bool = True) -> str:
    """The pattern for java.util.regex, or for Python's re. Raises PatternError."""
    out, depth, classes, flags_m, multiply, previous = [], 0, 0, [False], 1, ""
    for m in _TOKEN.finditer(pattern):
        kind, text = m.lastgroup, m[0]
        if kind == "escape":
            out.append(_escape(text, classes > 0, java))
        elif classes:
            if kind == "posix":
                name = text[2:-2].lstrip("^")
                if name not in POSIX:
                    raise PatternError(f"no such class: {text}")
                out.append((f"[^{POSIX[name]}]" if java else r"\W") if text[2] == "^" else POSIX[name])
            else:
                for c in text:
                    if previous in "-~" and c == previous and out[-1] == c:
                        raise PatternError("set operations -- and ~~ are not supported")
                    if c == "[":
                        classes += 1
                    elif c == "]" and previous not in ("[", "[^"):
                        classes -= 1
                    out.append("\\]" if c == "]" and previous in ("[", "[^") else "\\[" if c == "[" and not java else c)
                    if c == "[" and not java and classes:
                        raise PatternError("nested classes")
                    previous = "[^" if c == "^" and previous == "[" else c
                continue
        elif kind == "posix" or text == "[":
            classes, previous = 1, "["
            out.append("[")
            if kind == "posix":
                out[-1:] = ["[" + re.sub(r"([\[\]])", r"\\\1", text[1:-1]) + "]"]
                classes = 0
            continue
        elif kind == "group":
            if text.startswith("(?") and (text[2:4] in ("<=", "<!") or text[2:3] in ("=", "!", ">", "#", "(", "|", "&", "R") or text[2:4] in ("P=", "P>", "P<") and ">" not in text):
                raise PatternError(f"look-around, atomic groups and the like are not supported: {text}")
            if re.fullmatch(r"\(\?P?<.*>", text):
                out.append("(")
                depth += 1
                flags_m.append(flags_m[-1])
            elif f := re.fullmatch(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]+))?([:)])", text):
                if set(f[1] + (f[2] or "")) - set("imsU") or not (f[1] or f[2] or f[3] == ":"):
                    raise PatternError(f"flags are not supported: {text}")
                on, off = f[1].replace("U", ""), (f[2] or "").replace("U", "")  # greediness doesn't change what matches
                multi = (flags_m[-1] or "m" in on) and "m" not in off
                if f[3] == ":":
                    depth += 1
                    flags_m.append(multi)
                    out.append(f"(?{on}{'-' + off if off else ''}:")
                else:
                    flags_m[-1] = multi
                    if java:
                        out.append(f"(?{on}{'-' + off if off else ''})" if on or off else "")
                    else:
                        if off or any(out):
                            raise PatternError("flags inside a pattern")
                        out.append(f"(?{on})" if on else "")
            elif text == "(":
                out.append("(")
                depth += 1
                flags_m.append(flags_m[-1])
            else:
                raise PatternError(f"not a group: {text}")
        elif text == ")":
            depth -= 1
            if depth < 0:
                raise PatternError("unopened group")
            flags_m.pop()
            out.append(text)
        elif kind == "count" or text in "*+?":
            if text == "{}" or text == "{,}" or not out or (previous in ("", "(", "|") and not pattern[: m.start()].endswith(")")):
                raise PatternError(f"nothing to repeat: {text}")
            if previous == "repeat" and text == "+":
                raise PatternError("possessive quantifiers are not supported")
            low, _, high = text.strip("{}").partition(",") if kind == "count" else ("1", "", "1")
            if kind == "count":
                if low and high and int(low) > int(high):
                    raise PatternError(f"invalid repetition: {text}")
                multiply *= max(int(high or low or 1), 1)
                text = "{" + (low or "0") + text[text.find(",") : -1] + "}" if "," in text else text
            out.append(text)
            previous = "repeat"
            if multiply * len(pattern) > SIZE_LIMIT:
                raise PatternError("the pattern is too large")
            continue
        elif text in "{":
            raise PatternError("not a repetition")
        elif text == "$":
            out.append("$" if flags_m[-1] and java else "(?=\n|\\Z)" if flags_m[-1] else "\\z" if java else "\\Z")
        else:
            out.append(text)
        previous = text
    if depth or classes:
        raise PatternError("unclosed group or class")
    if len(pattern) > SIZE_LIMIT:
        raise PatternError("the pattern is too large")
    joined = "".join(out)
    return f"(?dU){joined}" if java else joined


def checked(pattern: str) -> None:
    """Raises PatternError for what can't be compiled."""
    translated(pattern)
    try:
        plain = translated(pattern, java=False)
    except PatternError as e:
        if "nested" in str(e) or "flags inside" in str(e):
            return
        raise
    try:
        re.compile(plain)
    except re.error as e:
        raise PatternError(str(e)) from e


_LITERAL = r"(?:\\[^A-Za-z0-9|]|[^.\\*+?{}^$()\[\]|])*"
_OUTSIDE = _LITERAL.replace("0-9|", "0-9")
_FINITE = re.compile(rf"\^({_OUTSIDE})(?:\(({_LITERAL}(?:\|{_LITERAL})*)\)({_OUTSIDE}))?\$", re.S)


def literals(pattern: str) -> list[str] | None:
    """The finite set of texts that a pattern of the form ``^text$`` or ``^text(a|b)text$`` matches, else None."""
    m = None if "(?" in pattern else _FINITE.fullmatch(pattern)
    if not m:
        return None
    plain = lambda s: re.sub(r"\\(.)", r"\1", s, flags=re.S)
    return [plain(m[1])] if m[2] is None else [plain(m[1]) + plain(a) + plain(m[3]) for a in m[2].split("|")]
