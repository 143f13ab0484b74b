"""The pre-token pattern of byte-level BPE, on whole slices of text at once.

The pattern (``public_tokenizers.PATTERN``) takes, in this order: a contraction; an optional space with a run of letters, of
numbers or of other characters; white space up to its last character; white space. So pieces begin where the kind of
character changes, one earlier after a space, and the last character of a run of white space stands for itself.
"""

from __future__ import annotations

from functools import cache

import numpy as np

LETTER, NUMBER, OTHER, BLANK = range(4)


@cache
def kinds() -> np.ndarray:
    """The kind of every code point, as the rank library itself has it: its regular expressions pick the letters, numbers and
    white space out of a text of all code points. So no document is left to the library for a character's sake."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        picks = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        out[np.frombuffer(bytes(picks.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens, and the first one of each document (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    lead = (data & 0xC0) != 0x80
    byte_at = np.flatnonzero(lead)  # of each code point
    char_off = np.searchsorted(byte_at, off)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    kind = kinds()[points]
    first = np.zeros(n + 1, bool)  # of a document
    first[char_off] = True
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    change[0] = True
    blank = kind == BLANK
    last_blank = blank.copy()  # the last of its run, with something after it in the document
    last_blank[:-1] &= ~blank[1:] & ~first[1:n]
    last_blank[-1] = False
    begin = change | last_blank
    glued = np.flatnonzero(last_blank & (points == 32)) + 1  # these follow a space, which belongs to them
    begin[glued] = False
    quote = np.flatnonzero((points == 39) & begin)  # a quote that begins a piece
    if len(quote):
        end_of = char_off[np.searchsorted(char_off, quote, "right")]
        for i, stop in zip(quote.tolist(), end_of.tolist(), strict=True):
            two = points[i + 1 : min(i + 3, stop)].tolist()
            long = 2 if two[:1] and chr(two[0]) in "stmd" else 3 if len(two) == 2 and chr(two[0]) + chr(two[1]) in ("re", "ve", "ll") else 0
            if long:
                begin[i + 1 : i + long] = False
                if i + long < stop:
                    begin[i + long] = True
    # a piece may not begin twice: after a contraction the next run begins as any other
    at = np.flatnonzero(begin)
    starts = byte_at[at]
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.searchsorted(starts, off)
