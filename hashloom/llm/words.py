"""Words of a text as leak detection sees them."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_BRACKET = re.compile(r"[()\[\]]")
_OPENS = {")": "(", "]": "["}
_WORD = re.compile(r"[^\W_]+")
#: Which code points are combining marks, up to the last one that is.
_MARKS = np.array([unicodedata.combining(chr(c)) > 0 for c in range(0x1F000)])


def without_marks(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = points[~_MARKS[np.minimum(points, len(_MARKS) - 1)]]
    return text if len(kept) == len(points) else kept.tobytes().decode("utf-32-le", "surrogatepass")


def without_brackets(text: str) -> str:
    """Text in ( ) or [ ], nested ones too, replaced by a space; brackets without a partner stay.

    One scan: a closing bracket goes with the nearest open one of its kind, and what is open between them has no partner.
    """
    stack: list[tuple[str, int]] = []
    opened = {"(": 0, "[": 0}
    removed: list[tuple[int, int]] = []
    for found in _BRACKET.finditer(text):
        char, at = found.group(), found.start()
        if char in opened:
            stack.append((char, at))
            opened[char] += 1
        elif opened[_OPENS[char]]:
            while True:
                kind, begin = stack.pop()
                opened[kind] -= 1
                if kind == _OPENS[char]:
                    break
            # Pairs end in order: those inside this one are the last so far.
            while removed and removed[-1][0] > begin:
                removed.pop()
            removed.append((begin, at + 1))
    if not removed:
        return text
    parts, at = [], 0
    for begin, end in removed:
        parts.append(text[at:begin])
        at = end
    return " ".join([*parts, text[at:]])


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, without regard to case, accents and bracketed text."""
    if not text:
        return []
    text = without_brackets(text)
    if not text.isascii():
        text = without_marks(unicodedata.normalize("NFKD", text)).casefold()
        if not text.isascii():
            text = unicodedata.normalize("NFKD", text)
    else:
        text = text.lower()
    return _WORD.findall(text)
