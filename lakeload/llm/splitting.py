"""Split patterns of byte-level tokenizers, compiled for speed.

The patterns name Unicode classes (``\\p{L}``, ``\\p{N}``, ``\\s``), which Python's
own engine does not know, or knows by another version of Unicode. It is about
twice as fast as ``regex``, so the classes are written out as ranges. Where the
ranges come from is a parameter, as each tokenizer library has its own Unicode
version. Ranges beyond U+FFFF are slow to test, and are left out for texts
without such characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

#: Code points that a class holds, as (first, last) pairs.
Ranges = list[tuple[int, int]]

_PART = re.compile(r"\\p\{\w+\}|\\.|\[\^?|\]|\(\?[:!=]|[^\\\[\]]", re.DOTALL)
_FAR = re.compile("[\U00010000-\U0010ffff]")
_CONTROL = (r"\r", r"\n", r"\t")


#: So many characters are looked at at a time, as a worker keeps most of what it once took from the system.
BLOCK = 1 << 14


@lru_cache
def _assigned() -> str:
    """All characters that any class may hold, in order."""
    runs: list[str] = []
    for start in range(0, 0x110000, BLOCK):
        points = np.arange(start, start + BLOCK, dtype=np.uint32)
        points = points[(points < 0xD800) | (points > 0xDFFF)]
        runs += regex.findall(r"[^\p{Cn}\p{Co}]+", points.astype("<u4").tobytes().decode("utf-32-le"))
    return "".join(runs)


def _as_ranges(spans: list[tuple[int, int]]) -> Ranges:
    """Ranges of code points from the places of runs in ``_assigned()``."""
    text = _assigned()
    points = np.frombuffer("".join(text[a:b] for a, b in spans).encode("utf-32-le"), np.uint32).astype(np.int64)
    cuts = np.flatnonzero(np.diff(points) != 1) + 1
    return [(int(run[0]), int(run[-1])) for run in np.split(points, cuts) if len(run)]


@lru_cache
def regex_class(name: str) -> Ranges:
    """A class as the ``regex`` package has it."""
    return _as_ranges([m.span() for m in regex.finditer(f"{name}+", _assigned())])


@lru_cache
def library_class(name: str) -> Ranges:
    """A class as the tokenizer libraries have it (``tokenizers`` and ``tiktoken`` agree)."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    text, split = _assigned(), Split(Regex(f"{name}+"), "removed")
    spans: list[tuple[int, int]] = []
    for start in range(0, len(text), BLOCK):  # a class is one of characters: a run cut here gives the same ranges
        block = text[start : start + BLOCK]
        edges = [0, *(place for _, span in split.pre_tokenize_str(block) for place in span), len(block)]
        spans += ((start + a, start + b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b)
    return _as_ranges(spans)


def _bracket(ranges: Ranges, last: int) -> str:
    inside = ((a, min(b, last)) for a, b in ranges if a <= last)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in inside)


def _written_out(pattern: str, classes: Callable[[str], Ranges], last: int) -> str | None:
    """``pattern`` for Python's engine up to code point ``last``; None if it has a part not known here."""
    out, inside, end = [], False, 0
    for match in _PART.finditer(pattern):
        part = match.group()
        if match.start() != end:
            return None
        end = match.end()
        if part.startswith(r"\p") or part == r"\s":
            ranges = _bracket(classes(part), last)
            out.append(ranges if inside else f"[{ranges}]")
        elif part == r"\S" and not inside:
            out.append(f"[^{_bracket(classes(r'\s'), last)}]")
        elif part[0] == "\\" and part[1].isalnum() and part not in _CONTROL:
            return None
        elif part == "?" and out and out[-1] == "(":
            return None
        else:
            if part in ("[", "[^", "]"):
                if inside != (part == "]"):
                    return None
                inside = part != "]"
            out.append(part)
    return "".join(out) if end == len(pattern) else None


def splitter(pattern: str, classes: Callable[[str], Ranges] = regex_class) -> Callable[[str], list[str]]:
    """All matches of ``pattern`` in a text, from left to right.

    Patterns with a part that cannot be written out go through ``regex``.
    """
    near, whole = (_written_out(pattern, classes, last) for last in (0xFFFF, 0x10FFFF))
    if near is None or whole is None:
        return regex.compile(pattern).findall
    fast, slow, far = re.compile(near).findall, re.compile(whole).findall, _FAR.search
    return lambda text: slow(text) if not text.isascii() and far(text) else fast(text)
