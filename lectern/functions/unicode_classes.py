"""Regular-expression classes built from the Unicode database, in a syntax that Java and RE2 share."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable

# The writing-system concepts whose characters count as punctuation, looked
# for in a character's Unicode name, and the controls that carry line structure.
PUNCTUATION_CONCEPTS = (
    "FULL STOP", "COMMA", "QUESTION MARK", "EXCLAMATION MARK", "SEMICOLON", "COLON", "APOSTROPHE", "QUOTATION MARK",
    "CORNER BRACKET", "PARENTHESIS", "HYPHEN", "DASH", "ELLIPSIS", "DANDA",
)
LINE_CONTROLS = "\n\r\t"
# What joins two halves of a word.
WORD_JOINERS = "'’ʼ-‐‑‒–—―"

_TEXT = frozenset(("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Zs"))
_SILENT = frozenset(("Cc", "Cf", "Cs", "Co", "Cn", "Zl", "Zp"))


def speakable(c: str) -> bool:
    """Text, line structure, or punctuation by name."""
    return c in LINE_CONTROLS or unicodedata.category(c) in _TEXT or any(k in unicodedata.name(c, "") for k in PUNCTUATION_CONCEPTS)


def silent(c: str) -> bool:
    return c not in LINE_CONTROLS and unicodedata.category(c) in _SILENT


def ranges(test: Callable[[str], bool], stop: int = sys.maxunicode + 1) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for cp in range(stop):
        if 0xD800 <= cp <= 0xDFFF or not test(chr(cp)):
            continue
        if out and out[-1][1] == cp - 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return [(a, b) for a, b in out]


def char_class(found: list[tuple[int, int]]) -> str:
    """The inside of a bracket expression."""
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in found)


@functools.cache
def speakable_class() -> str:
    extra = ranges(lambda c: speakable(c) and unicodedata.category(c) not in _TEXT)
    return r"\p{L}\p{M}\p{Nd}\p{Zs}" + char_class(extra)


@functools.cache
def edge_class() -> str:
    """What is stripped from a token's ends: speakable, no letter or digit, no dash."""
    return char_class(ranges(lambda c: speakable(c) and not c.isalnum() and unicodedata.category(c) != "Pd", 0x10000))


@functools.cache
def digit_class() -> str:
    return r"\p{Nd}" + char_class(ranges(lambda c: c.isdigit() and unicodedata.category(c) != "Nd"))


@functools.cache
def silent_class() -> str:
    return char_class(ranges(silent))
