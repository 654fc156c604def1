"""Cutting texts for byte-level BPE with the standard library's regular expressions.

``re`` has no ``\\p{..}``. Its own classes agree with letter, number and white space but for a few
thousand code points; those are found once per process from the Unicode tables of the ``regex``
package, and a text that holds one of them is cut by ``regex`` itself, about three times as slow.
"""

from __future__ import annotations

import functools
import re

import regex

#: The cutting patterns of the public vocabularies, as their files state them.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.cache
def _odd() -> re.Pattern:
    """Code points that the two packages put into different classes, and all beyond the basic plane."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    odd: set[str] = set()
    for theirs, ours in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\p{White_Space}", r"\s")):
        odd |= set("".join(regex.findall(theirs + "+", every))) ^ set("".join(re.findall(ours + "+", every)))
    return re.compile("[" + "".join(f"\\u{ord(c):04x}" for c in sorted(odd)) + "\\U00010000-\\U0010ffff]")


class Cutter:
    def __init__(self, pattern: str):
        self.exact = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.fast = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+").replace(r"[\p{L}]", r"[^\W\d_]").replace(r"[\p{N}]", r"\d").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d"))

    def __call__(self, text: str) -> list[str]:
        return (self.exact if _odd().search(text) else self.fast).findall(text)


@functools.cache
def byte_level() -> Cutter:
    """Contractions, words with one leading blank, numbers, other marks, white space."""
    return Cutter(BYTE_LEVEL)


@functools.cache
def word_level() -> Cutter:
    """Contractions, words, single digits, other marks; white space is dropped."""
    return Cutter(WORD_LEVEL)
