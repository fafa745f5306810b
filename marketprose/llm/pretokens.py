"""Pre-tokens of byte-level vocabularies, quickly, and a cache that is bounded by bytes."""

from __future__ import annotations

import re
import sys
import weakref
from collections.abc import Callable

import regex

#: Fixed value: the pattern that byte-level vocabularies split text with before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _spelled(letters: str, numbers: str, spaces: str) -> re.Pattern:
    """The pattern with its three classes written out; alternatives that cannot start alike may change places."""
    return re.compile(
        f" ?[{letters}]+| ?[{numbers}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{spaces}{letters}{numbers}]+"
        f"|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    )


_ASCII = _spelled("A-Za-z", "0-9", r"\t\n\v\f\r ").findall
_LATIN = _spelled("A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\\t\\n\\v\\f\\r \x85\xa0").findall
#: characters of which the Latin classes above do not know what they are; dashes, quotes and the euro sign are known
_BEYOND = re.compile("[^\x00-ɏ‐-‧‰-⁞€]").search
_ANY = regex.compile(PATTERN).findall


def pieces(text: str) -> list[str]:
    """All matches of ``PATTERN``."""
    if text.isascii():
        return _ASCII(text)
    return _ANY(text) if _BEYOND(text) else _LATIN(text)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """What finds all matches of a pattern."""
    return pieces if pattern == PATTERN else regex.compile(pattern).findall


class ByteCache(dict):
    """Key to packed result, computed when first seen and kept within ``limit`` bytes.

    The entries are those of two generations of half the limit each: when the young one is full it becomes the old one, and what is
    asked for again moves over.
    """

    ENTRY = 100  # a slot of the table and a share of its spare room
    tables: list[weakref.ref[ByteCache]] = []

    def __init__(self, compute: Callable[[str], bytes], limit: int = 96 << 20):
        ByteCache.tables = [t for t in ByteCache.tables if t() is not None] + [weakref.ref(self)]
        self.compute, self.limit = compute, limit
        self.older: dict[str, bytes] = {}
        self.used = self.used_by_older = 0

    def __missing__(self, key: str) -> bytes:
        value = self.older.pop(key, None)
        if value is None:
            value = self.compute(key)
            if len(key) > 256:  # long ones hardly come again
                return value
        size = sys.getsizeof(key) + sys.getsizeof(value) + self.ENTRY
        if 2 * (self.used + size) > self.limit:
            self.older, self.used_by_older = dict(self), self.used
            self.clear()
            self.used = 0
        self.used += size
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.older = {}
        self.used = self.used_by_older = 0
