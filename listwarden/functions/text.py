"""Folding and tokenising of names and text lines."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_TOKEN = 3
MIN_NAME_LETTERS = 6


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """Characters whose canonical base is one ASCII character, and that character.

    Derived from the Unicode decomposition rule; the combining marks come last and have no
    counterpart, so ``translate`` removes them.
    """
    source, target = [], []
    for code in range(0x80, 0x30000):
        parts = unicodedata.normalize("NFD", chr(code))
        base = "".join(c for c in parts if not 0x300 <= ord(c) <= 0x36F)
        if base != chr(code) and len(base) == 1 and ord(base) < 0x80:
            source.append(chr(code))
            target.append(base)
    source += ["đ", "Đ"]
    target += ["d", "D"]
    marks = [chr(c) for c in range(0x300, 0x370)]
    return "".join(source + marks), "".join(target)


def fold(text: Column) -> Column:
    """Lower-case ASCII words: marks dropped, letter/digit runs separated, the rest one space."""
    source, target = fold_table()
    plain = F.lower(F.translate(text, source, target))
    split = F.regexp_replace(F.regexp_replace(plain, r"([a-z])(\d)", "$1 $2"), r"(\d)([a-z])", "$1 $2")
    return F.trim(F.regexp_replace(split, r"[^a-z0-9]+", " "))


def _words(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda t: t.rlike("^[a-z]+$") & (F.length(t) >= MIN_TOKEN))


def name_tokens(name: Column) -> Column:
    return _words(fold(F.regexp_replace(name, r"\([^)]*\)", " ")))


def line_tokens(line: Column) -> Column:
    return _words(fold(line))


def tolerance(token: Column) -> Column:
    return F.when(F.length(token) >= 8, 2).when(F.length(token) >= 5, 1).otherwise(0)


def letters(tokens: Column) -> Column:
    return F.length(F.array_join(tokens, ""))


def close_enough(line_token: Column, name_token: Column) -> Column:
    """Edit distance within the tolerance of the name token."""
    distance = F.levenshtein(line_token, name_token, 2)      # the largest tolerance; -1 beyond it
    return (line_token == name_token) | ((distance >= 0) & (distance <= tolerance(name_token)))
