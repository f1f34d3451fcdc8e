"""Tokenisation as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]

#: White space as Unicode has it; Java's \\s alone is ASCII.
SPACE = r"[\s\x0B\x85\p{Z}]+"


def tokenize(text: Column) -> Column:
    """Lower-case tokens: split at white space, keep only ASCII letters and digits, drop what becomes empty.

    Null text gives null. Works on the whole text with generated code; no function is interpreted per word.
    """
    flat = F.regexp_replace(F.regexp_replace(text, SPACE, " "), "[^A-Za-z0-9 ]", "")
    return F.array_remove(F.split(F.lower(flat), " "), "")


def count_in(tokens: Column, term: str) -> Column:
    """How often a term occurs in an array of tokens."""
    return F.size(tokens) - F.size(F.array_remove(tokens, term))
