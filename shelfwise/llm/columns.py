"""Column expressions for words, lines and symbols of a text, all of them built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.llm.common import SPACES


def without(text: Column, characters: str, by: str = "") -> Column:
    """``text`` with each of ``characters`` replaced."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(by)), characters, text)


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; null for a null text."""
    return F.array_remove(F.split(without(text, SPACES[1:], " "), " "), "")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out a single time, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
