"""Column expressions on strings that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fold(text: Column) -> Column:
    """``text`` without case: in upper case, in which letters with a longer one, as ß, meet it too."""
    return F.upper(text)


def words(text: Column) -> Column:
    """The maximal runs of letters and digits of ``text`` in order, without case; null gives null."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def letters_digits(text: Column) -> Column:
    """The letters and digits of ``text`` in order, without case."""
    return F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", "")


def plain(text: Column) -> Column:
    """``text`` without outer blanks and case."""
    return F.lower(F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def main_category(category: Column) -> Column:
    """The part of a category before any bracket, without outer blanks and case."""
    return plain(F.substring_index(category, "(", 1))


def sub_category(value: Column) -> Column:
    """The sub-category, without outer blanks and case; null or blank is ``others``."""
    cleaned = plain(value)
    return F.when(value.isNull() | (cleaned == ""), "others").otherwise(cleaned)
