"""Predicates on edits, questions and layouts. A null operand makes a predicate false, so filters drop what isn't known."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pairloom.functions import captions as C

# Wordings of questions that don't verify anything.
VAGUE = ["clearly visible", "deformed", "look clear"]


def sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def reaches(score: Column, least: float) -> Column:
    """Whether a score is known and at least so large; NaN isn't."""
    return sure((score >= least) & ~F.isnan(score))


def of_split(path: Column, split: str) -> Column:
    """Whether a picture may be used in a split: training pictures aren't used in validation."""
    return sure(~F.contains(path, F.lit("train"))) if split == "validation" else path.isNotNull()


def degenerate_group(caption: Column) -> Column:
    """Whether a caption counts a group of one or none."""
    return sure(F.startswith(caption, F.lit("A group of one")) | F.startswith(caption, F.lit("A group of no")))


def has_direction_token(caption: Column) -> Column:
    """Whether a direction is a token of its own."""
    return sure(C.first_direction(caption).isNotNull())


def usable_questions(questions: Column) -> Column:
    """The questions that verify something."""
    return F.filter(questions, lambda q: ~F.exists(F.array(*map(F.lit, VAGUE)), lambda v: F.contains(q["question"], v)))


def enough_questions(full: Column, region: Column, negative: Column) -> Column:
    """Whether there are at least three questions on the caption, two on the region and one on what must be absent."""
    return sure((F.size(full) >= 3) & (F.size(region) >= 2) & (F.size(negative) >= 1))


def enough_for_each(by_object: Column, least: int = 4) -> Column:
    """Whether every object has so many questions; false for no objects."""
    return sure((F.size(by_object) > 0) & F.forall(F.map_values(by_object), lambda qs: F.size(qs) >= least))


def long_enough(phrase: Column, least: int = 3) -> Column:
    return sure(F.length(phrase) >= least)


def count_fits(caption: Column, boxes: Column) -> Column:
    """Whether a caption's count covers its boxes; with two boxes or fewer any count does."""
    return sure((F.size(boxes) <= 2) | (C.count_total(caption) >= F.size(boxes)))


def counted_once(nouns: Column, noun: Column, count: Column) -> Column:
    """Whether an object occurs once among a caption's nouns and has a count."""
    return sure(F.size(F.filter(nouns, lambda n: n == noun)) == 1) & count.isNotNull()


def without(boxes: Column, removed: Column) -> Column:
    """The boxes that weren't removed; null if a removed one wasn't there."""
    left = F.array_except(boxes, removed)
    return F.when(F.size(left) + F.size(F.array_distinct(removed)) == F.size(F.array_distinct(boxes)), left)
