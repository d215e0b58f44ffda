"""Merges of new rows into old ones. Every result is a plan; writing it is up to the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.operators.windows import keep_first


def old_wins(old: DataFrame, new: DataFrame, key: list[str], order: list[Column] = ()) -> DataFrame:
    """Old rows, and new ones of other keys."""
    return _ranked(old, new, key, 0, order)


def new_wins(old: DataFrame, new: DataFrame, key: list[str], order: list[Column] = ()) -> DataFrame:
    """New rows, and old ones of other keys."""
    return _ranked(old, new, key, 1, order)


def _ranked(old: DataFrame, new: DataFrame, key: list[str], winner: int, order) -> DataFrame:
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, key, [F.abs(F.col("__new") - winner), *order]).drop("__new")


def appended(old: DataFrame, new: DataFrame, key: str, items: str) -> DataFrame:
    """Lists of both by key, the old elements first; other columns from the old row where there is one."""
    others = [c for c in old.columns if c not in (key, items)]
    a, b = old.alias("a"), new.alias("b")
    empty = F.array().cast(old.schema[items].dataType)
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key),
        *[F.when(F.col(f"a.{key}").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in others],
        F.concat(F.coalesce(f"a.{items}", empty), F.coalesce(f"b.{items}", empty)).alias(items),
    )


def last_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes last, as when later files overwrite earlier ones."""
    return keep_first(rows, key, [c.desc() for c in order])
