"""Negative records: one row for each distinct edited picture path in samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.functions.text import main_category, plain, sub_category


def negative_rows(samples: DataFrame) -> DataFrame:
    """One row per element of ``negatives`` with a path: path, source, category, sub_category, normalised."""
    return samples.select("source", F.explode("negatives").alias("n")).select(
        F.col("n.edited_image_path").alias("edited_image_path"),
        plain(F.col("source")).alias("source"),
        main_category(F.col("n.category")).alias("category"),
        sub_category(F.col("n.sub_category")).alias("sub_category"),
    ).filter("edited_image_path is not null")


def negative_records(samples: DataFrame) -> DataFrame:
    """Distinct negative records that have a category. Repeats of a path agree, so any value stands for all."""
    return (
        negative_rows(samples)
        .groupBy("edited_image_path")
        .agg(*(F.max(c).alias(c) for c in ("source", "category", "sub_category")))
        .filter("category is not null")
    )


def scored_records(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """Negative records with their score row: the one of the path with the latest ``scored_at``.

    Both tables meet in one aggregation by path, so there is one shuffle and a path with many
    rows is combined before it. Of several rows with the same ``scored_at`` the one with the
    largest ``score_id`` counts; a row without ``scored_at`` is the earliest.
    """
    left = negative_rows(samples).select(
        "edited_image_path", "source", "category", F.lit(None).cast("struct<at:timestamp_ntz,score_id:bigint,score:double>").alias("s")
    )
    right = scores.filter("edited_image_path is not null").select(
        "edited_image_path",
        F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("category"),
        F.struct(
            F.coalesce(F.col("scored_at").cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("at"),
            F.col("score_id").cast("bigint").alias("score_id"),
            F.col("tifa_score").cast("double").alias("score"),
        ).alias("s"),
    )
    both = left.unionByName(right).groupBy("edited_image_path")
    return (
        both.agg(F.max("source").alias("source"), F.max("category").alias("category"), F.max("s").alias("s"))
        .filter("category is not null and s is not null")
        .select("edited_image_path", "source", "category", "s.score_id", "s.score")
    )
