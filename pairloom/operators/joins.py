"""Reconciliation, spatial and nearest-neighbour joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.functions import geometry as G
from pairloom.functions.sampling import weighted
from pairloom.operators.skew import spread_join, within
from pairloom.operators.windows import keep_first


def with_default(rows: DataFrame, tags: DataFrame, on: list[str], tag: str, default: str) -> DataFrame:
    """Left join to a tag, with a default where there is none."""
    return spread_join(rows, tags.select(*on, tag), on, "left").withColumn(tag, F.coalesce(tag, F.lit(default)))


def accepted(edits: DataFrame, verdicts: DataFrame, on: list[str], verdict: str = "reject", wanted: str = "NO") -> DataFrame:
    """Edits whose verdict is exactly ``wanted``; a missing one drops the edit."""
    return spread_join(edits, verdicts.filter(F.col(verdict) == wanted).select(*on).distinct(), on, "left_semi")


def reconciled(rows: DataFrame, key: list[str], must: dict[str, DataFrame], must_not: dict[str, DataFrame]) -> DataFrame:
    """Each row with a flag per condition: in every ``must`` set, in no ``must_not`` set; ``kept`` if all hold. Counters are sums of flags, so one pass gives rows and counters."""
    out, flags = rows, []
    for name, (df, want) in {**{n: (d, True) for n, d in must.items()}, **{n: (d, False) for n, d in must_not.items()}}.items():
        found = df.select(*key).distinct().withColumn(name, F.lit(True))
        out = spread_join(out, found, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
        flags.append(F.col(name) if want else ~F.col(name))
    kept = flags[0]
    for f in flags[1:]:
        kept = kept & f
    return out.withColumn("kept", kept)


def remaining(rows: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Rows that aren't done yet."""
    return spread_join(rows, done.select(*on).distinct(), on, "left_anti")


def incomplete(rows: DataFrame, done: DataFrame, on: list[str], want: str, have: str) -> DataFrame:
    """Rows that aren't done, or whose number of parts differs from the wanted one."""
    return rows.join(done.select(*on, have), on, "left").filter(F.col(have).isNull() | (F.col(have) != F.col(want)))


def first_substring(rows: DataFrame, text: str, phrases: list[str], name: str) -> DataFrame:
    """The first phrase of a list, in its order, that a text contains; null if none."""
    return rows.withColumn(name, F.try_element_at(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.col(text), p)), F.lit(1)))


def without_overlap(left: DataFrame, right: DataFrame, by: list[str], key: str, box: str = "box", least: float = 0.2, cell: float = 128.0) -> DataFrame:
    """Boxes of ``left`` that no box of ``right`` in the same group overlaps by more than ``least`` IoU.

    Boxes meet in the grid cells they touch, so the join is by equality, and a box that covers
    many cells is the only one repeated often.
    """
    cells = lambda b, p, s: F.sequence(F.floor(b[p] / cell), F.floor((b[p] + b[s]) / cell))
    spread = lambda df, c: df.withColumn("__cx", F.explode(cells(F.col(c), "x", "w"))).withColumn("__cy", F.explode(cells(F.col(c), "y", "h")))
    a = spread(left.select(key, *by, F.col(box).alias("__a")), "__a")
    b = spread(right.select(*by, F.col(box).alias("__b")), "__b")
    hit = a.join(b, [*by, "__cx", "__cy"]).filter(G.iou(F.col("__a"), F.col("__b")) > least).select(key).distinct()
    return left.join(hit, key, "left_anti")


def overlapping_pairs(boxes: DataFrame, by: list[str], key: str, box: str = "box", cell: float = 128.0) -> DataFrame:
    """Pairs of boxes of a group that overlap, each once, the smaller key first."""
    cells = lambda p, s: F.sequence(F.floor(F.col(box)[p] / cell), F.floor((F.col(box)[p] + F.col(box)[s]) / cell))
    spread = boxes.withColumn("__cx", F.explode(cells("x", "w"))).withColumn("__cy", F.explode(cells("y", "h")))
    a = spread.select(*by, "__cx", "__cy", F.col(key).alias("key_a"), F.col(box).alias("__a"))
    b = spread.select(*by, "__cx", "__cy", F.col(key).alias("key_b"), F.col(box).alias("__b"))
    return a.join(b, [*by, "__cx", "__cy"]).filter((F.col("key_a") < F.col("key_b")) & G.overlaps(F.col("__a"), F.col("__b"))).select(*by, "key_a", "key_b").distinct()


#: Queries of a nearest-neighbour search that each task holds; more are searched in blocks of about so many, one scan each.
QUERY_BLOCK = 4_096


def capped_neighbours(rows: DataFrame, key: str, vector: str, queries: DataFrame, below: float, k: int = 1) -> DataFrame:
    """For each query the ``k`` most similar rows with a cosine below a cap, itself left out: query, match, similarity.

    A stated query set goes in blocks over all rows: every task compares its rows with the block
    and keeps ``k`` per query, then these few meet per query. Zero vectors match nothing; of
    equal similarities the smaller key comes first.
    """
    asked = queries.select(key, vector).filter(F.col(vector).isNotNull())
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    kind = rows.schema[key].dataType.simpleString()
    out = None
    for number in range(blocks):  # each is read for itself, so the driver holds one at a time
        block = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)) == number)).toPandas()
        ids = block[key].to_numpy()
        matrix = np.array([np.asarray(v, np.float64) for v in block[vector]])

        def search(batches: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            scale = np.sqrt((matrix * matrix).sum(1)) if len(ids) else np.zeros(0)
            for b in batches:
                b = b[b[vector].notna()]
                if not len(b) or not len(ids):
                    continue
                m = np.array([np.asarray(v, np.float64) for v in b[vector]])
                size = np.sqrt((m * m).sum(1))
                with np.errstate(invalid="ignore", divide="ignore"):
                    sim = (m @ matrix.T) / (size[:, None] * scale[None, :])
                keys = b[key].to_numpy()
                sim[~np.isfinite(sim) | (sim >= below) | (keys[:, None] == ids[None, :])] = -np.inf
                top = np.lexsort((np.broadcast_to(keys[:, None], sim.shape), -sim), axis=0)[:k]
                q = np.broadcast_to(np.arange(len(ids)), top.shape).ravel()
                r = top.ravel()
                s = sim[r, q]
                ok = np.isfinite(s)
                yield pd.DataFrame({"query": ids[q[ok]], "match": keys[r[ok]], "similarity": s[ok]})

        part = rows.select(key, vector).mapInPandas(search, f"query {kind}, match {kind}, similarity double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "match")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def matching_instances(objects: DataFrame, instances: DataFrame, on: list[str], order: list[Column], most: int = 3) -> DataFrame:
    """Up to ``most`` instances of each object."""
    w = Window.partitionBy(*objects.columns).orderBy(*order)
    return objects.join(instances, on).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__r")


def best_per_class(rows: DataFrame, by: list[str], score: str, order: list[Column], k: int) -> DataFrame:
    """The ``k`` rows with the greatest score in each class."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def class_demos(rows: DataFrame, by: list[str], verdict: str, score: str, order: list[Column], k: int, seed: int, key: Column) -> DataFrame:
    """Demonstrations of each class: of the 1.5 k most similar rows of either verdict, k // 2 drawn by hash.

    ``rows`` has a boolean ``verdict``; a null one takes no part. ``turn`` gives the order of the class's demonstrations: accepted ones first, rejected ones first, or mixed, with chances of 0.4, 0.4 and 0.2.
    """
    near = best_per_class(rows.filter(F.col(verdict).isNotNull()), [*by, verdict], score, order, k * 3 // 2).drop("rank")
    w = Window.partitionBy(*by, verdict).orderBy(F.xxhash64(F.lit(seed), key), key)
    drawn = near.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k // 2).drop("__r")
    way = weighted(["accepted", "rejected", "mixed"], [0.4, 0.4, 0.2], seed, *map(F.col, by))
    first = F.when(way == "mixed", F.lit(0)).when((way == "accepted") == F.col(verdict), F.lit(0)).otherwise(F.lit(1))
    turn = Window.partitionBy(*by).orderBy(first, F.xxhash64(F.lit(seed + 1), key), key)  # k rows at most
    return drawn.withColumn("turn", F.row_number().over(turn))
