"""Draws by hash: the same for a seed and key whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RANGE = 1 << 30


def draw(seed: int, *key: Column) -> Column:
    """A whole number from 0 to ``RANGE`` - 1."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(RANGE))


def chance(p: float, seed: int, *key: Column) -> Column:
    """True for a share ``p`` of the keys."""
    return draw(seed, *key) < int(p * RANGE)


def pick(items: Column, seed: int, *key: Column) -> Column:
    """One element of an array; null for an empty one."""
    return F.get(items, (draw(seed, *key) % F.greatest(F.size(items), F.lit(1))).cast("int"))


def weighted(values: list, weights: list[float], seed: int, *key: Column) -> Column:
    """One of the values with the given weights."""
    total, at = sum(weights), 0.0
    u, out = draw(seed, *key), F.lit(values[-1])
    bounds = []
    for w in weights:
        at += w
        bounds.append(int(at / total * RANGE))
    for v, b in reversed(list(zip(values, bounds))[:-1]):
        out = F.when(u < b, F.lit(v)).otherwise(out)
    return out


def shuffled(items: Column, seed: int, *key: Column) -> Column:
    """The elements in an order drawn for the key."""
    tagged = F.transform(items, lambda x, i: F.struct(F.xxhash64(F.lit(seed), *key, i).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda s: s["x"])


def sample_per_group(rows: DataFrame, by: list[str], key: str, n: int, seed: int) -> DataFrame:
    """Up to ``n`` rows of each group in hash order; the rank limit is applied before the shuffle too."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key))
    return rows.withColumn("__r", F.row_number().over(w)).filter(f"__r <= {n}").drop("__r")
