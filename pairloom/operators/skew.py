"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.session import materialize

#: Largest row count of a side that is broadcast; the size is checked before each use.
BROADCAST_ROWS = 20_000
#: Largest size of such a side, as text.
BROADCAST_BYTES = 64 << 20


def within(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


#: Keys looked for as hot, and the part of all rows from which on a key is.
HOT_KEYS = 256
HOT_PART = 1_000
#: Below so many rows no key is hot, whatever its part: they fit one task. The rows are the same on either way.
HOT_LEAST = 100_000


def hot_hashes(rows: DataFrame, on: list[str]) -> list[int]:
    """Hashes of the keys that hold more than 1/``HOT_PART`` of the rows, by one mergeable frequency sketch: no shuffle, ``HOT_KEYS`` at most."""
    found = rows.select(F.xxhash64(*on).alias("h")).agg(F.expr(f"approx_top_k(h, {HOT_KEYS}, {16 * HOT_KEYS})").alias("top"), F.count("*").alias("n")).first()
    least = max(found["n"] / HOT_PART, HOT_LEAST)
    return [x["item"] for x in found["top"] or [] if x["count"] > least]


def _is_scan(df: DataFrame) -> bool:
    """Whether ``df`` only reads, filters and projects files, so that reading it twice repeats no join or aggregation."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1 and plan.nodeName() in ("Filter", "Project"):
        plan = plan.children().head()
    return plan.children().isEmpty()


def _measured(small: DataFrame, max_rows: int) -> tuple[DataFrame | None, DataFrame]:
    """``(small, small)`` if it may be broadcast, else ``(None, small)``; a plan that is more than a scan is worked out once, into a table."""
    if not _is_scan(small):
        small = materialize(small, "small")
    rows, size = small.limit(max_rows + 1).select(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return (small if rows <= max_rows and size <= BROADCAST_BYTES else None), small


def spread_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``big`` to ``small`` (unique on ``on``) without letting a hot key fill one task.

    A ``small`` of at most ``max_rows`` rows and ``BROADCAST_BYTES``, checked here, is broadcast. Either side is worked out
    once: what is more than a scan is written to the shared folder first, where it has to be read again. Beyond the bounds the rows of
    hot keys, of which there are ``HOT_KEYS`` at most, meet their matches by broadcast, and only the
    rest, in which every key is rare, is shuffled. ``how`` may be ``inner``, ``left``,
    ``left_semi`` or ``left_anti``. Null keys match nothing.
    """
    bounded, small = _measured(small, max_rows)
    if bounded is not None:
        return big.join(F.broadcast(bounded), on, how)
    big = big if _is_scan(big) else materialize(big, "big")
    hot = hot_hashes(big, on)
    if not hot:
        return big.join(small, on, how)
    is_hot = F.xxhash64(*[F.col(c) for c in on]).isin(hot)
    return big.filter(is_hot).join(F.broadcast(small.filter(is_hot)), on, how).unionByName(big.filter(~is_hot).join(small, on, how))


def hot_split_join(rows: DataFrame, groups: DataFrame, key: str, size: str, hot_share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` to its own per-key summary ``groups``, hot keys apart.

    ``groups`` holds each key once with its number of rows in ``size``. Keys with more than
    1/``hot_share`` of all rows are at most ``hot_share``, so their summaries are broadcast;
    the other keys are small and are joined by shuffle.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    bound = max(total // hot_share, 10_000)
    hot = groups.filter(F.col(size) > bound)
    cold = groups.filter(F.col(size) <= bound)
    if total <= 10_000 or within(hot, 0):
        return rows.join(groups, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


#: Rows of one key on either side that one task pairs.
PAIR_ROWS = 2_000


def pair_join(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, block: int = PAIR_ROWS) -> DataFrame:
    """All pairs of a left and a right row with the same key, where keys may be frequent on both sides.

    A key with more than ``block`` rows on a side is cut into blocks by a hash of the id column of that
    side; every block meets every block of the other side in a task of its own. So no task pairs
    more than about ``block`` rows with ``block`` rows of one key, however frequent it is. Null keys match nothing.
    """
    size = lambda df, name: df.groupBy(*on).agg(F.count("*").alias(name))
    both = size(left, "__l").join(size(right, "__r"), on).filter(f"__l > {block} or __r > {block}")
    both = materialize(both.select(*on, *(F.expr(f"cast(ceil({c} / {block}) as int)").alias(n) for c, n in (("__l", "__m"), ("__r", "__n")))), "pair-blocks")
    if both.isEmpty():
        return left.join(right, on)

    def cut(df: DataFrame, id_: str, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(F.lit(own), id_), F.coalesce(own, F.lit(1))).cast("int").alias("__i" if own == "__m" else "__j")
        theirs = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias("__j" if own == "__m" else "__i")
        return spread_join(df, both, on, "left").select(*df.columns, mine, theirs)

    return cut(left, left_id, "__m", "__n").join(cut(right, right_id, "__n", "__m"), [*on, "__i", "__j"]).drop("__i", "__j")
