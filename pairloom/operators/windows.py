"""First-of, quota, candidate and ordering operators. Each takes an explicit order, so results don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.operators.skew import spread_join
from pairloom.session import materialize


def keep_first(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group. The limit is applied before the shuffle too, so a hot group sends one row per task."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def keep_first_in_turn(rows: DataFrame, parent: str, keys: list[str], order: list[Column]) -> DataFrame:
    """First rows by one key within the parent, then of those by the next key."""
    for key in keys:
        rows = keep_first(rows, [parent, key], order)
    return rows


def quota(rows: DataFrame, key: str, caps: dict, order: list[Column]) -> DataFrame:
    """At most ``caps[key]`` rows of each key in order; keys without a cap keep all rows.

    Rows of keys without a cap don't take part in the ranking, and a capped key is ranked over
    its largest cap only, so no task holds a whole hot key.
    """
    if not caps:
        return rows
    limit = F.lit(None).cast("bigint")
    for value, n in caps.items():
        limit = F.when(F.col(key) == value, F.lit(n)).otherwise(limit)
    capped = rows.filter(F.col(key).isin(list(caps)))
    w = Window.partitionBy(key).orderBy(*order)
    ranked = capped.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= max(max(caps.values()), 0)).filter(F.col("__r") <= limit).drop("__r")
    return ranked.unionByName(rows.filter(~F.coalesce(F.col(key).isin(list(caps)), F.lit(False))))


def stratified_quota(rows: DataFrame, category: str, sub: str, caps: dict[str, int], order: list[Column], default: int | None = None) -> DataFrame:
    """Fair shares of a category's cap for its sub-categories, then the cap itself.

    Each sub-category keeps cap // number of sub-categories rows, at least one, in order; of all
    these the category keeps its cap. Categories without a cap use ``default``, or are left out.
    """
    cap = F.lit(default).cast("bigint")
    for value, n in caps.items():
        cap = F.when(F.col(category) == value, F.lit(n)).otherwise(cap)
    capped = rows.withColumn("__cap", cap).filter("__cap is not null")
    counts = capped.groupBy(category, sub).agg(F.first("__cap").alias("__c")).groupBy(category).agg(F.count("*").alias("__subs"))
    fair = F.greatest(F.lit(1), F.floor(F.col("__cap") / F.col("__subs")))
    most = max([*caps.values(), default or 1])
    first = Window.partitionBy(category, sub).orderBy(*order)
    second = Window.partitionBy(category).orderBy(F.col(sub), *order)
    shares = spread_join(capped, counts, [category])
    kept = shares.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= most).filter(F.col("__r") <= fair)
    return kept.withColumn("__q", F.row_number().over(second)).filter("__q <= __cap").drop("__cap", "__subs", "__r", "__q")


def numbered(rows: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """Rows numbered by a total order without one task that sees them all.

    Rows are split into ranges, which are written once, since their bounds are sampled; each range
    is counted, and its rows are numbered from the number of rows before it.
    """
    tagged = materialize(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = tagged.groupBy("__p").agg(F.count("*").alias("n")).collect()  # one row per partition
    before, at = {}, start
    for r in sorted(sizes, key=lambda r: r["__p"]):
        before[r["__p"]] = at
        at += r["n"]
    local = Window.partitionBy("__p").orderBy(*order)
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("__p")] if before else F.lit(start)
    return tagged.withColumn(name, F.row_number().over(local) - 1 + offset).drop("__p")


def chunked(rows: DataFrame, position: str, size: int, name: str = "chunk") -> DataFrame:
    """The chunk of each position, all of one size but the last."""
    return rows.withColumn(name, F.floor(F.col(position) / max(1, size)).cast("bigint"))


def paired(rows: DataFrame, position: str, fields: list[str]) -> DataFrame:
    """Rows 0 and 1, 2 and 3, and so on as one row each; an odd last row has no pair and is left out. Pairs meet by half the position, so there is no global order."""
    half = F.floor(F.col(position) / 2)
    odd = F.col(position) % 2 == 1
    return (
        rows.groupBy(half.alias("pair"))
        .agg(*[F.max(F.when(odd, F.col(f)) if side else F.when(~odd, F.col(f))).alias(f"{f}_{side}") for f in fields for side in (0, 1)], F.count("*").alias("__n"))
        .filter("__n = 2")
        .drop("__n")
    )


def best_candidate(rows: DataFrame, by: list[str], score: str, position: str) -> DataFrame:
    """The candidate with the greatest score, the earliest of equals. Null and NaN scores are worst."""
    usable = F.when(F.col(score).isNotNull() & ~F.isnan(score), F.col(score))
    return keep_first(rows, by, [usable.desc_nulls_last(), F.col(position)])


def first_perfect_else_last(rows: DataFrame, by: list[str], score: str, position: str, perfect: float = 1.0) -> DataFrame:
    """The earliest candidate with a perfect score, or the last one if none is."""
    hit = F.coalesce(F.col(score) == perfect, F.lit(False))
    order = F.when(hit, F.col(position).cast("bigint")).otherwise(F.lit(1 << 60) - F.col(position).cast("bigint"))
    return keep_first(rows, by, [order])


def rolling_meter(rows: DataFrame, by: list[str], order: list[Column], value: str, size: int = 20, block: int = 100_000) -> DataFrame:
    """Lower median, mean, maximum and last of the last ``size`` values of a group, and the mean of all so far.

    Groups are cut into blocks of ``block`` rows, so none of any size fills one task: a block also
    gets the last rows of the one before it, and the sums of the blocks before it. ``order`` must
    be total within a group. Null values take no part in the measures; a null group is one group.
    """
    block = max(block, size)
    group = F.to_json(F.struct(*[F.col(c) for c in by]), {"ignoreNullFields": "false"})
    placed = materialize(numbered(rows.withColumn("__g", group), [F.col("__g"), *order], "__n"), "placed")
    first = placed.groupBy("__g").agg(F.min("__n").alias("__f"))
    within_ = spread_join(placed, first, ["__g"]).withColumn("__n", F.col("__n") - F.col("__f")).drop("__f").withColumn("__b", F.floor(F.col("__n") / block))
    tail = within_.filter(F.floor((F.col("__n") + size - 1) / block) > F.col("__b")).withColumn("__b", F.col("__b") + 1)
    both = within_.withColumn("__own", F.lit(True)).unionByName(tail.withColumn("__own", F.lit(False)))
    sums = within_.groupBy("__g", "__b").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("s"), F.count(value).alias("c"))
    earlier = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("__g", "__b", F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("__s"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("__c"))

    last = Window.partitionBy("__g", "__b").orderBy("__n").rowsBetween(-(size - 1), 0)
    here = Window.partitionBy("__g", "__b").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("__own"), F.col(value))
    ranked = F.array_sort(F.collect_list(value).over(last))
    measured = both.join(before, ["__g", "__b"]).select(
        *rows.columns,
        F.get(ranked, F.floor((F.size(ranked) - 1) / 2).cast("int")).alias("median"),
        F.avg(value).over(last).alias("window_avg"),
        F.max(value).over(last).alias("window_max"),
        F.col(value).alias("last"),
        F.try_divide(F.col("__s") + F.coalesce(F.sum(own).over(here), F.lit(0.0)), F.col("__c") + F.count(own).over(here)).alias("global_avg"),
        "__own",
    )
    return measured.filter("__own").drop("__own")


def topk_rescored(rows: DataFrame, query: str, score: str, order: list[Column], k: int, rescore: Column, missing: float = -100.0, name: str = "final_score") -> DataFrame:
    """The ``k`` best candidates of each query with a new score added to the old one; the others stay at ``missing``.

    Only ``k`` rows of a query are ranked, before the shuffle too; the others are compared with the last of these. ``order`` must be total
    within a query. Null and NaN scores are worst.
    """
    worst = F.when(F.col(score).isNull() | F.isnan(score), F.lit(float("-inf"))).otherwise(F.col(score))
    placed = rows.withColumn("__o", F.struct((-worst).alias("s"), *(c.alias(f"o{i}") for i, c in enumerate(order))))
    w = Window.partitionBy(query).orderBy("__o")
    last = placed.select(query, "__o").withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).groupBy(query).agg(F.max("__o").alias("__last"))
    best = F.col("__o") <= F.col("__last")
    return spread_join(placed, last, [query]).withColumn(name, F.when(best, F.col(score) + rescore).otherwise(F.lit(missing))).drop("__o", "__last")


def capped_attempts(rows: DataFrame, by: list[str], order: list[Column], done: Column, retries: int = 1) -> DataFrame:
    """The attempts of each group that count: up to the first that is ``done``, and no more than one and ``retries`` further ones. A null ``done`` isn't."""
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = rows.withColumn("__d", F.coalesce(done, F.lit(False))).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= retries + 1)
    before = F.max("__d").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return ranked.withColumn("__b", F.coalesce(before, F.lit(False))).filter("not __b").drop("__d", "__b").withColumnRenamed("__r", "attempt")
