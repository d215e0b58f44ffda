"""Score cutoffs that keep a target share of each group (problem 1).

Method: a mergeable quantile sketch per group gives a bracket that holds the cutoff within the
sketch's rank error; a second pass counts the rows above and inside the bracket, which proves the
bracket right or sends the group round again, and the last pass counts the distinct scores inside
it. The result is exact. Rows are never sorted and no group is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from pairloom.operators.skew import spread_join
from pairloom.session import materialize

#: Ranks at which the sketch is read, and the steps of it by which a bracket is widened. The
#: sketch of this size has a rank error below 0.7 %, so four steps of 0.5 % hold it.
GRID = 200
SKETCH_K = 400
MARGIN = 4
#: A bracket with more rows than this is narrowed by another sketch.
BRACKET_ROWS = 200_000
#: Rounds of sketches; a bracket that ties keep wide for longer is halved by its distinct scores.
MAX_ROUNDS = 12


def fraction_cutoffs(records: DataFrame, targets: DataFrame, by: list[str], score: str = "score", percent: str = "keep_percent") -> tuple[DataFrame, DataFrame]:
    """Cutoffs by group and the records that have a score and a target.

    ``records`` has the group columns ``by`` and a double ``score``; ``targets`` has one row for
    each group with an integer percentage. Returns ``(cutoffs, scored)``. ``cutoffs`` has the
    group, ``percent``, ``records`` (with a score), ``cutoff`` (the highest score c such that the
    records with a score of c or more are at least that percentage), ``kept`` (their number) and
    ``ties`` (those at the cutoff). A group without scores or with a percentage of zero has a null
    cutoff and keeps nothing. Null and NaN scores are no scores; null group values match nothing;
    records of groups without a target are left
    out; of repeated targets the greatest percentage counts.
    """
    aim = targets.groupBy(*by).agg(F.max(percent).cast("bigint").alias("percent"))
    clean = records.filter(F.col(score).isNotNull() & ~F.isnan(score)).withColumnRenamed(score, "__v")
    kept_columns = materialize(spread_join(clean, aim.select(*by), by, "left_semi"), "scored")
    scored = kept_columns.select(*by, "__v")  # the passes below read no more, so other columns can't clash

    sizes = scored.groupBy(*by).agg(F.count("*").alias("records"))
    aim = aim.join(sizes, by, "left").fillna(0, ["records"])
    aim = materialize(aim.withColumn("need", F.expr("(percent * records + 99) div 100")), "need")

    open_ = aim.filter("need > 0").select(*by, "need", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).cast("bigint").alias("above"), F.col("records").alias("inside"))
    closed = None
    margin = MARGIN
    for _ in range(MAX_ROUNDS):
        wide = materialize(_narrow(scored, open_, by, margin), "bracket")
        done = wide.filter(f"right and (inside <= {BRACKET_ROWS} or lo = hi)").drop("right")
        closed = done if closed is None else closed.unionByName(done)
        # A bracket proved wrong starts again from the one before it, with a wider margin.
        again = wide.filter(f"right and inside > {BRACKET_ROWS} and lo < hi").drop("right").unionByName(
            open_.join(wide.filter("not right").select(*by), by, "left_semi")
        )
        open_ = materialize(again, "open")
        if open_.isEmpty():
            break
        margin *= 2
    else:
        halved = _halved(scored, open_, by)
        closed = halved if closed is None else closed.unionByName(halved)

    steps = (
        spread_join(scored, closed, by)
        .filter("__v between lo and hi")
        .groupBy(*by, "__v")
        .agg(F.count("*").alias("ties"), F.first("above").alias("above"), F.first("need").alias("need"))
        .withColumn("kept", F.col("above") + F.sum("ties").over(Window.partitionBy(*by).orderBy(F.desc("__v"))))
        .filter("kept >= need and kept - ties < need")
        .select(*by, F.col("__v").alias("cutoff"), "kept", "ties")
    )
    cutoffs = materialize(
        aim.join(steps, by, "left").select(*by, "percent", "records", "cutoff", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("ties", F.lit(0)).alias("ties")),
        "cutoffs",
    )
    return cutoffs, kept_columns.withColumnRenamed("__v", score)


def _narrow(scored: DataFrame, brackets: DataFrame, by: list[str], margin: int) -> DataFrame:
    """A narrower bracket for each group, its counts, and whether they prove that it holds the cutoff."""
    inside = spread_join(scored, brackets, by).filter("__v between lo and hi")
    ranks = ",".join(f"{i / GRID}D" for i in range(GRID + 1))
    sketch = inside.groupBy(*by).agg(F.expr(f"kll_sketch_agg_double(__v, {SKETCH_K})").alias("s"), *(F.first(c).alias(c) for c in ("need", "lo", "hi", "above", "inside")))
    # Rank from below of the wanted row among those inside the bracket.
    rank = F.expr(f"(1 - (need - above) / inside) * {GRID}")
    bracket = materialize(
        sketch.withColumn("q", F.expr(f"kll_sketch_get_quantile_double(s, array({ranks}))"))
        .withColumn("i", F.floor(rank) - margin)
        .withColumn("j", F.ceil(rank) + margin)
        .select(
            *by,
            "need",
            F.when(F.col("i") <= 0, F.col("lo")).otherwise(F.expr(f"element_at(q, cast(greatest(i, 0) as int) + 1)")).alias("lo"),
            F.when(F.col("j") >= GRID, F.col("hi")).otherwise(F.expr(f"element_at(q, cast(least(j, {GRID}) as int) + 1)")).alias("hi"),
        ),
        "sketch",
    )
    counted = spread_join(scored, bracket, by).groupBy(*by).agg(
        *(F.first(c).alias(c) for c in ("need", "lo", "hi")),
        F.count_if(F.col("__v") > F.col("hi")).alias("above"),
        F.count_if(F.expr("__v between lo and hi")).alias("inside"),
    )
    return counted.withColumn("right", F.expr("above < need and above + inside >= need"))


def _halved(scored: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """Brackets of at most ``BRACKET_ROWS`` distinct scores, by halving these; each round counts the rows above the middle, so it ends and is exact."""
    tied = spread_join(scored, brackets.select(*by, "lo", "hi"), by).filter("__v between lo and hi").groupBy(*by, "__v").agg(F.count("*").alias("ties"))
    tied = materialize(tied, "tied")
    closed, open_ = brackets.limit(0), brackets
    while True:
        inside = spread_join(tied, open_, by).filter("__v between lo and hi")
        middle = inside.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("__v", 0.5, 1000).alias("mid"), *(F.first(c).alias(c) for c in ("need", "lo", "hi", "above", "inside")))
        middle = materialize(middle, "middle")
        closed = closed.unionByName(middle.filter(f"n <= {BRACKET_ROWS}").drop("n", "mid"))
        wide = middle.filter(f"n > {BRACKET_ROWS}").drop("n")
        if wide.isEmpty():
            return closed
        over = spread_join(tied, wide, by).filter("__v between lo and hi").groupBy(*by).agg(F.sum(F.when(F.col("__v") > F.col("mid"), F.col("ties")).otherwise(0)).alias("up"))
        higher = F.col("above") + F.col("up") >= F.col("need")
        open_ = materialize(
            wide.join(over, by).select(*by, "need", F.when(higher, F.col("mid")).otherwise(F.col("lo")).alias("lo"), F.when(higher, F.col("hi")).otherwise(F.col("mid")).alias("hi"), F.when(higher, F.col("above")).otherwise(F.col("above") + F.col("up")).alias("above"), "inside"),
            "half",
        )


def kept_rows(scored: DataFrame, cutoffs: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """The scored records at or above the cutoff of their group."""
    limits = cutoffs.filter("cutoff is not null").select(*by, F.col("cutoff").alias("__cutoff"))
    return spread_join(scored, limits, by).filter(F.col(score) >= F.col("__cutoff")).drop("__cutoff")
