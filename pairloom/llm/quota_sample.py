"""A sample whose categories have given shares (problem 2).

Method: inclusion probabilities come from calibration by exponential tilting on the totals of cells and of
their margins, solved by Newton iterations on its dual over moments that are aggregated distributedly: all records of a cell have the same
moments, so one aggregation by cell gives those of every iteration. The sample is then
drawn with exactly these probabilities by the pivotal method, run inside hash blocks and again on
the one undecided record that each block leaves, until one block per cell is left and then one over the cells. Floors are
fixed before the tilting, and cells of which fewer records were drawn than they need are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.operators.skew import spread_join, within
from pairloom.session import materialize

#: Records that one task decides at a time.
BLOCK_ROWS = 20_000
#: Cells of the target table are solved on the driver; more of them are refused.
MAX_CELLS = 100_000


def _conjugate_gradient(apply, g: np.ndarray, rounds: int) -> np.ndarray:
    """A solution of ``apply(x) = g`` for a symmetric positive operator."""
    x, r = np.zeros_like(g), g.copy()
    d, rr = r.copy(), float(r @ r)
    least = 1e-20 * rr
    for _ in range(rounds):
        if rr <= least:
            break
        ad = apply(d)
        curve = float(d @ ad)
        if curve <= 1e-300:
            break
        x += rr / curve * d
        r -= rr / curve * ad
        rr, old = float(r @ r), rr
        d = r + rr / old * d
    return x


def tilted_probabilities(sizes: np.ndarray, groups: list[np.ndarray], wanted: np.ndarray, rate: float, least: np.ndarray | None = None, tol: float = 1e-9, rounds: int = 300) -> np.ndarray:
    """Inclusion probabilities of cells by exponential tilting: the moments of all groups are met.

    ``groups`` has, for each margin, the number of the group that each cell belongs to in it; ``wanted`` the moment of each
    group. p = least + (1 - least) * q with q = min(1, rate * exp(t of the cell's groups, summed)), and
    the t maximise the concave dual ``sum(t * wanted) - sum(sizes * (least * s + (1 - least) * phi(s)))`` with s the cell's sum and phi' = q.
    Newton's method: gradient wanted - moments; the Hessian couples groups that share cells, and its system is solved by
    conjugate gradients, without a matrix and although margins are redundant; steps are halved until the dual grows. Wanted
    moments must be within reach, but may be on its edge.
    """
    least = np.zeros(len(sizes)) if least is None else least
    k = len(wanted)
    edge = -np.log(rate)
    up = lambda t: sum((t[g] for g in groups), np.zeros(len(sizes)))
    down = lambda v: sum((np.bincount(g, v, k) for g in groups), np.zeros(k))
    q_of = lambda s: np.exp(np.minimum(s - edge, 0.0))
    dual = lambda t, s: float(t @ wanted - (sizes * (least * s + (1 - least) * np.where(s < edge, q_of(s), 1 + s - edge))).sum())
    t = np.zeros(k)
    for _ in range(rounds):
        s = up(t)
        q = q_of(s)
        gradient = wanted - down(sizes * (least + (1 - least) * q))
        if np.abs(gradient).max(initial=0.0) <= tol * max(1.0, wanted.max(initial=0.0)):
            break
        # Cells at their edge keep a little of their weight, so that they can come back.
        weight = sizes * (1 - least) * q * np.where(s < edge, 1.0, 1e-6)
        ridge = 1e-9 * down(weight).max(initial=1e-300)  # for redundant margins, along which rounding would run away
        step = _conjugate_gradient(lambda v: down(weight * up(v)) + ridge * v, gradient, 4 * k + 50)
        far = np.abs(up(step)).max(initial=0.0)
        step *= min(1.0, 2.0 / far) if far else 1.0
        now = dual(t, s)
        while dual(t + step, up(t + step)) < now and np.abs(step).max() > 1e-14:
            step /= 2
        t += step
    return least + (1 - least) * q_of(up(t))


def pivotal(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Outcome of the sequential pivotal method: 0, 1, or for at most one unit the probability left over.

    ``p`` are probabilities in (0, 1), ``u`` uniform numbers, one for each duel.
    """
    out = np.zeros(len(p))
    held, at = p[0], 0
    for i in range(1, len(p)):
        total = held + p[i]
        if total < 1:  # one of both leaves, the other carries the sum
            if u[i] * total < p[i]:
                at = i
            held = total
        else:  # one of both is taken, the other carries the rest
            rest = total - 1
            if u[i] * (2 - total) < 1 - p[i]:
                out[at], at = 1, i
            else:
                out[i] = 1
            held = rest
    out[at] = held
    return out


def _duel(seed: int, final: bool = False):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["__cell", "__h", "__id"] if final else ["__h", "__id"], kind="stable")
        p = block["__p"].to_numpy(dtype=float)
        u = np.random.default_rng(abs(int(block["__h"].iloc[0])) + seed).random(len(p))
        out = pivotal(p, u)
        out[np.abs(out - 1) < 1e-6] = 1.0
        out[out < 1e-6] = 0.0
        block = block.assign(__p=out)
        return block[block["__p"] > 0][["__id", "__cell", "__p", "__h"]]

    return run


def quota_report(cells: DataFrame, sample: DataFrame, by: list[str]) -> DataFrame:
    """``cells`` with the number drawn from each; a cell with fewer than its need is a gap."""
    drawn = sample.groupBy(*by).agg(F.count("*").alias("drawn"))
    return cells.join(drawn, by, "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))


def quota_cells(records: DataFrame, targets: DataFrame, by: list[str], share: int = 10, permille: str = "target_permille", floor: str = "min_rows") -> DataFrame:
    """For each target row: records, floor, need, shortfall.

    With S the number of all records divided by ``share``, rounded down, a row needs the greater
    of its floor and S * permille / 1000, rounded down. Target rows with a null group are kept
    and hold no records; of repeated target rows the one with the greatest need counts.
    """
    sizes = materialize(records.groupBy(*by).agg(F.count("*").alias("records")), "cells")
    total = sizes.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first()["n"] // share
    aim = targets.groupBy(*by).agg(F.max(permille).cast("bigint").alias("permille"), F.max(floor).cast("bigint").alias("floor"))
    return (
        aim.join(sizes, by, "left")
        .select(
            *by,
            F.coalesce("records", F.lit(0)).alias("records"),
            F.coalesce("floor", F.lit(0)).cast("bigint").alias("floor"),
            F.expr(f"greatest(floor, ({total}L * permille) div 1000)").alias("need"),
        )
        .withColumn("shortfall", F.expr("greatest(need - records, 0)"))
    )


def quota_sample(records: DataFrame, cells: DataFrame, by: list[str], key: str, seed: int = 7, margins: list[list[str]] | None = None) -> DataFrame:
    """The records drawn: ``key`` and the group.

    ``margins`` are the groupings whose totals are calibrated. By default these are each column of ``by`` and the cells themselves, so
    that a cell gives ``need`` records, or all it holds. With coarser margins a cell gives what the tilting
    makes of them, but ``floor`` records, or all it holds, at least; a margin's total is the sum of what its cells were asked for, as far as
    they hold it, and is met but for the one record that rounding may cost.
    ``records`` has ``key`` once. The draw depends on key and seed only, not on partitioning. No
    cells or no records give no rows. More than ``MAX_CELLS`` cells raise, since they are solved on the driver.
    """
    spark = records.sparkSession
    if not within(cells, MAX_CELLS):
        raise ValueError(f"more than {MAX_CELLS} target cells")
    margins = [*([c] for c in by), by] if margins is None else margins
    known = cells.filter("records > 0 and need > 0").select(*by, "records", "floor", "need").toPandas().sort_values(by).reset_index(drop=True)
    sizes = known["records"].to_numpy(dtype=float)
    aim = np.minimum(known["need"].to_numpy(dtype=float), sizes)
    rate = min(1.0, aim.sum() / max(sizes.sum(), 1.0)) or 1.0
    groups, wanted, at = [], [], 0
    for margin in margins:
        number = known.groupby(margin, sort=True).ngroup().to_numpy() if len(known) else np.zeros(0, int)
        groups.append(number + at)
        wanted.append(np.bincount(number, aim) if len(known) else np.zeros(0))
        at += len(wanted[-1])
    least = np.minimum(known["floor"].to_numpy(dtype=float), sizes) / np.maximum(sizes, 1.0)
    p = tilted_probabilities(sizes, groups, np.concatenate(wanted), rate, least) if len(known) else np.zeros(0)
    whole = np.round(sizes * p)
    known["__p"] = np.where(np.abs(sizes * p - whole) < 1e-4, whole / np.maximum(sizes, 1.0), p)  # what is whole but for the solver's tolerance
    known["__cell"] = range(len(known))
    known["__blocks"] = np.maximum(1, np.ceil(sizes / BLOCK_ROWS)).astype("int64") if len(known) else []
    schema = records.select(*by).schema.add("__p", "double").add("__cell", "long").add("__blocks", "long")
    plan = spark.createDataFrame([tuple(x) for x in known[[*by, "__p", "__cell", "__blocks"]].astype(object).to_numpy().tolist()], schema)

    drawn = materialize(
        spread_join(records.select(key, *by), plan, by).select(
            F.col(key).alias("__id"), *by, "__cell", "__p", "__blocks", F.xxhash64(F.lit(seed), F.col(key).cast("string")).alias("__h")
        ),
        "drawn",
    )
    taken = drawn.filter("__p >= 1").select("__id", "__cell")
    parts = drawn.filter("__p < 1 and __p > 0")
    blocks = int(known["__blocks"].max()) if len(known) else 1
    width = BLOCK_ROWS
    kind = f"__id {records.schema[key].dataType.simpleString()}, __cell bigint, __p double, __h bigint"
    part = parts.withColumn("__b", F.pmod("__h", "__blocks")).select("__id", "__cell", "__p", "__h", "__b")
    while True:
        out = materialize(part.groupBy("__cell", "__b").applyInPandas(_duel(seed), kind), "pivotal")
        taken = taken.unionByName(out.filter("__p >= 1").select("__id", "__cell"))
        if blocks <= 1:
            break
        # Each block leaves one undecided record at most; these meet in fewer blocks.
        blocks = -(-blocks // width)
        part = out.filter("__p < 1").withColumn("__b", F.pmod(F.xxhash64("__h"), F.lit(blocks)))
    # One undecided record of a cell at most is left; these, as many as cells at most, meet cell by cell, so that margins keep their totals.
    last = out.filter("__p < 1").withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(_duel(seed, final=True), kind)
    taken = taken.unionByName(last.filter("__p >= 0.5").select("__id", "__cell"))
    return spread_join(taken, plan.select("__cell", *by), ["__cell"]).select(F.col("__id").alias(key), *by)
