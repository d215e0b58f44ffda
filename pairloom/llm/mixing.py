"""Mixing sources to target shares of tokens (problem 8).

Method: hash-threshold histograms. Tokens are summed by source and by the leading bits of a hash
of the record; the budget of a source falls into one bucket, only that bucket is split by further
bits, until the threshold is exact; records are then kept by comparing their hash with it. Nothing
is sorted, and a smaller budget always keeps a subset of a larger one's records.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pairloom.functions.text import plain
from pairloom.operators.skew import within
from pairloom.session import dealt_out, materialize

#: Default vocabulary; any file of ranks in the same format may be named instead.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's tokenizer cuts a text before it merges bytes. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BITS = 8
MAX_SOURCES = 1_000

_encoders: dict[tuple[int, str], object] = {}


def _encoder(ranks: bytes, pattern: str):
    """The tokenizer of a file of ranks, built once per Python worker."""
    import tiktoken

    name = (zlib.crc32(ranks), pattern)
    if name not in _encoders:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[name] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encoders[name]


def token_counts(docs: DataFrame, text: str, keep: list[str], ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``keep`` columns and ``tokens`` of each text; a null text has none. The file is read on the driver and sent to the tasks."""
    with open(ranks, "rb") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            encode = _encoder(lines.value, pattern).encode_ordinary
            yield b[keep].assign(tokens=pd.Series([len(encode(x)) if x else 0 for x in b[text]], index=b.index, dtype="int64"))

    schema = docs.select(*keep).schema.add("tokens", "long")
    return docs.select(*keep, text).mapInPandas(run, schema)


def mix(docs: DataFrame, targets: DataFrame, key: str, text: str, source: str = "source", percent: str = "target_percent", repeats: str = "max_repeats", ranks: str = RANKS, size: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(mixture, report)``.

    The mixture has as many tokens as all documents with a source, as far as the shares can be
    reached: a source gets ``percent`` % of them. Each of its documents is taken ``whole`` times,
    and one time more if its hash is below the source's threshold; if even ``repeats`` times all
    its documents are too few, it gets that and falls short. ``mixture``: key, source, times.
    ``report`` per target: source, tokens, documents, target_tokens, mixed_tokens, short (whether
    max_repeats * tokens is less than the target). Sources compare without case and outer blanks;
    documents without a source take no part, those of a source without a target only count
    towards the total. A null text has no tokens and is not taken. ``size`` may name a column of sizes to be used instead of tokens.
    """
    if not within(targets, MAX_SOURCES):
        raise ValueError(f"more than {MAX_SOURCES} targets")
    spark = docs.sparkSession
    named = docs.withColumn("__s", plain(F.col(source))).filter("__s is not null and __s <> ''")
    counted = materialize(
        (token_counts(dealt_out(named), text, [key, "__s"], ranks) if size is None else named.select(key, "__s", F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("tokens"))).withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col(key).cast("string")), 1)),
        "tokens",
    )
    aims = {r["s"]: (r["p"], r["m"]) for r in targets.select(plain(F.col(source)).alias("s"), F.col(percent).alias("p"), F.col(repeats).alias("m")).collect() if r["s"]}
    per_source = counted.groupBy("__s").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    total = per_source.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()["t"]
    sizes = {r["__s"]: (r["t"], r["n"]) for r in per_source.filter(F.col("__s").isin(list(aims))).collect()}  # one row per target at most

    plan: dict[str, tuple[int, int]] = {}  # whole times, budget left
    for s, (p, m) in aims.items():
        have = sizes.get(s, (0, 0))[0]
        want = total * p // 100
        if not have:
            plan[s] = (0, 0)
        elif m * have <= want:
            plan[s] = (m, 0)
        else:
            plan[s] = divmod(want, have)
    limits = _thresholds(counted, {s: rest for s, (_, rest) in plan.items() if rest > 0})

    rule = spark.createDataFrame([(s, int(w), limits.get(s, (0, 0))[0]) for s, (w, _) in plan.items()], "__s string, whole int, below bigint")
    mixture = (
        counted.filter("tokens > 0")
        .join(F.broadcast(rule), "__s")  # one row per target, checked above
        .withColumn("times", F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0))
        .filter("times > 0")
        .select(key, F.col("__s").alias(source), F.col("times").cast("int").alias("times"), "tokens")
    )
    rows = []
    for s, (p, m) in aims.items():
        have, n = sizes.get(s, (0, 0))
        rows.append((s, have, n, total * p // 100, plan[s][0] * have + limits.get(s, (0, 0))[1], 100 * m * have < p * total))
    report = spark.createDataFrame(rows, f"{source} string, tokens bigint, documents bigint, target_tokens bigint, mixed_tokens bigint, short boolean")
    return mixture, report


def shares(mixture: DataFrame, report: DataFrame, source: str = "source") -> DataFrame:
    """The report of what the mixture holds: its tokens and share by source, counted in the mixture itself.

    A source is short if its documents were all taken as often as they may be and still have less than its target.
    """
    made = mixture.groupBy(source).agg(F.sum(F.col("tokens") * F.col("times")).alias("mixed"), F.min("times").alias("least"), F.max("times").alias("most"), F.sum("tokens").alias("taken"))
    made = materialize(made, "mixed")
    whole = made.agg(F.sum("mixed")).first()[0]
    full = F.col("mixed").isNull() | ((F.col("least") == F.col("most")) & (F.col("taken") == F.col("tokens")))
    return (
        report.join(made, source, "left")
        .select(source, "tokens", "documents", "target_tokens", F.coalesce("mixed", F.lit(0)).alias("mixed_tokens"), (full & F.col("short")).alias("short"))
        .withColumn("share", F.try_divide(F.col("mixed_tokens"), F.lit(whole)))
    )


def _thresholds(counted: DataFrame, budgets: dict[str, int]) -> dict[str, tuple[int, int]]:
    """For each source the largest hash threshold whose records fit the budget, and their tokens.

    Each round collects ``2**BITS`` sums per source at most. A boundary bucket is split until
    it holds one record or one hash value, which takes eight rounds at most.
    """
    base = {s: 0 for s in budgets}  # threshold so far: all hashes below it fit
    used = {s: 0 for s in budgets}
    open_ = set(budgets)
    spark = counted.sparkSession
    shift = 63
    while open_ and shift > 0:
        step = min(BITS, shift)
        width, shift = 1 << shift, shift - step
        now = spark.createDataFrame([(s, base[s], base[s] + (width - 1)) for s in open_], "__s string, lo bigint, hi bigint")
        sums = (
            counted.join(F.broadcast(now), "__s")  # one row per target, whose number is checked
            .filter("h between lo and hi")
            .groupBy("__s", F.shiftrightunsigned(F.col("h") - F.col("lo"), shift).alias("bucket"))
            .agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
            .collect()
        )
        by: dict[str, dict[int, tuple[int, int]]] = {}
        for r in sums:
            by.setdefault(r["__s"], {})[int(r["bucket"])] = (r["t"], r["n"])
        for s in list(open_):
            for bucket, (t, n) in sorted(by.get(s, {}).items()):
                if used[s] + t > budgets[s]:
                    base[s] += bucket << shift
                    if n == 1:
                        open_.discard(s)
                    break
                used[s] += t
            else:
                open_.discard(s)
    return {s: (base[s], used[s]) for s in base}
