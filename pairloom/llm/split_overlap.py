"""Records of evaluation splits that also occur in training (problem 4).

Method: records are canonicalised (case, punctuation, blanks; the number of the picture), hashed,
and evaluation hashes are joined with training hashes; matches are counted by split and source.
Almost equal captions are found by the same hash join on parts of the word sequence: of two
sequences that become equal by at most two word changes, one of three consecutive parts of the
first occurs unchanged in the second, shifted by two words at most. Candidates are verified by the
edit distance. Equal texts are one class throughout, and only classes are compared; the texts of two words or fewer,
which are all within two changes of each other, are one class more. Counts come from classes and their
sizes; pairs of rows are made where they are asked for, frequent classes in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.functions.text import plain, words
from pairloom.operators.skew import pair_join, spread_join
from pairloom.session import materialize

CHANGES = 2
#: Up to this length sequences are compared by what is left after deletions, beyond it by parts.
SHORT = 4


def picture_number(path: Column) -> Column:
    """The last run of digits in the file name of a path, before its extension, without leading zeros.

    Anything after a ``?``, outer blanks, folders (with either slash) and the extension don't
    count. No digits give null; only zeros give ``0``.
    """
    name = F.regexp_replace(F.trim(F.regexp_replace(path, r"(?s)\?.*$", "")), r"(?s)^.*[/\\]", "")
    stem = F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", "")
    digits = F.regexp_extract(stem, r"(?s)([0-9]+)[^0-9]*$", 1)
    return F.when(digits != "", F.regexp_replace(digits, r"^0+(?=.)", ""))


def coded(seq: Column, seed: int) -> Column:
    """A word sequence as a string with one character per word, of 2**19 that are hashed from the words."""
    code = F.transform(seq, lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(F.lit(seed), w), F.lit(1 << 19)) + F.lit(0x20000)), 8, "0"))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")


def _left_after_deletions(code: Column) -> Column:
    """The strings left when at most two characters of a string of at most ``SHORT`` are deleted."""
    out = [code]
    for i in range(SHORT):
        one = F.concat(F.substring(code, 1, i), F.substring(code, i + 2, SHORT))
        out.append(F.when(F.length(code) > i, one))
        for j in range(i, SHORT - 1):
            two = F.concat(F.substring(one, 1, j), F.substring(one, j + 2, SHORT))
            out.append(F.when(F.length(code) > j + 1, two))
    # Of two sequences of which one has more than CHANGES words, something is left.
    return F.array_distinct(F.filter(F.array(*[F.concat(F.lit("d"), x) for x in out]), lambda x: x.isNotNull() & (x != "d")))


def _part(i: int, length: Column) -> tuple[Column, Column]:
    """Start (from 0) and size of part ``i`` of three parts of a sequence."""
    size = F.floor((length + i) / 3).cast("int")
    before = sum((F.floor((length + k) / 3) for k in range(i)), F.lit(0)).cast("int")
    return before, size


def _own_parts(code: Column) -> Column:
    """The three parts of a sequence, each marked with the length and the part's place."""
    n = F.length(code)
    parts = []
    for i in range(3):
        at, size = _part(i, n)
        parts.append(F.concat_ws(":", n.cast("string"), F.lit(str(i)), F.substring(code, at + 1, size)))
    return F.when(n >= 3, F.array(*parts)).otherwise(F.array().cast("array<string>"))


def _other_parts(code: Column) -> Column:
    """What ``_own_parts`` of any sequence within two changes can be, among the parts of this one.

    With the length differing by d, part 0 starts where it would (nothing can be added or dropped
    before it without two more changes elsewhere), the last part is shifted by d, and the middle
    one by -1..1 as well as d-1..d+1.
    """
    n = F.length(code)
    out = []
    for d in range(-CHANGES, CHANGES + 1):  # this sequence is longer by d
        length = n - d
        for i in range(3):
            at, size = _part(i, length)
            shifts = [0] if i == 0 else [d] if i == 2 else [s for s in range(-1, 2) if abs(s - d) <= 1]
            for s in shifts:
                fits = (length >= 3) & (at + s >= 0) & (at + s + size <= n)
                out.append(F.when(fits, F.concat_ws(":", length.cast("string"), F.lit(str(i)), F.substring(code, at + s + 1, size))))
    return F.array_distinct(F.filter(F.array(*out), lambda x: x.isNotNull()))


class Overlap:
    """Which held-out rows overlap with training rows: same picture number or almost the same text.

    Null paths and texts match nothing, a text without words matches texts of at most two words.
    Split names compare without case and outer blanks; rows of other splits take no part. Exact
    repeats of a row, id included, count once. Empty tables give no rows.

    ``base`` has id, held, number and the class of the text (c1, c2, ``tiny`` for two words or fewer); ``links`` has the
    pairs of a training class (c1, c2) and a held-out class (d1, d2) within two changes, each once, but for pairs of tiny ones.
    """

    def __init__(self, rows: DataFrame, key: str, path: str, text: str, split: str, train: str = "train", held: tuple[str, ...] = ("validation", "test")):
        base = rows.select(F.col(key).alias("id"), picture_number(F.col(path)).alias("number"), words(F.col(text)).alias("seq"), plain(F.col(split)).alias("split"))
        base = base.filter(F.col("split").isin(train, *held)).withColumn("held", F.col("split") != train)
        base = base.select("id", "held", "number", coded("seq", 1).alias("c1"), coded("seq", 2).alias("c2")).distinct()
        self.base = materialize(base.withColumn("tiny", F.coalesce(F.length("c1") <= CHANGES, F.lit(False))), "canonical")
        self.links = materialize(self._links(), "links")

    def _links(self) -> DataFrame:
        # One row per distinct sequence; c1 and c2 together are its identity.
        classes = materialize(self.base.filter("c1 is not null").groupBy("c1", "c2").agg(F.max("held").alias("in_held"), F.min("held").alias("only_held")), "classes")
        left = classes.filter("not only_held").select("c1", "c2")
        right = classes.filter("in_held").select(F.col("c1").alias("d1"), F.col("c2").alias("d2"))
        short = lambda df, c: df.filter(F.length(c) <= SHORT).withColumn("part", F.explode(_left_after_deletions(F.col(c))))
        parts = materialize(left.withColumn("part", F.explode(_own_parts(F.col("c1")))).unionByName(short(left, "c1")), "parts")
        probes = materialize(right.withColumn("part", F.explode(_other_parts(F.col("d1")))).unionByName(short(right, "d1")), "probes")
        return (
            pair_join(parts, probes, ["part"], "c1", "d1")
            .filter(f"(length(c1) > {CHANGES} or length(d1) > {CHANGES}) and levenshtein(c1, d1, {CHANGES}) >= 0 and levenshtein(c2, d2, {CHANGES}) >= 0")
            .select("c1", "c2", "d1", "d2")
            .distinct()
        )

    def _side(self, held: bool, condition: str = "true") -> DataFrame:
        return self.base.filter(("" if held else "not ") + f"held and {condition}")

    def pairs(self) -> DataFrame:
        """All pairs ``(train_id, held_id)``, each once: pairs of equal texts, too, come from the classes, so only pairs with the same number have to be told apart from them."""
        named = lambda held, name, number, *keys: self._side(held, "c1 is not null").select(F.col("id").alias(name), F.col("number").alias(number), *keys)
        same_picture = pair_join(
            self._side(False, "number is not null").select(F.col("id").alias("train_id"), "number"), self._side(True, "number is not null").select(F.col("id").alias("held_id"), "number"), ["number"], "train_id", "held_id"
        ).select("train_id", "held_id")
        train = named(False, "train_id", "m", "c1", "c2", "tiny")
        held = named(True, "held_id", "n", F.col("c1").alias("d1"), F.col("c2").alias("d2"), "tiny")
        one = pair_join(self.links, train.drop("tiny"), ["c1", "c2"], "d1", "train_id").select("d1", "d2", "train_id", "m")
        linked = pair_join(one, held.drop("tiny"), ["d1", "d2"], "train_id", "held_id")
        tiny = pair_join(train.filter("tiny").select("train_id", "m", "tiny"), held.filter("tiny").select("held_id", "n", "tiny"), ["tiny"], "train_id", "held_id")
        same_text = linked.select("train_id", "held_id", "m", "n").unionByName(tiny.select("train_id", "held_id", "m", "n"))
        return same_picture.unionByName(same_text.filter("m is null or n is null or m <> n").select("train_id", "held_id"))

    def row_counts(self) -> DataFrame:
        """``(held_id, pairs)`` of the held-out rows that overlap, by counting classes; no pair is made."""
        count = F.count("*").alias("k")
        train, held = self._side(False), self._side(True)
        numbers = train.filter("number is not null").groupBy("number").agg(count)
        texts = train.filter("c1 is not null").groupBy("c1", "c2").agg(count)
        both = train.filter("c1 is not null and number is not null").groupBy("c1", "c2", "number").agg(count)
        links = spread_join(self.links, texts, ["c1", "c2"]).groupBy("d1", "d2").agg(F.sum("k").alias("k"))
        link_both = pair_join(self.links, both, ["c1", "c2"], "d1", "number").groupBy("d1", "d2", "number").agg(F.sum("k").alias("k"))
        tiny = train.filter("tiny").agg(count).first()["k"]
        tiny_both = train.filter("tiny and number is not null").groupBy("number").agg(count)
        as_held = lambda df: df.withColumnsRenamed({"d1": "c1", "d2": "c2"})
        out = spread_join(held, numbers.withColumnRenamed("k", "same_number"), ["number"], "left")
        out = spread_join(out, as_held(links).withColumnRenamed("k", "same_text"), ["c1", "c2"], "left")
        out = spread_join(out, as_held(link_both).withColumnRenamed("k", "same_both"), ["c1", "c2", "number"], "left")
        out = spread_join(out, tiny_both.withColumnRenamed("k", "tiny_both"), ["number"], "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        total = zero("same_number") + zero("same_text") - zero("same_both") + F.when(F.col("tiny"), F.lit(tiny) - zero("tiny_both")).otherwise(0)
        return out.select(F.col("id").alias("held_id"), total.cast("bigint").alias("pairs")).filter("pairs > 0")


def overlap_counts(overlap: Overlap, rows: DataFrame, key: str, split: str, source: str) -> DataFrame:
    """By split and source of the held-out row: how many rows overlap with training, and in how many pairs."""
    named = rows.select(F.col(key).alias("held_id"), plain(F.col(split)).alias("split"), plain(F.col(source)).alias("source"))
    return overlap.row_counts().join(named, "held_id").groupBy("split", "source").agg(F.count("*").alias("overlapping_rows"), F.sum("pairs").alias("pairs"))
