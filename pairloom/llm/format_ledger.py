"""Duplicates hidden by formatting: an incremental ledger of canonical keys (problem 5).

Method: a ledger on the shared folder holds one row per canonical key with its count and its earliest representative,
in hash buckets. Each batch is aggregated by key (combined before the shuffle), then full-outer-joined
with the matching buckets: with what came to them since they were last compacted, and with the
whole bucket once that has become a large part of it. So a small batch writes little, and each entry is
written again a bounded number of times while its bucket grows. Later sessions open the ledger by its path.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairloom.functions.text import letters_digits
from pairloom.operators.skew import hot_split_join
from pairloom.session import materialize, scratch_path

#: Entries of a bucket that a new ledger is laid out for.
BUCKET_ROWS = 1_000_000
#: Part of a bucket's entries from which on what came to it is merged into it.
COMPACT = 0.25


def canonical_key(text: Column, members: Column) -> Column:
    """128-bit key of a text and an unordered bag of texts, each reduced to letters and digits without case.

    A null bag is empty, a null member is an empty text, a null text gives a null key. Every part
    is hashed to a fixed length first, so parts can't run into each other; keys of different
    records agree with probability 2**-128.
    """
    part = lambda c: F.md5(F.coalesce(letters_digits(c), F.lit("")))
    bag = F.array_sort(F.transform(F.coalesce(members, F.array().cast("array<string>")), part))
    return F.when(text.isNotNull(), F.unhex(F.md5(F.concat(part(text), F.lit("|"), F.array_join(bag, ",")))))


class Ledger:
    """Counts of canonical keys that grow batch by batch, at a path that later sessions open again.

    Entries: ``bucket``, ``key``, ``copies``, ``keep`` (smallest order value seen). Files are partitioned by bucket. Every update
    writes new files and then, as its last step, a new manifest that points to them, so a
    failed update leaves the ledger as it was and may be repeated. A batch that comes with a name is
    added once, however often it is given. One writer at a time: a second one that started from the same manifest raises.
    """

    def __init__(self, spark: SparkSession, path: str, order_type: str = "bigint", rows: int = 0):
        """Open the ledger at ``path``, or lay out a new one for about ``rows`` entries."""
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        hadoop = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = self._manifests()
        if found:
            self.version = found[-1]
            self.state = json.loads(spark.read.text(self._manifest(self.version), wholetext=True).first()[0])
        else:
            self.version = 0
            self.state = {"buckets": max(1, -(-rows // BUCKET_ROWS)), "order": order_type, "base": {}, "delta": {}, "batches": []}
        self.schema = f"key binary, copies bigint, keep {self.state['order']}, bucket int"

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/{version:08d}.json"

    def _manifests(self) -> list[int]:
        folder = self._at(f"{self.path}/manifest")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _commit(self) -> None:
        at, draft = self._at(self._manifest(self.version + 1)), self._at(f"{self.path}/manifest/{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        if self._fs.exists(at) or not self._fs.rename(draft, at):
            raise RuntimeError(f"another writer has changed the ledger at {self.path}")
        self.version += 1

    def _entries(self, level: str, buckets: list[int]) -> DataFrame:
        """The entries of a level in the given buckets; only their folders are read."""
        by_folder: dict[str, list[int]] = {}
        for bucket in buckets:
            if at := self.state[level].get(str(bucket)):
                by_folder.setdefault(at[0], []).append(bucket)
        out = self.spark.createDataFrame([], self.schema)
        for folder, held in by_folder.items():
            out = out.unionByName(self.spark.read.schema(self.schema).option("basePath", folder).parquet(*(f"{folder}/bucket={b}" for b in held)))
        return out

    def _write(self, level: str, entries: DataFrame) -> None:
        """Write a level of the buckets that ``entries`` has, and note where and how many."""
        folder = f"{self.path}/{level}-{self.version + 1:08d}-{uuid.uuid4().hex[:8]}"
        entries.select("key", "copies", "keep", "bucket").repartition(self.state["buckets"], "bucket").write.partitionBy("bucket").parquet(folder)
        sizes = self.spark.read.schema(self.schema).parquet(folder).groupBy("bucket").count().collect()  # a row per bucket at most
        self.state[level] |= {str(r["bucket"]): [folder, r["count"]] for r in sizes}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The entries of the given buckets, or of all."""
        wanted = sorted({int(b) for level in ("base", "delta") for b in self.state[level]}) if buckets is None else buckets
        changed = [b for b in wanted if str(b) in self.state["delta"]]
        same = [b for b in wanted if str(b) not in self.state["delta"]]
        return self._entries("base", same).unionByName(_added(self._entries("base", changed), self._entries("delta", changed)))

    def update(self, batch: DataFrame, key: str, order: str, name: str | None = None) -> None:
        """Add a batch of rows. Rows with a null key are no records and are left out."""
        if name is not None and name in self.state["batches"]:
            return
        fresh = materialize(
            batch.filter(F.col(key).isNotNull())
            .groupBy(F.col(key).alias("key"))
            .agg(F.count("*").alias("copies"), F.min(order).alias("keep"))
            .withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.state["buckets"])).cast("int")),
            "batch",
        )
        before = json.dumps(self.state)
        try:
            touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())  # as many as there are buckets at most
            if touched:
                self._write("delta", _added(self._entries("delta", touched), fresh))
                full = [b for b in touched if self.state["delta"][str(b)][1] > COMPACT * self.state["base"].get(str(b), [None, 0])[1]]
                if full:
                    self._write("base", _added(self._entries("base", full), self._entries("delta", full)))
                    for b in full:
                        del self.state["delta"][str(b)]
            if name is not None:
                self.state["batches"].append(name)
            self._commit()
        except BaseException:
            self.state = json.loads(before)
            raise

    def vacuum(self) -> None:
        """Delete the files and manifests that the newest manifest doesn't point to. No other session may be reading an older one."""
        held = {at[0].rsplit("/", 1)[1] for level in ("base", "delta") for at in self.state[level].values()}
        for f in self._fs.listStatus(self._at(self.path)):
            if (name := f.getPath().getName()) != "manifest" and name not in held:
                self._fs.delete(f.getPath(), True)
        for f in self._fs.listStatus(self._at(f"{self.path}/manifest")):
            if f.getPath().getName() != f"{self.version:08d}.json":
                self._fs.delete(f.getPath(), False)


def _added(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both sets of entries in one, counts added, the earliest representative kept."""
    a, b = old.alias("a"), new.alias("b")
    return a.join(b, F.col("a.key") == F.col("b.key"), "full_outer").select(
        F.coalesce("a.key", "b.key").alias("key"),
        (F.coalesce("a.copies", F.lit(0)) + F.coalesce("b.copies", F.lit(0))).alias("copies"),
        F.least("a.keep", "b.keep").alias("keep"),
        F.coalesce("a.bucket", "b.bucket").alias("bucket"),
    )


def collapse(rows: DataFrame, key: str, order: str, batches: list[Column], path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run ``rows`` through a ledger, one update per batch condition; returns (entries, copies).

    ``entries`` has key, copies, keep; ``copies`` has keep and the order value of each further
    member of a group. Conditions must split the rows; a row with a null condition belongs to
    no batch, so give a last condition that takes what is left. The ledger is a new one at ``path``, by default
    a scratch one. Groups are never gathered: the
    entries of keys with a large share of the rows are broadcast, all others join by shuffle.
    """
    keyed = materialize(rows, "keyed")
    spark = rows.sparkSession
    ledger = Ledger(spark, path or scratch_path(spark, "ledger"), rows.schema[order].dataType.simpleString(), keyed.count())
    for condition in batches:
        ledger.update(keyed.filter(condition), key, order)
    entries = materialize(ledger.read().select(F.col("key").alias(key), "copies", "keep"), "entries")
    several = entries.filter("copies > 1")
    copies = hot_split_join(keyed.filter(F.col(key).isNotNull()).select(key, order), several, key, "copies").filter(F.col(order) != F.col("keep"))
    return entries, copies.select("keep", F.col(order).alias("copy"))
