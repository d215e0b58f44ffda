"""Incremental runs: what is new is processed once, and results are merged into a versioned table.

A version ``v=n`` holds the rows of batch n only; every ``WHOLE`` versions a folder ``whole=n`` holds all rows
up to there. So a batch writes what is new, and a reader merges a bounded number of versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators.upserts import last_by
from pairloom.sources.readers import exists


#: Versions after which all rows so far are written as a whole.
WHOLE = 16


def process_new(spark: SparkSession, source: str, schema: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], out: str, key: list[str]) -> StreamingQuery:
    """Run ``step`` on the files that came since the last run and merge its rows by key.

    Each batch writes a version of its own, named by the batch; a repeated batch writes the same version again, so a restart
    neither loses nor doubles. A batch whose predecessor is missing raises, since the table would lose what came before.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if number > 0 and not (exists(spark, f"{out}/v={number - 1}/_SUCCESS") or exists(spark, f"{out}/whole={number - 1}/_SUCCESS")):
            raise FileNotFoundError(f"version {number - 1} of {out} is missing")
        step(batch).write.mode("overwrite").parquet(f"{out}/v={number}")
        if number % WHOLE == WHOLE - 1:
            latest(spark, out, key).write.mode("overwrite").parquet(f"{out}/whole={number}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, key: list[str]) -> DataFrame:
    """The merged table as of now: of each key the row of the latest version. A gap in the versions raises."""
    whole, parts = (sorted(_numbers(spark, out, kind)) for kind in ("whole", "v"))
    if not whole and not parts:
        raise FileNotFoundError(out)
    start = whole[-1] if whole else -1
    parts = [n for n in parts if n > start]
    if parts != list(range(start + 1, start + 1 + len(parts))):
        raise FileNotFoundError(f"of {out} there are versions {parts} after {start} only")
    folders = [(start, f"{out}/whole={start}")] * bool(whole) + [(n, f"{out}/v={n}") for n in parts]
    rows = None
    for n, folder in folders:
        more = spark.read.parquet(folder).withColumn("__v", F.lit(n))
        rows = more if rows is None else rows.unionByName(more, allowMissingColumns=True)
    return last_by(rows, key, [F.col("__v")]).drop("__v")


def _numbers(spark: SparkSession, out: str, kind: str) -> list[int]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/{kind}=*")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return [int(str(s.getPath()).rsplit("=", 1)[1]) for s in found or [] if exists(spark, f"{s.getPath()}/_SUCCESS")]


def count_windows(spark: SparkSession, source: str, schema: str, checkpoint: str, out: str, time: str, by: list[str], value: str, size: str = "1 day", late: str = "2 hours", files: int = 1) -> StreamingQuery:
    """Count what came to ``source`` by time window, ``files`` files at a time, and append windows to ``out`` once they are closed."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    done = windowed_counts(rows, time, by, value, size, late)
    return done.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: list[str], value: str, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums by time window; later rows than ``late`` are dropped once their window is closed."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return stamped.groupBy(F.window("__t", size), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), *by, "n", "total")
