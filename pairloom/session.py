"""Session construction and the shared scratch area."""

from __future__ import annotations

import atexit
import logging
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "pairloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Let the session's Python workers import this package, wherever the driver found it; once per session.

    The driver serves the archive to the executors, which keep their own copies.
    """
    context = spark.sparkContext
    if getattr(context, "_pairloom_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="pairloom-"), "pairloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in sorted(os.walk(home)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("pairloom", os.path.relpath(path, home)))
    context.addPyFile(archive)
    context._pairloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where the setting is absent a local session gets a temporary folder; a cluster session
    raises, since a machine-local folder would not survive the loss of an executor.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(?:\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="pairloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted by ``release`` or when the driver ends."""
    path = f"{shared_dir(spark)}/pairloom/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(release, spark)
    _scratch.append(path)
    return path


_scratch: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete all scratch tables so far. What was read from them and isn't written elsewhere can't be read again."""
    if spark.sparkContext._jsc is None:  # the session has ended, and with it the way to its files
        logging.getLogger(__name__).info("%d scratch tables stay in the shared folder", len(_scratch))
        _scratch.clear()
    while _scratch:
        _delete(spark, _scratch.pop())


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    The scan has no lineage before the files, so a lost executor costs a re-read, not the
    work before it, and several readers share one computation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt_out(df: DataFrame) -> DataFrame:
    """``df`` on as many tasks as there are cores, if a scan has fewer; for costly work on each row. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception as e:  # the driver may be ending; what is left in the shared folder must not hide another error
        logging.getLogger(__name__).warning("could not delete %s: %s", path, e)
