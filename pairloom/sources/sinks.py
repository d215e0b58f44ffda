"""Writers of the exported formats. A job's commit makes its output appear at once, so there are no locks or backup copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairloom.functions.captions import CATEGORIES


def json_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def json_by_category(rows: DataFrame, path: str, category: str = "category", known: list[str] = CATEGORIES) -> None:
    """JSON lines in one folder per known category."""
    rows.filter(F.col(category).isin(known)).write.mode("overwrite").partitionBy(category).json(path)


def tsv_by_category(rows: DataFrame, path: str, category: str = "category", known: list[str] = CATEGORIES) -> None:
    """Tab-separated files with header and without quoting, one folder per known category. Tabs and line ends inside values become blanks, as nothing could quote them."""
    flat = rows.select([F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]", " ").alias(c) for c in rows.columns])
    flat.filter(F.col(category).isin(known)).write.mode("overwrite").partitionBy(category).option("sep", "\t").option("header", True).option("quote", "").csv(path)


def csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def table(rows: DataFrame, path: str, overwrite: bool) -> None:
    """A result cache; without ``overwrite`` an existing one is an error."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def json_text(row: Column) -> Column:
    """A struct as JSON with nulls kept; dates and times in ISO form."""
    return F.to_json(row, {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "dateFormat": "yyyy-MM-dd"})


def output_name(*key: Column) -> Column:
    """A file name that no other key has, the same in every run."""
    return F.concat(F.substring(F.sha2(F.concat_ws("\x1f", *key), 256), 1, 16), F.lit(".png"))


def document(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, written whole or not at all; an existing one is replaced."""
    jvm = spark.sparkContext._jvm
    at, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.draft")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(at, False)
    if not files.rename(draft, at):
        raise OSError(f"could not write {path}")
