"""Readers of the file formats in which samples, edits, annotations and benchmarks come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pairloom.operators.upserts import last_by
from pairloom.operators.windows import keep_first, numbered
from pairloom.session import materialize


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern names any file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def read_or_empty(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """A table, or no rows of the schema where it isn't there yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.format(fmt).options(**options).schema(schema).load(path)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents; an unreadable one has its text in ``_corrupt_record`` and nulls elsewhere. A missing path has no rows."""
    full = f"{schema}, _corrupt_record string"
    if not exists(spark, path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def directory_documents(spark: SparkSession, root: str, schema: str, name: str = "annotations.json") -> DataFrame:
    """One document per picture folder; the folder's name is ``image_id``."""
    docs = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/*/{name}")
    return docs.withColumn("image_id", F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{name.replace('.', '[.]')}$", 1))


def quarantined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable and unreadable documents; inputs are never deleted."""
    bad = F.col("_corrupt_record").isNotNull()
    return docs.filter(~bad).drop("_corrupt_record"), docs.filter(bad)


def keyed_documents(spark: SparkSession, pattern: str, value: str) -> DataFrame:
    """Chunk files that map keys to values, as ``key, value``; the file that sorts last wins a repeated key."""
    whole = spark.read.option("wholetext", True).text(pattern).select(F.from_json("value", f"map<string,{value}>").alias("m"), F.col("_metadata.file_path").alias("file"))
    return last_by(whole.select("file", F.explode("m").alias("key", "value")), ["key"], [F.col("file")]).select("key", "value")


def csv_pairs(spark: SparkSession, path: str, root: str, prefix: dict[str, str], schema: str | None = None) -> DataFrame:
    """A CSV file with header whose path columns get a folder before them."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.withColumns({c: F.concat_ws("/", F.lit(f"{root}/{folder}"), F.regexp_replace(c, "^/+", "")) for c, folder in prefix.items()})


def tsv(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """A TSV file without header; if ``limit`` is given, its first rows by file, place of the split in it, and place in the split."""
    rows = spark.read.schema(schema).option("sep", "\t").csv(path)
    if limit is None:
        return rows
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return first_rows(rows.select("*", at.alias("__at")), [F.col("__at.f"), F.col("__at.b"), F.col("__at.i")], limit).drop("__at")


def first_rows(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in an order, however many these are: rows are numbered by ranges, not in one task."""
    placed = materialize(rows.select("*", *(c.alias(f"__o{i}") for i, c in enumerate(order))), "placed")  # what a scan says of its files stays as it is
    return numbered(placed, [F.col(f"__o{i}") for i in range(len(order))], "__n").filter(F.col("__n") < n).select(*rows.columns)


def cached_captions(spark: SparkSession, path: str, build: Callable[[], DataFrame], order: list[str], chunk: int | None = None, chunk_rows: int = 10_000, rebuild: bool = False) -> DataFrame:
    """Captions that are built once and kept at ``path`` in chunks of ``chunk_rows`` rows; all of them, or the chunk with a number, of which only its folder is read."""
    if rebuild or not exists(spark, f"{path}/_SUCCESS"):
        rows = numbered(materialize(build(), "captions"), [F.col(c) for c in order], "__n")
        rows.withColumn("chunk_id", F.floor(F.col("__n") / chunk_rows).cast("int")).drop("__n").write.mode("overwrite").partitionBy("chunk_id").parquet(path)
    kept = spark.read.parquet(path)
    return kept if chunk is None else kept.filter(F.col("chunk_id") == chunk)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """Picture files as bytes with their path and size."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def one_caption_per_image(captions: DataFrame, image: str, order: Column) -> DataFrame:
    return keep_first(captions, [image], [order])


def labelled_captions(rows: DataFrame, root: str) -> DataFrame:
    """Captions whose label is true, with the picture's id and its path; validation pictures lie in their own folder."""
    path = F.concat(F.lit(root), F.col("image"))
    return rows.filter("label").select(
        F.replace(F.col("image"), F.lit(".jpg"), F.lit("")).alias("image_id"), "caption", F.when(F.contains(F.col("image_link"), F.lit("val")), F.replace(path, F.lit("train"), F.lit("val"))).otherwise(path).alias("image_path")
    )


def approved_captions(rows: DataFrame, answers: str) -> DataFrame:
    """``image_id, caption`` of a nested map image -> caption -> {output} where the output is yes."""
    return rows.select("image_id", F.explode(answers).alias("caption", "a")).filter("a.output = 'yes'").select(F.col("image_id").cast("bigint").alias("image_id"), "caption")


def instance_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """Images, annotations by image, and categories of an instances file."""
    one = lambda c: docs.select(F.explode(c).alias("x")).select("x.*")
    tags = one("annotations").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", "category_id", "area", "bbox"))).alias("tags"))
    return {"images": one("images"), "tags": tags, "categories": one("categories")}


def question_demos(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Questions of each id as one demonstration: the first caption, and the lines in order."""
    line = F.concat(F.lit("Question: "), "question", F.lit(" Choices: "), F.col("choices").cast("string"), F.lit(" Answer: "), "answer")
    return rows.groupBy(key).agg(F.min_by("caption", position).alias("input"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), line.alias("l")))), lambda s: s["l"]).alias("output"))


def prompt_template(spark: SparkSession, path: str) -> dict:
    """A prompt template with clear errors: it is one small document, read on the driver."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no prompt template at {path}")
    rows = spark.read.option("multiLine", True).json(path).limit(2).collect()
    if len(rows) != 1 or "task_instruction" not in rows[0] or "io_structure" not in rows[0]:
        raise ValueError(f"{path} needs task_instruction and io_structure")
    return rows[0].asDict(recursive=True)
