"""Samples and annotation payloads as related flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.operators.inlining import LIST, MAP, ROOT, array_children, element_key, parent_steps, shred
from pairloom.session import materialize

ANNOTATION, SCORE, QUESTION = "annotations", "scores", "question_details"
DECLARED = {(ROOT, ANNOTATION): LIST, (ANNOTATION, SCORE): MAP, (SCORE, QUESTION): MAP}
NAMES = {(ANNOTATION, SCORE): ("edited_image_path", "image_path", "path"), (SCORE, QUESTION): ("question",)}
#: Columns of the annotation table: its own and those of the singletons inlined into it.
ANNOTATION_COLUMNS = (
    "edit_id", "category", "prompt", "input_phrase", "edited_phrase", "edited_caption", "edited_region_phrase", "background_prompt", "negative_prompt",
    "diffusion_params.seed", "diffusion_params.steps", "diffusion_params.mask.blur", "diffusion_params.mask.dilate",
)


def annotation_elements(files: DataFrame, tables: list[str] | None) -> DataFrame:
    """Elements of ``annotation_files`` in the given tables, or in all: file_id, node, steps, inlined, own and parent key."""
    found = shred(files, "file_id", "payload", DECLARED, NAMES, tables)
    steps = F.col("steps")
    return found.withColumns({"element_key": element_key("file_id", steps), "parent_key": F.when(steps.isNotNull() & (F.size(steps) > 0), element_key("file_id", parent_steps(steps)))})


def every_element(files: DataFrame) -> DataFrame:
    """All tables one below the other: node tells the table, fields are its inlined columns."""
    return annotation_elements(files, None).select("node", "element_key", "parent_key", "file_id", "steps", _fields().alias("fields"))


def _fields() -> Column:
    """The inlined columns by name. Spark puts a number that is NaN or infinite between quotation marks."""
    found = F.from_json("inlined", "map<string,string>", {"allowNonNumericNumbers": "true"})
    return F.transform_values(found, lambda _, v: F.regexp_replace(v, '^"(NaN|-?Infinity)"$', "$1"))


def _path() -> Column:
    """The fields that lead to an element, without positions and keys."""
    return F.array_join(F.filter("steps", lambda x, i: i % 2 == 0), ">")


def child_rows(samples: DataFrame, files: DataFrame) -> DataFrame:
    """Every child of both tables with the keys of its parents, read from the tables of annotations, scores and questions."""
    step = lambda i: F.coalesce(F.try_element_at("steps", F.lit(i)), F.lit(""))
    at = _path()
    level = F.when(F.col("node") == "unreadable", "unreadable").when(at == ANNOTATION, "annotation").when(at == f"{ANNOTATION}>{SCORE}", "score").when(at == f"{ANNOTATION}>{SCORE}>{QUESTION}", "question")
    below = annotation_elements(files, [ANNOTATION, SCORE, QUESTION]).select(
        F.lit("annotation_files").alias("parent_table"),
        F.col("file_id").alias("parent_id"),
        level.alias("level"),
        F.coalesce(F.try_element_at("steps", F.lit(2)).cast("int"), F.lit(0)).alias("pos"),
        step(4).alias("image_key"),
        step(6).alias("question"),
    ).filter("level is not null")
    negatives = array_children(samples, "sample_id", "negatives").select(
        F.lit("samples").alias("parent_table"), F.col("sample_id").alias("parent_id"), F.lit("negative").alias("level"), "pos", F.lit("").alias("image_key"), F.lit("").alias("question")
    )
    return negatives.unionByName(below)


def negative_table(samples: DataFrame) -> DataFrame:
    """The negatives of the samples; file and position are their key."""
    return array_children(samples, "sample_id", "negatives")


def flat_tables(files: DataFrame) -> dict[str, DataFrame]:
    """Annotation, score and question tables with own and parent keys; inlined columns without a place of their own are in the map ``more``."""
    found = materialize(annotation_elements(files, [ANNOTATION, SCORE, QUESTION]).withColumn("fields", _fields()), "elements")
    value = lambda name: F.try_element_at("fields", F.lit(name))
    number = lambda name: value(name).try_cast("double")
    more = lambda *named: F.map_filter("fields", lambda k, _: ~k.isin(*named)).alias("more")
    node = lambda *path: found.filter(_path() == ">".join(path))
    pos = F.try_element_at("steps", F.lit(2)).cast("int").alias("pos")
    own, parent = F.col("element_key"), F.col("parent_key")
    return {
        "annotations": node(ANNOTATION).select(own.alias("annotation_key"), "file_id", pos, *(value(c).alias(c.replace(".", "_")) for c in ANNOTATION_COLUMNS), more(*ANNOTATION_COLUMNS)),
        "scores": node(ANNOTATION, SCORE).select(own.alias("score_key"), parent.alias("annotation_key"), F.col("steps")[3].alias("image_key"), number("tifa_score").alias("tifa_score"), number("region_tifa_score").alias("region_tifa_score"), more("tifa_score", "region_tifa_score")),
        "questions": node(ANNOTATION, SCORE, QUESTION).select(own.alias("question_key"), parent.alias("score_key"), F.col("steps")[5].alias("question"), value("answer").alias("answer"), value("multiple_choice_vqa").alias("multiple_choice_vqa"), number("scores").alias("matched"), more("question", "answer", "multiple_choice_vqa", "scores")),
    }
