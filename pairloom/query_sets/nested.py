"""Nested payloads as flat tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.plans import annotations
from pairloom.query_sets import query
from pairloom.sources.tables import table


# The payloads level by level, parts that are strings decoded; NaN, which is no JSON here, stands as a number of its own.
_NAN = "-987654321"
LEVELS = rf"""with raw as (select file_id, regexp_replace(payload, ':\s*NaN', ': {_NAN}', 'g') p from annotation_files),
once as (select file_id, case when json_type(p) = 'VARCHAR' then p ->> '$' else p end p from raw where json_valid(p)),
docs as (select file_id, case when json_type(p) = 'VARCHAR' then p ->> '$' else p end p from once where json_valid(p)),
held as (select file_id, json_extract(p, '$.annotations') a from docs where json_valid(p)),
lists as (select file_id, case when json_type(a) = 'VARCHAR' then (a ->> '$')::json else a end a from held),
items as (
  select file_id, unnest(json_extract(a, '$[*]')) e, generate_subscripts(json_extract(a, '$[*]'), 1) - 1 pos from lists where json_type(a) = 'ARRAY'
  union all select file_id, a, 0 from lists where json_type(a) = 'OBJECT'),
annotations as (select file_id, pos, case when json_type(e) = 'VARCHAR' then (e ->> '$')::json else e end e, ['annotations', pos::varchar] steps from items where json_type(e) <> 'NULL'),
score_maps as (select file_id, steps, json_extract(e, '$.scores') m from annotations),
score_items as (
  select file_id, steps, unnest(map_entries(from_json(case when json_type(m) = 'VARCHAR' then (m ->> '$')::json else m end, '"MAP(VARCHAR, JSON)"'))) x from score_maps where json_type(m) <> 'NULL'),
scores as (select file_id, steps up, steps || ['scores', x.key] steps, x.key image_key, x.value e from score_items),
held_questions as (select file_id, steps, json_extract(e, '$.question_details') m from scores where json_type(e) = 'OBJECT'),
question_lists as (select file_id, steps, case when json_type(m) = 'VARCHAR' then (m ->> '$')::json else m end m from held_questions),
question_items as (
  select file_id, steps, x.key k, x.value e from (select file_id, steps, unnest(map_entries(from_json(m, '"MAP(VARCHAR, JSON)"'))) x from question_lists where json_type(m) = 'OBJECT')
  union all select file_id, steps, e ->> '$.question', e from (select file_id, steps, unnest(json_extract(m, '$[*]')) e from question_lists where json_type(m) = 'ARRAY') where json_type(e) <> 'NULL'),
questions as (select file_id, steps up, steps || ['question_details', k] steps, k question, e from question_items)
"""
_KEY = "md5(to_json({{'key': file_id, 'steps': {0}}}))"
_NUMBER = "case when e ->> '$.{0}' = '" + _NAN + "' then 'nan'::double else try_cast(e ->> '$.{0}' as double) end as {1}"


def _tables(spark, root):
    return annotations.flat_tables(table(spark, root, "annotation_files"))


@query(
    LEVELS
    + """select 'samples' parent_table, sample_id parent_id, 'negative' as level, (pos - 1)::int pos, '' image_key, '' question
    from (select sample_id, unnest(negatives) n, generate_subscripts(negatives, 1) pos from samples) where n is not null
  union all select 'annotation_files', file_id, 'unreadable', 0, '', '' from annotation_files where file_id not in (select file_id from docs where json_valid(p))
  union all select 'annotation_files', file_id, 'annotation', pos::int, '', '' from annotations
  union all select 'annotation_files', file_id, 'score', steps[2]::int, image_key, '' from scores
  union all select 'annotation_files', file_id, 'question', steps[2]::int, steps[4], question from questions"""
)
def p6_found(spark, root):
    return annotations.child_rows(table(spark, root, "samples"), table(spark, root, "annotation_files"))


@query(
    """select sample_id, pos - 1 as pos, n.edited_image_path as edited_image_path, n.edited_caption as edited_caption, n.input_phrase as input_phrase, n.edited_phrase as edited_phrase,
  n.category as category, n.sub_category as sub_category, n.edit_id as edit_id, n.region_crop_bool as region_crop_bool
  from (select sample_id, unnest(negatives) n, generate_subscripts(negatives, 1) pos from samples) where n is not null"""
)
def p6_negatives(spark, root):
    return annotations.negative_table(table(spark, root, "samples"))


@query(
    LEVELS
    + f"select {_KEY.format('steps')} annotation_key, file_id, pos::int pos, "
    + ", ".join(f"e ->> '$.{c}' as {c.replace('.', '_')}" for c in annotations.ANNOTATION_COLUMNS)
    + " from annotations"
)
def p6_annotations(spark, root):
    return _tables(spark, root)["annotations"].drop("more")


@query(LEVELS + f"select {_KEY.format('steps')} score_key, {_KEY.format('up')} annotation_key, image_key, {_NUMBER.format('tifa_score', 'tifa_score')}, {_NUMBER.format('region_tifa_score', 'region_tifa_score')} from scores")
def p6_scores(spark, root):
    return _tables(spark, root)["scores"].drop("more")


@query(LEVELS + f"select {_KEY.format('steps')} question_key, {_KEY.format('up')} score_key, question, e ->> '$.answer' answer, e ->> '$.multiple_choice_vqa' multiple_choice_vqa, {_NUMBER.format('scores', 'matched')} from questions")
def p6_questions(spark, root):
    return _tables(spark, root)["questions"].drop("more")


@query()
def p6_elements(spark, root):
    return annotations.every_element(table(spark, root, "annotation_files"))


def question_rows(spark, root):
    """Question, choices and answer of every question that has them."""
    found = annotations.annotation_elements(table(spark, root, "annotation_files"), ["question_details", "choices"])
    choice = found.filter("node = 'choices'").select("parent_key", F.element_at("steps", -1).cast("int").alias("at"), F.get_json_object("inlined", "$.value").alias("v"))
    listed = choice.groupBy("parent_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("choices"))
    asked = found.filter("node = 'question_details'").select(F.col("element_key").alias("parent_key"), F.element_at("steps", -1).alias("question"), F.get_json_object("inlined", "$.answer").alias("answer"))
    return asked.filter("question is not null and answer is not null").join(listed, "parent_key").drop("parent_key")


def layout_rows(spark, root):
    """Prompt, named boxes and texts of every annotation that is a layout."""
    found = annotations.annotation_elements(table(spark, root, "annotation_files"), ["annotations", "bounding_boxes[]", "bounding_boxes[][]"])
    at = lambda i: F.col("steps")[i].cast("int")
    value = F.get_json_object("inlined", "$.value")
    name = found.filter((F.col("node") == "bounding_boxes[]") & value.isNotNull()).select("file_id", at(1).alias("a"), at(3).alias("b"), F.struct(F.lit(-1).alias("i"), value.alias("v")).alias("s"))
    side = found.filter("node = 'bounding_boxes[][]'").select("file_id", at(1).alias("a"), at(3).alias("b"), F.struct(at(7).alias("i"), value.alias("v")).alias("s"))
    one = name.unionByName(side).groupBy("file_id", "a", "b").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("v")).filter("size(v) = 5")
    box = F.struct("b", F.col("v")[0].alias("name"), F.slice("v", 2, 4).cast("array<int>").alias("box"))
    boxes = one.groupBy("file_id", "a").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    text = lambda n: F.coalesce(F.get_json_object("inlined", f"$.{n}"), F.lit(""))
    made = found.filter("node = 'annotations'").select("file_id", at(1).alias("a"), F.get_json_object("inlined", "$.prompt").alias("prompt"), text("background_prompt").alias("background"), text("negative_prompt").alias("negative"), text("category").alias("category"))
    return made.filter("prompt is not null").join(boxes, ["file_id", "a"])
