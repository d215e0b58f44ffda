"""Sources, sinks, benchmark adapters and incremental runs, driven by the test tables."""

from __future__ import annotations

import json
from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from pairloom.query_sets import query
from pairloom.session import materialize, scratch_path
from pairloom.sources import adapters as A
from pairloom.sources import readers, sinks
from pairloom.sources.tables import table
from pairloom.streaming import resume


@query("select '/r/' || image_0 as image_0, caption_0 || (case when caption_0 like '%.' then '' else '.' end) as caption_0, '/r/' || image_1 as image_1, caption_1 || (case when caption_1 like '%.' then '' else '.' end) as caption_1, replace(array_to_string(list_slice(string_split(image_0, '/'), 1, 3), '-'), '.png', '') as id, string_split(image_0, '/')[1] as tag from bench_pairs")
def path_pairs(spark, root):
    b = table(spark, root, "bench_pairs").select(F.col("image_0").alias("image0"), F.col("caption_0").alias("caption0"), F.col("image_1").alias("image1"), F.col("caption_1").alias("caption1"))
    return A.path_pairs(b, "/r")


@query("select '/r/' || image_0 as image_0, '/r/' || image_1 as image_1, caption_0, caption_1, coalesce(tag, 'none') as subject from bench_pairs")
def nested_map_pairs(spark, root):
    b = table(spark, root, "bench_pairs").fillna("none", ["tag"])
    frame = F.struct(F.col("image_0").alias("image0"), F.col("image_1").alias("image1"), F.array("caption_0").alias("caption0"), F.array("caption_1").alias("caption1"))
    nested = b.groupBy("id", "tag").agg(F.collect_list(frame).alias("f")).select(F.create_map("id", F.create_map("tag", "f")).alias("m"))
    return A.subject_pairs(nested, "m", "/r")


@query("select '/r/' || image_0 as image_0, caption_0, '/r/' || image_1 as image_1, caption_1 from bench_pairs")
def video_pairs(spark, root):
    b = table(spark, root, "bench_pairs")
    frame = F.struct(F.col("image_0").alias("image0"), F.col("caption_0").alias("caption0"), F.col("image_1").alias("image1"), F.col("caption_1").alias("caption1"))
    return A.video_pairs(b.groupBy("id").agg(F.collect_list(frame).alias("f")).select(F.create_map("id", "f").alias("m")), "m", "/r")


@query("select '/r/' || image_0 as image_0, caption_0, '/r/' || image_1 as image_1, caption_1 from bench_pairs")
def flat_pairs(spark, root):
    b = table(spark, root, "bench_pairs").toDF("id", "image0", "caption0", "image1", "caption1", "tag")
    return A.flat_pairs(b, "/r")


@query("select '/r/original_images/' || ltrim(image_0, '/') as image_0, caption_0, '/r/edited_images/' || ltrim(image_1, '/') as image_1, caption_1, id from bench_pairs")
def edited_pairs(spark, root):
    b = table(spark, root, "bench_pairs").toDF("edit_id", "image_path", "caption", "edited_image_path", "edited_caption", "tag")
    return A.edited_pairs(b, "/r")


@query(
    """select '/r/' || a.event_type || '/' || a.event_id || '.jpg' as image_0, '/r/' || b.event_type || '/' || b.event_id || '.jpg' as image_1, upper(left(a.event_type, 1)) || substr(a.event_type, 2) || '.' as caption_0,
  upper(left(b.event_type, 1)) || substr(b.event_type, 2) || '.' as caption_1, a.event_id::int as id from events a join events b on b.event_id = a.event_id + 1 where a.event_id % 2 = 0"""
)
def consecutive_pairs(spark, root):
    rows = table(spark, root, "events").select("event_id", F.col("event_id").alias("qid"), F.col("event_type").alias("kind"), F.col("event_type").alias("statement"))
    return A.consecutive_pairs(rows, "event_id", "/r")


@query("select '/r/' || id as image, case when p % 2 = 0 then caption_0 else caption_1 end || '|' || case when p % 2 = 0 then caption_1 else caption_0 end as captions, 'speci2t-' || p as id, p from (select *, split_part(id, '-', 2)::int p from bench_pairs)")
def labelled_captions(spark, root):
    b = table(spark, root, "bench_pairs").withColumn("p", F.split_part("id", F.lit("-"), F.lit(2)).cast("int"))
    rows = b.select(F.col("id").alias("query"), F.array("caption_0", "caption_1").alias("keys"), (F.col("p") % 2).alias("label"), "p")
    return A.labelled_captions(rows, "/r", "p").withColumn("captions", F.array_join("captions", "|"))


@query("select case when p % 2 = 0 then '/r/' || image_0 || '|/r/' || image_1 else '/r/' || image_1 || '|/r/' || image_0 end as images, caption_0 as caption, 'spect2i-' || p as id, p from (select *, split_part(id, '-', 2)::int p from bench_pairs)")
def labelled_images(spark, root):
    b = table(spark, root, "bench_pairs").withColumn("p", F.split_part("id", F.lit("-"), F.lit(2)).cast("int"))
    rows = b.select(F.col("caption_0").alias("query"), F.array("image_0", "image_1").alias("keys"), (F.col("p") % 2).alias("label"), "p")
    return A.labelled_images(rows, "/r", "p").withColumn("images", F.array_join("images", "|"))


@query(
    """with e as (select event_id, 'COCO_' || (case when user_id % 2 = 0 then 'val' else 'train' end) || event_id || '.jpg' f, user_id % 4 m, event_type from events)
  select (case when contains(f, 'val') then '/r/val' else '/r/train' end) || '/' || f as image, case when event_id % 2 = 0 then event_type || '|not ' || event_type else 'not ' || event_type || '|' || event_type end as captions,
    case when event_id % 2 = 0 then 'A' else 'B' end as label, event_type as caption, event_id as id from e where m > 2"""
)
def approved_foils(spark, root):
    e = table(spark, root, "events").select(
        F.concat(F.lit("COCO_"), F.when(F.col("user_id") % 2 == 0, "val").otherwise("train"), F.col("event_id"), F.lit(".jpg")).alias("image_file"), (F.col("user_id") % 4).alias("mturk"), F.col("event_type").alias("caption"),
        F.concat(F.lit("not "), "event_type").alias("foil"), F.col("event_id").alias("foil_id"), "event_id",
    )
    return A.approved_foils(e, "/r/train", "event_id").withColumn("captions", F.array_join("captions", "|")).drop("foils")


@query("select event_id as foil_id, 'COCO_val2014_' || lpad(user_id::varchar, 12, '0') || '.jpg' as image_file, 'a dog near a ' || event_type as caption, 'a cat near a ' || event_type as foil from events where event_type <> 'error'")
def recovered_foils(spark, root):
    e = table(spark, root, "events").select(
        F.col("event_id").alias("foil_id"), F.col("user_id").alias("image_id"), F.concat(F.lit("a cat near a "), "event_type").alias("caption"), F.lit("cat").alias("foil_word"), F.lit("dog").alias("target_word"), (F.col("event_type") != "error").alias("foil")
    )
    return A.recovered_foils(e).select("foil_id", "image_file", "caption", "foil")


@query("select '/r/' || p_partkey || '.jpg' as image, 'three dogs' as first, 'count-' || p_partkey as id from part where p_partkey % 2 = 0")
def count_candidates(spark, root):
    p = table(spark, root, "part").select("p_partkey", F.concat(F.lit("http://x/"), F.col("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, ".jpg").otherwise(".gif")).alias("image_url"), F.lit("three dogs").alias("text"), F.lit(3).alias("number"))
    return A.count_candidates(p, "/r", "p_partkey").select("image", F.col("captions")[0].alias("first"), "id")


@query(
    """with s as (select sample_id, replace(caption, '''', '') caption, list_filter(['in front of','on top of','next to','behind','below','above','under'], lambda r: contains(caption, r))[1] relation from samples)
  select '/r/train.jpg' as image, replace(caption, relation, case relation when 'in front of' then 'behind' when 'on top of' then 'not on top of' when 'next to' then 'far from' when 'behind' then 'in front of' when 'below' then 'above' when 'above' then 'below' else 'over' end) as denied,
  'validation-' || sample_id as id from s where relation is not null"""
)
def negation_map(spark, root):
    from pairloom.operators.joins import first_substring

    s = table(spark, root, "samples").select("sample_id", F.replace(F.col("caption"), F.lit("'"), F.lit("")).alias("caption"))
    rows = first_substring(s, "caption", ["in front of", "on top of", "next to", "behind", "below", "above", "under"], "relation")
    rows = rows.withColumns({"label": F.col("relation").isNotNull(), "image": F.lit("train.jpg"), "image_link": F.lit("x/train2017/y")})
    return A.negated_relations(rows, "/r", "sample_id").select("image", F.col("captions")[1].alias("denied"), "id")


@query("select '/r/' || image_0 as image, caption_0 || '|' || caption_1 as captions, id from bench_pairs")
def captioned_negatives(spark, root):
    b = table(spark, root, "bench_pairs").select(F.create_map("id", F.struct(F.col("image_0").alias("filename"), F.col("caption_0").alias("caption"), F.col("caption_1").alias("negative_caption"))).alias("m"))
    return A.captioned_negatives(b, "m", "/r").withColumn("captions", F.array_join("captions", "|"))


@query(
    """with b as (select split_part(id, '-', 2)::int p, caption_0 c from bench_pairs)
  select '/r/' || lpad(p::varchar, 12, '0') || '.jpg' as image, case when contains(c, 'left of') then 'left' when contains(c, 'right of') then 'right' when contains(c, 'above') then 'above' else 'below' end as tag, p as id from b"""
)
def spatial_pairs(spark, root):
    b = table(spark, root, "bench_pairs").select(F.split_part("id", F.lit("-"), F.lit(2)).cast("int").alias("p"), F.col("caption_0").alias("caption"), F.col("caption_1").alias("foil"))
    return A.spatial_pairs(b.withColumn("image_id", F.col("p")), "/r", "p", "two", True).drop("captions")


@query("select 'img2.jpg|img10.jpg' as images, event_type as caption, 'd-' || event_id as id, event_id from events")
def frame_pairs(spark, root):
    e = table(spark, root, "events").select("event_id", F.lit("d").alias("directory"), F.concat(F.lit(" "), "event_type").alias("caption"), F.array(F.lit("img10.jpg"), F.lit("img9.jpg"), F.lit("img2.jpg")).alias("files"), F.lit(0).alias("pos_idx"), F.lit(2).alias("neg_idx"))
    return A.frame_pairs(e, "event_id").withColumn("images", F.array_join("images", "|"))


@query("select 'cup_left_of_' || event_id || '.jpg' as image, 'a cup left of it|a cup right of it' as captions, 'whatsup-' || event_id as id, event_id from events where event_id % 3 <> 0")
def preposition_options(spark, root):
    options = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("a cup under it"))).otherwise(F.array(F.lit("a cup right of it"), F.lit("a cup left of it"), F.lit("a cup under it")))
    e = table(spark, root, "events").select("event_id", F.concat(F.lit("x/cup_left_of_"), F.col("event_id"), F.lit(".jpg")).alias("image_path"), options.alias("caption_options"))
    return A.preposition_options(e, "event_id")[0].withColumn("captions", F.array_join("captions", "|"))


@query("select event_id, event_type from events")
def json_round_trip(spark, root):
    path = scratch_path(spark, "json")
    sinks.json_lines(table(spark, root, "events").select("event_id", "event_type"), path)
    return readers.json_lines(spark, path, "event_id bigint, event_type string")


@query("select category, count(*) n from (select unnest(negatives).category category from samples) where category in ('object', 'attribute', 'relation', 'counting') group by 1")
def category_files(spark, root):
    """Tab-separated files by category, written and read again."""
    from pairloom.plans.dataset import flat_negatives

    path = scratch_path(spark, "tsv")
    sinks.tsv_by_category(flat_negatives(table(spark, root, "samples")).select("category", "edited_image_path", "edited_caption"), path)
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path).groupBy("category").agg(F.count("*").alias("n"))


@query("select event_id, event_type, value from events")
def csv_round_trip(spark, root):
    path = scratch_path(spark, "csv")
    sinks.csv(table(spark, root, "events").select("event_id", "event_type", "value"), path)
    return spark.read.schema("event_id bigint, event_type string, value double").option("header", True).csv(path)


@query("select event_id as k, case when event_id % 3 = 0 then 'old' else event_type end as v from events")
def keyed_documents(spark, root):
    """Chunk files that map a thousand keys each; what a later file says of a key wins."""
    path = scratch_path(spark, "chunks")
    e = table(spark, root, "events").select("event_id", "event_type")
    for name, rows, value in (("a", e, F.lit("old")), ("b", e.filter("event_id % 3 <> 0"), F.col("event_type"))):
        doc = rows.groupBy(F.floor(F.col("event_id") / 1000).alias("g")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string"), value)))).alias("value"))
        doc.write.partitionBy("g").text(f"{path}/{name}")  # one document in each folder
    return readers.keyed_documents(spark, f"{path}/*/*/*.txt", "string").select(F.col("key").cast("bigint").alias("k"), F.col("value").alias("v"))


@query("select image_id, caption, '/r/' || (case when sample_id % 2 = 0 then 'val' else 'train' end) || '2017/' || image_id || '.jpg' as image_path from samples where split = 'train'")
def labelled_source(spark, root):
    s = table(spark, root, "samples").select((F.col("split") == "train").alias("label"), F.concat("image_id", F.lit(".jpg")).alias("image"), "caption", F.concat(F.lit("http://x/"), F.when(F.col("sample_id") % 2 == 0, "val").otherwise("train")).alias("image_link"))
    return readers.labelled_captions(s, "/r/train2017/")


@query("select image_id, arg_min(caption, sample_id) as caption from samples where image_id is not null and caption is not null group by 1")
def one_caption_per_image(spark, root):
    s = table(spark, root, "samples").filter("image_id is not null and caption is not null")
    return readers.one_caption_per_image(s, "image_id", F.col("sample_id")).select("image_id", "caption")


@query(
    """select l_orderkey as k, first(l_returnflag order by l_linenumber, l_partkey, l_suppkey) as input,
  string_agg('Question: ' || l_linestatus || ' Choices: ' || l_quantity::int || ' Answer: ' || l_returnflag, '|' order by l_linenumber, l_partkey, l_suppkey) as output from lineitem group by 1"""
)
def question_demos(spark, root):
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("k"), at.alias("at"), F.col("l_returnflag").alias("caption"), F.col("l_linestatus").alias("question"), F.col("l_returnflag").alias("answer"), F.bround("l_quantity").cast("int").alias("choices"))
    return readers.question_demos(lines, "k", "at").withColumn("output", F.array_join("output", "|"))


@query("select event_id, case when event_id % 3 = 0 then 'seen again' else event_type end as event_type from events")
def stream_resume(spark, root):
    """New files are processed once, in three runs, and merged by key; the last of them has rows of the first again."""
    src, out, check = (scratch_path(spark, n) for n in ("in", "out", "checkpoint"))
    e = table(spark, root, "events").select("event_id", "event_type")
    for part in (e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), e.filter("event_id % 3 = 0").withColumn("event_type", F.lit("seen again"))):
        part.write.mode("append").parquet(src)
        resume.process_new(spark, src, "event_id bigint, event_type string", check, lambda b: b, out, ["event_id"]).awaitTermination()
    return resume.latest(spark, out, ["event_id"])


@query("select time_bucket(interval 1 day, ts, timestamp '1970-01-01') as window_start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def windowed_counts(spark, root):
    out = resume.windowed_counts(table(spark, root, "events"), "ts", ["event_type"], "value")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select time_bucket(interval 1 day, ts, timestamp '1970-01-01') as window_start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def windowed_stream(spark, root):
    """The same counts from a stream of files: all events, then events of the first day again, which are too late, then one far ahead, which closes the windows."""
    src, out, check = (scratch_path(spark, n) for n in ("in", "out", "checkpoint"))
    e = table(spark, root, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    edge = e.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    ahead = spark.range(1).select(F.lit(edge["last"] + timedelta(days=30)).alias("ts"), F.lit("ahead").alias("event_type"), F.lit(0.0).alias("value"))
    for rows in (e.coalesce(1), e.filter(F.col("ts") < F.lit(edge["first"] + timedelta(days=1))).coalesce(1), ahead, ahead):
        rows.write.mode("append").parquet(src)
        resume.count_windows(spark, src, "ts timestamp, event_type string, value double", check, out, "ts", ["event_type"], "value").awaitTermination()
    found = spark.read.parquet(out)
    return found.filter("event_type <> 'ahead'").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select image_id::bigint as image_id, caption from samples where split = 'train' and caption is not null and image_id is not null")
def approved_captions(spark, root):
    s = table(spark, root, "samples").filter("caption is not null and image_id is not null")
    said = F.create_map("caption", F.struct(F.when(F.col("split") == "train", "yes").otherwise("no").alias("output")))
    return readers.approved_captions(s.select("image_id", said.alias("a")), "a")


@query("select o_custkey as image_id, count(*) as tags, min(o_orderkey) as first_tag from orders group by 1")
def instance_tables(spark, root):
    """Annotations of one document per group of orders, gathered by image."""
    o = table(spark, root, "orders").withColumn("g", F.floor(F.col("o_custkey") / 100))
    item = F.struct(F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("id"), F.lit(1).alias("category_id"), F.col("o_totalprice").alias("area"), F.array(F.lit(0.0)).alias("bbox"))
    docs = o.groupBy("g").agg(F.collect_list(item).alias("annotations")).withColumns({"images": F.array(F.struct(F.col("g").alias("id"))), "categories": F.array(F.struct(F.lit(1).alias("id")))})
    tags = readers.instance_tables(docs)["tags"]
    return tags.select("image_id", F.size("tags").cast("bigint").alias("tags"), F.col("tags")[0]["id"].alias("first_tag"))


@query("select '/r/a/' || event_id || '.jpg' as image_path, event_type as caption from events")
def csv_paths(spark, root):
    path = scratch_path(spark, "paths")
    sinks.csv(table(spark, root, "events").select(F.concat(F.lit("/"), F.col("event_id"), F.lit(".jpg")).alias("image_path"), F.col("event_type").alias("caption")), path)
    return readers.csv_pairs(spark, path, "/r", {"image_path": "a"}, "image_path string, caption string")


@query("select event_id::varchar as url, event_type as caption from events")
def tsv_and_lines(spark, root):
    """Lines written and read again as a tab-separated file without header."""
    path = scratch_path(spark, "lines")
    sinks.lines(table(spark, root, "events").select(F.concat(F.col("event_id").cast("string"), F.lit("\t"), "event_type").alias("x")), "x", path)
    assert readers.text_lines(spark, path).columns == ["line"]
    return readers.tsv(spark, path, "url string, caption string")


@query("select event_id, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\",\"none\":null}' as body from events")
def json_texts(spark, root):
    row = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("none"))
    return table(spark, root, "events").select("event_id", sinks.json_text(row).alias("body"))


@query("select event_id, substr(sha256(event_id || chr(31) || event_type), 1, 16) || '.png' as name from events")
def output_names(spark, root):
    return table(spark, root, "events").select("event_id", sinks.output_name(F.col("event_id").cast("string"), F.col("event_type")).alias("name"))


def _documents(spark, root) -> tuple[str, DataFrame]:
    """A folder for each nation with its ``annotations.json``, which can't be read for every seventh; and the nations."""
    path = scratch_path(spark, "folders")
    nations = table(spark, root, "nation").select("n_nationkey", "n_name", "n_regionkey")
    for r in nations.collect():  # 25 rows
        text = json.dumps({"name": r["n_name"], "region": r["n_regionkey"]})
        sinks.document(spark, f"{path}/{r['n_nationkey']}/annotations.json", text[:9] if r["n_nationkey"] % 7 == 0 else text)
    return path, nations


@query("select n_name as name, n_regionkey::bigint as region from nation where n_nationkey % 7 <> 0 union all select null, null where false")
def whole_documents(spark, root):
    """Whole-file JSON; unreadable files are set apart, a missing path has no rows."""
    path, _ = _documents(spark, root)
    schema = "name string, region bigint"
    found = readers.json_documents(spark, f"{path}/*/annotations.json", schema).unionByName(readers.json_documents(spark, f"{path}/none/*.json", schema))
    return readers.quarantined(materialize(found, "read"))[0]


@query("select n_nationkey::varchar as image_id, n_nationkey % 7 = 0 as unreadable, case when n_nationkey % 7 <> 0 then n_name end as name from nation")
def picture_folders(spark, root):
    path, _ = _documents(spark, root)
    return readers.directory_documents(spark, path, "name string, region bigint").select("image_id", F.col("_corrupt_record").isNotNull().alias("unreadable"), "name")


@query("select r_regionkey, r_name, n.c as nations from region left join (select n_regionkey, count(*) c from nation where false group by 1) n on r_regionkey = n_regionkey")
def optional_tables(spark, root):
    """A table that isn't there yet is empty, so what is joined to it stays."""
    path = scratch_path(spark, "none")
    counts = readers.read_or_empty(spark, f"{path}/counts.parquet", "r_regionkey int, nations bigint")
    return table(spark, root, "region").select("r_regionkey", "r_name").join(counts, "r_regionkey", "left")


@query("select r_regionkey, 'Describe ' || r_name || '.' as prompt, false as refused from region")
def prompt_templates(spark, root):
    """A template file filled for each region; one without the parts it needs is refused."""
    path = scratch_path(spark, "prompts")
    sinks.document(spark, f"{path}/good.json", json.dumps({"task_instruction": "Describe %s.", "io_structure": {"Input": "Output"}}))
    sinks.document(spark, f"{path}/bad.json", json.dumps({"task_instruction": "Describe %s."}))
    refused = []
    for name in ("bad", "none"):
        try:
            readers.prompt_template(spark, f"{path}/{name}.json")
        except (ValueError, FileNotFoundError) as e:
            refused.append(type(e).__name__)
    text = readers.prompt_template(spark, f"{path}/good.json")["task_instruction"]
    return table(spark, root, "region").select("r_regionkey", F.format_string(text, "r_name").alias("prompt"), F.lit(refused != ["ValueError", "FileNotFoundError"]).alias("refused"))


@query("select id, '/r/winoground/test/images/' || ltrim(image_0, '/') as image, '/r/winoground/test/annotations' as annotations from bench_pairs")
def benchmark_paths(spark, root):
    from pairloom.sources import registry

    at = registry.location("/r", "winoground", registry.splits("winoground")[0])
    return table(spark, root, "bench_pairs").select("id", F.concat(F.lit(at["images"] + "/"), F.ltrim("image_0", F.lit("/"))).alias("image"), F.lit(at["annotations"]).alias("annotations"))


@query("select event_id::varchar as url, event_type as caption from events order by event_id limit 1234")
def first_lines(spark, root):
    """The first rows of a file without header, by their place in it."""
    path = scratch_path(spark, "ordered")
    rows = table(spark, root, "events").select("event_id", F.concat(F.col("event_id").cast("string"), F.lit("\t"), "event_type").alias("x"))
    sinks.lines(rows.orderBy("event_id"), "x", path)
    return readers.tsv(spark, path, "url string, caption string", limit=1234)


@query(
    """select image_id, caption, chunk_id from (select image_id, caption, ((row_number() over (order by sample_id) - 1) // 300)::int chunk_id from samples where split = 'train' and caption is not null) where chunk_id = 1
  union all select image_id, caption, chunk_id from (select image_id, caption, ((row_number() over (order by sample_id) - 1) // 300)::int chunk_id from samples where split = 'train' and caption is not null) where chunk_id = 2"""
)
def cached_captions(spark, root):
    """Captions built once and read by chunk; the second reading takes the kept ones."""
    path = scratch_path(spark, "captions")
    s = table(spark, root, "samples").filter("split = 'train' and caption is not null").select("sample_id", "image_id", "caption")
    one = readers.cached_captions(spark, path, lambda: s, ["sample_id"], chunk=1, chunk_rows=300)
    two = readers.cached_captions(spark, path, lambda: s.limit(0), ["sample_id"], chunk=2, chunk_rows=300)
    return one.unionByName(two).select("image_id", "caption", "chunk_id")
