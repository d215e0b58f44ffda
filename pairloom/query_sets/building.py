"""Building and exporting the training set."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.functions import geometry as G
from pairloom.functions import sampling as S
from pairloom.functions import scorers
from pairloom.functions import vectors as V
from pairloom.operators import joins as J
from pairloom.operators import metrics as M
from pairloom.operators import upserts as U
from pairloom.operators import windows as W
from pairloom.plans import dataset as D
from pairloom.query_sets import query
from pairloom.sources.tables import table

_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_FORMAT = f"case when {_STRIP} = '' then '' else upper(left({_STRIP}, 1)) || substr({_STRIP}, 2) || (case when {_STRIP} like '%.' then '' else '.' end) end"
_FLAT = f"""flat as (
  select sample_id, image_id, image_path, {_FORMAT.format('caption')} caption, source, pos - 1 pos, n.edited_image_path edited_image_path, {_FORMAT.format('n.edited_caption')} edited_caption,
    n.input_phrase input_phrase, n.edited_phrase edited_phrase, n.category category, n.sub_category sub_category, n.edit_id edit_id, coalesce(n.region_crop_bool, false) region_crop_bool
  from (select *, unnest(negatives) n, generate_subscripts(negatives, 1) pos from samples))"""


def _flat(spark, root) -> DataFrame:
    return D.flat_negatives(table(spark, root, "samples"))


@query(f"with {_FLAT} select * from flat")
def flat_negatives(spark, root):
    return _flat(spark, root)


@query(
    f"""with {_FLAT}
  select category, image_path, caption from (select *, row_number() over (partition by sample_id, category order by pos) r from flat where category is not null) where r = 1
  union all select category, edited_image_path, edited_caption from flat where category is not null"""
)
def contrastive_rows(spark, root):
    return D.contrastive_rows(table(spark, root, "samples"))


@query(
    f"""with {_FLAT}, d as (select distinct image_id, edit_id, edited_image_path visdiff from image_scores where image_id is not null and edit_id is not null
    qualify row_number() over (partition by image_id, edit_id order by score_id) = 1)
  select f.image_path, f.edited_image_path, d.visdiff, f.edit_id from flat f join d on f.image_id = d.image_id and f.edit_id = d.edit_id"""
)
def difference_rows(spark, root):
    r = table(spark, root, "image_scores").filter("image_id is not null and edit_id is not null")
    d = W.keep_first(r, ["image_id", "edit_id"], [F.col("score_id")])
    return D.difference_rows(table(spark, root, "samples"), d.select("image_id", "edit_id", F.col("edited_image_path").alias("visdiff")))


_NO_STOP = "regexp_replace({0}, '\\.$', '')"


@query(
    f"""with {_FLAT}, r as (select sample_id, pos, unnest([
    {{'type': 'multi-image', 'a': image_path, 'b': edited_image_path, 'q': 'You are given two images. Which one better aligns with the description: "' || caption || '"? The first or the second image?', 'w': case when caption is null then null else 'The correct answer is: first image.' end, 'n': 'image_task'}},
    {{'type': 'multi-image', 'a': edited_image_path, 'b': image_path, 'q': 'You are given two images. Which one better aligns with the description: "' || edited_caption || '"? The first or the second image?', 'w': case when edited_caption is null then null else 'The correct answer is: first image.' end, 'n': 'image_task'}},
    {{'type': 'image', 'a': image_path, 'b': '', 'q': 'Question: Does this image depict: (A) ' || {_NO_STOP.format('caption')} || ', or (B) ' || {_NO_STOP.format('edited_caption')} || '? Choices: A, B.', 'w': 'The correct answer is: (A) ' || caption, 'n': 'text_task'}},
    {{'type': 'image', 'a': edited_image_path, 'b': '', 'q': 'Question: Does this image depict: (A) ' || {_NO_STOP.format('caption')} || ', or (B) ' || {_NO_STOP.format('edited_caption')} || '? Choices: A, B.', 'w': 'The correct answer is: (B) ' || edited_caption, 'n': 'text_task'}},
    {{'type': 'image', 'a': edited_image_path, 'b': '', 'q': '', 'w': edited_caption, 'n': null}},
    {{'type': 'image', 'a': image_path, 'b': '', 'q': '', 'w': caption, 'n': null}},
    {{'type': 'multi-image', 'a': image_path, 'b': edited_image_path, 'q': '', 'w': 'The first image shows: ' || lower({_NO_STOP.format('caption')}) || '. The second image shows: ' || lower({_NO_STOP.format('edited_caption')}) || '.', 'n': 'joint_description'}}]) x, image_id, edit_id from flat)
  select sample_id, pos, x.type as type, x.a as image_path_1, x.b as image_path_2, x.q as question, x.w as answer,
    case when x.n is null then edit_id else concat_ws('.', image_id, edit_id, x.n) end as edit_id from r"""
)
def matching_rows(spark, root):
    """All rows of each negative with the first wordings."""
    return D.matching_rows(table(spark, root, "samples"), seed=-1)


@query(f"with {_FLAT} select sample_id, pos, 4 as questions from flat")
def matching_rows_drawn(spark, root):
    """Drawn wordings and optional rows; what is fixed is four questions per negative."""
    rows = D.matching_rows(table(spark, root, "samples"), seed=7).filter("question is null or question <> ''")
    return rows.groupBy("sample_id", "pos").agg(F.count("*").cast("int").alias("questions"))


@query(f"with {_FLAT} select sample_id, string_agg(coalesce(edit_id, '-') || ':' || coalesce(category, '-'), '|' order by pos) negatives from flat group by 1")
def nested_samples(spark, root):
    s = D.nested_samples(_flat(spark, root), ["sample_id"], ["edit_id", "category"], "pos")
    one = lambda n: F.concat(F.coalesce(n["edit_id"], F.lit("-")), F.lit(":"), F.coalesce(n["category"], F.lit("-")))
    return s.select("sample_id", F.array_join(F.transform("negatives", one), "|").alias("negatives"))


@query("select lower(trim(source)) source, count(*) positives, cast(sum(coalesce(len(negatives), 0)) as bigint) negatives from samples group by 1")
def positive_negative_counts(spark, root):
    s = table(spark, root, "samples").withColumn("source", F.lower(F.trim("source")))
    return s.groupBy("source").agg(F.count("*").alias("positives"), F.sum(F.when(F.col("negatives").isNull(), 0).otherwise(F.size("negatives"))).alias("negatives"))


@query(f"with {_FLAT} select category, case when category = 'object' then edited_phrase else sub_category end sub_category, count(*) n from flat group by 1, 2 having count(*) >= 20")
def subcategory_distribution(spark, root):
    sub = F.when(F.col("category") == "object", F.col("edited_phrase")).otherwise(F.col("sub_category"))
    return M.distribution(_flat(spark, root).withColumn("sub_category", sub), ["category", "sub_category"], 20)


@query(f"with {_FLAT} select category, sub_category, count(*) n from flat group by rollup(category, sub_category)")
def category_rollup(spark, root):
    return _flat(spark, root).rollup("category", "sub_category").agg(F.count("*").alias("n"))


@query(
    f"""with {_FLAT},
  a as (select * from flat qualify row_number() over (partition by sample_id, edited_caption order by pos) = 1)
  select sample_id, pos, edited_caption, edited_phrase from a qualify row_number() over (partition by sample_id, edited_phrase order by pos) = 1"""
)
def dedupe_keep_first(spark, root):
    return W.keep_first_in_turn(_flat(spark, root), "sample_id", ["edited_caption", "edited_phrase"], [F.col("pos")]).select("sample_id", "pos", "edited_caption", "edited_phrase")


@query(
    f"""with {_FLAT}, r as (select *, row_number() over (partition by sub_category order by sample_id, pos) r from flat)
  select sample_id, pos, sub_category from r where not (sub_category = '1' and r > 3) and not (sub_category = '2' and r > 15) or sub_category is null"""
)
def quota_by_key(spark, root):
    out = W.quota(_flat(spark, root), "sub_category", {"1": 3, "2": 15}, [F.col("sample_id"), F.col("pos")])
    return out.select("sample_id", "pos", "sub_category")


@query(
    f"""with {_FLAT},
  s as (select sample_id, pos, category, case when source = 'vsr' then 'spatially-aware' else sub_category end sub from flat),
  k as (select *, case category when 'object' then 60 when 'attribute' then 60 when 'relation' then 40 when 'counting' then 50 end cap from s where sub <> 'No Attribute'),
  c as (select category, count(distinct sub) subs from k where cap is not null group by 1),
  a as (select k.*, greatest(1, cap // subs) fair, row_number() over (partition by k.category, sub order by sample_id, pos) r from k join c on k.category = c.category),
  b as (select *, row_number() over (partition by category order by sub, sample_id, pos) q from a where r <= fair)
  select sample_id, pos, category, sub as sub_category from b where q <= cap"""
)
def stratified_quota(spark, root):
    caps = {"object": 60, "attribute": 60, "relation": 40, "counting": 50}
    return D.balanced(_flat(spark, root), caps, [F.col("sample_id"), F.col("pos")]).select("sample_id", "pos", "category", "sub_category")


@query("select event_id, row_number() over (order by ts, event_id) - 1 as position, (row_number() over (order by ts, event_id) - 1) // 100 as chunk from events")
def chunking(spark, root):
    rows = W.numbered(table(spark, root, "events").select("event_id", "ts"), [F.col("ts"), F.col("event_id")], "position")
    return W.chunked(rows, "position", 100).select("event_id", "position", "chunk")


@query("select a.event_id // 2 as pair, a.event_id as event_id_0, b.event_id as event_id_1, a.event_type as event_type_0, b.event_type as event_type_1 from events a join events b on b.event_id = a.event_id + 1 where a.event_id % 2 = 0")
def pair_consecutive(spark, root):
    return W.paired(table(spark, root, "events").select("event_id", "event_type"), "event_id", ["event_id", "event_type"])


_CANDIDATES = "c as (select distinct image_id, score_id, tifa_score from image_scores)"


@query(f"with {_CANDIDATES} select image_id, score_id from c qualify row_number() over (partition by image_id order by case when isnan(tifa_score) then null else tifa_score end desc nulls last, score_id) = 1")
def best_candidate(spark, root):
    c = table(spark, root, "image_scores").select("image_id", "score_id", "tifa_score").distinct()
    return W.best_candidate(c, ["image_id"], "tifa_score", "score_id").select("image_id", "score_id")


@query(f"with {_CANDIDATES} select image_id, coalesce(min(score_id) filter (tifa_score = 1), max(score_id)) score_id from c group by 1")
def first_perfect_else_last(spark, root):
    c = table(spark, root, "image_scores").select("image_id", "score_id", "tifa_score").distinct()
    return W.first_perfect_else_last(c, ["image_id"], "tifa_score", "score_id").select("image_id", "score_id")


_EDITS = f"""{_FLAT}, edits as (select distinct image_id, edit_id from flat where image_id is not null and edit_id is not null),
  good as (select distinct image_id, edit_id from image_scores where tifa_score >= 0.9 and not isnan(tifa_score)),
  said as (select distinct image_id, edit_id from image_scores where region_tifa_score is null)"""


@query(
    f"""with {_EDITS}
  select e.*, (g.edit_id is not null) as scored, (s.edit_id is not null) as answered, (g.edit_id is not null and s.edit_id is null) as kept
  from edits e left join good g on e.image_id = g.image_id and e.edit_id = g.edit_id left join said s on e.image_id = s.image_id and e.edit_id = s.edit_id"""
)
def reconcile_edits(spark, root):
    edits = _flat(spark, root).select("image_id", "edit_id").dropna().distinct()
    good = table(spark, root, "image_scores").filter("tifa_score >= 0.9 and not isnan(tifa_score)")
    return J.reconciled(edits, ["image_id", "edit_id"], {"scored": good}, {"answered": table(spark, root, "image_scores").filter("region_tifa_score is null")})


@query(f"with {_EDITS} select e.* from edits e join good g on e.image_id = g.image_id and e.edit_id = g.edit_id")
def accepted_edits(spark, root):
    v = table(spark, root, "image_scores").withColumn("reject", F.when((F.col("tifa_score") >= 0.9) & ~F.isnan("tifa_score"), "NO").otherwise("YES"))
    return J.accepted(_flat(spark, root).select("image_id", "edit_id").dropna().distinct(), v, ["image_id", "edit_id"])


@query(f"with {_EDITS} select e.* from edits e left join said s on e.image_id = s.image_id and e.edit_id = s.edit_id where s.edit_id is null")
def cache_resume(spark, root):
    return J.remaining(_flat(spark, root).select("image_id", "edit_id").dropna().distinct(), table(spark, root, "image_scores").filter("region_tifa_score is null"), ["image_id", "edit_id"])


@query(
    """with want as (select l_orderkey, count(*) want from lineitem group by 1), have as (select l_orderkey, count(*) have from lineitem where l_linestatus = 'F' group by 1)
  select w.l_orderkey, want, have from want w left join have h using (l_orderkey) where have is null or have <> want"""
)
def incomplete_cache(spark, root):
    l = table(spark, root, "lineitem")
    want = l.groupBy("l_orderkey").agg(F.count("*").alias("want"))
    have = l.filter("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.count("*").alias("have"))
    return J.incomplete(want, have, ["l_orderkey"], "want", "have")


@query(
    f"""with {_FLAT}, tags as (select image_id, edit_id, max(split_part(edited_image_path, '/', 3)) tag from image_scores where tifa_score > 0.5 group by 1, 2)
  select f.sample_id, f.pos, coalesce(t.tag, 'Others') as tag from flat f left join tags t on f.image_id = t.image_id and f.edit_id = t.edit_id"""
)
def tag_left_join_default(spark, root):
    tags = table(spark, root, "image_scores").filter("tifa_score > 0.5").groupBy("image_id", "edit_id").agg(F.max(F.split_part("edited_image_path", F.lit("/"), F.lit(3))).alias("tag"))
    return J.with_default(_flat(spark, root), tags, ["image_id", "edit_id"], "tag", "Others").select("sample_id", "pos", "tag")


_PAIR = """case when category ~ '^.*?\\s*\\(.*?\\)\\s*$' then regexp_extract(category, '^(.*?)\\s*\\((.*?)\\)\\s*$', 1) else trim(split_part(category, '(', 1)) end"""


@query(
    f"""with {_FLAT}, s as (select edited_image_path, max(tifa_score) t, max(region_tifa_score) r from image_scores where not isnan(tifa_score) and not isnan(region_tifa_score) group by 1),
  said as (select image_id, edit_id, max(split_part(edited_image_path, '/', 3)) tag from image_scores where tifa_score > 0.5 group by 1, 2)
  select f.sample_id, f.pos, case when {_PAIR} in ('object', 'attribute', 'relation', 'counting') then {_PAIR} else 'others' end category, coalesce(m.tag, 'Others') sub_category
  from flat f join s on f.edited_image_path = s.edited_image_path left join said m on f.image_id = m.image_id and f.edit_id = m.edit_id
  where (contains(category, 'object') or contains(category, 'attribute')) and t >= 0.9 and r >= 0.9
  and exists (select 1 from image_scores e where e.image_id = f.image_id and e.edit_id = f.edit_id and e.score_id % 3 > 0)"""
)
def scored_negatives(spark, root):
    usable = table(spark, root, "image_scores").filter("tifa_score is not null and region_tifa_score is not null and not isnan(tifa_score) and not isnan(region_tifa_score)")
    scores = usable.groupBy("edited_image_path").agg(F.max("tifa_score").alias("tifa_score"), F.max("region_tifa_score").alias("region_tifa_score"))
    rows = table(spark, root, "image_scores")
    verdicts = rows.withColumn("reject", F.when(F.col("score_id") % 3 > 0, "NO").otherwise("YES"))
    tags = rows.filter("tifa_score > 0.5").groupBy("image_id", "edit_id").agg(F.max(F.split_part("edited_image_path", F.lit("/"), F.lit(3))).alias("sub_category"))
    edits = _flat(spark, root).drop("sub_category").join(scores, "edited_image_path")
    return D.scored_negatives(edits, verdicts, tags, 0.9).select("sample_id", "pos", "category", "sub_category")


@query(
    """with e as (select l_orderkey::varchar image_id, l_linenumber pos, l_partkey id, 'i' || l_suppkey new_image_path, case when l_discount >= 0.03 then 1.0 else 0.5 end tifa_score, l_returnflag || l_linestatus new_caption,
      (l_quantity::int % 4) + 1 n, case when l_orderkey % 7 = 0 then 'open_ended' else 'coco' end src, case when l_partkey % 2 = 0 then 'bus' else 'toy' end obj from lineitem),
    u as (select * from e where src <> 'open_ended' and tifa_score = 1 qualify row_number() over (partition by image_id, new_caption order by pos, id) = 1),
    q as (select *, row_number() over (partition by n order by image_id, pos, id) r from u),
    k as (select * from q where not (n = 1 and r > 0) and not (n = 2 and r > 15))
  select image_id, new_image_path as edited_image_path, coalesce(nullif(case when image_id::int % 5 = 0 then 'better' else '' end, ''), new_caption) as edited_caption,
    n || ' ' || (case when n > 1 then (case obj when 'bus' then 'buses' else 'toys' end) else obj end) as input_phrase,
    (n - 1) || ' ' || (case when n - 1 > 1 then (case obj when 'bus' then 'buses' else 'toys' end) else obj end) as edited_phrase, 'counting' as category, n::varchar as sub_category, id as edit_id from k"""
)
def counting_negatives(spark, root):
    e = table(spark, root, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("image_id"), F.struct("l_linenumber", "l_partkey").alias("pos"), F.col("l_partkey").alias("id"), F.concat(F.lit("i"), F.col("l_suppkey")).alias("new_image_path"),
        F.when(F.col("l_discount") >= 0.03, 1.0).otherwise(0.5).alias("tifa_score"), F.concat("l_returnflag", "l_linestatus").alias("new_caption"), (F.bround("l_quantity").cast("int") % 4 + 1).alias("original_object_count"),
        F.when(F.col("l_orderkey") % 7 == 0, "open_ended").otherwise("coco").alias("image_edit_source"), F.when(F.col("l_partkey") % 2 == 0, "bus").otherwise("toy").alias("object_name"),
    )
    refined = e.select("image_id").distinct().withColumn("caption", F.when(F.col("image_id").cast("int") % 5 == 0, "better").otherwise(""))
    return D.counting_negatives(e, refined, {"1": 0, "2": 15})


@query(
    f"""with {_FLAT}, c as (
    select image_id, pos, 0 side, input_phrase phrase, image_path, edit_id, sample_id from flat union all select image_id, pos, 1, edited_phrase, edited_image_path, edit_id, sample_id from flat)
  select image_id, phrase, count(*) crops from (select distinct image_id, phrase from c where phrase is not null) group by 1, 2"""
)
def region_crops(spark, root):
    return D.region_crops(_flat(spark, root)).groupBy("image_id", "phrase").agg(F.count("*").alias("crops"))


@query("select o_orderkey, coalesce(max(case when o_orderkey % 2 = 0 then 'old' end), 'new') winner from orders group by 1")
def upsert_old_wins(spark, root):
    o = table(spark, root, "orders").select("o_orderkey")
    return U.old_wins(o.filter("o_orderkey % 2 = 0").withColumn("winner", F.lit("old")), o.withColumn("winner", F.lit("new")), ["o_orderkey"])


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'new' else 'old' end winner from orders group by 1")
def upsert_new_wins(spark, root):
    o = table(spark, root, "orders").select("o_orderkey")
    return U.new_wins(o.withColumn("winner", F.lit("old")), o.filter("o_orderkey % 3 = 0").withColumn("winner", F.lit("new")), ["o_orderkey"])


@query("select l_orderkey, case when min(l_linestatus) = 'F' then 'old' else 'new' end header, count(*) items from lineitem group by 1")
def upsert_append(spark, root):
    l = table(spark, root, "lineitem")
    side = lambda s, name: l.filter(F.col("l_linestatus") == s).groupBy("l_orderkey").agg(F.lit(name).alias("header"), F.sort_array(F.collect_list("l_partkey")).alias("items"))
    return U.appended(side("F", "old"), side("O", "new"), "l_orderkey", "items").select("l_orderkey", "header", F.size("items").cast("bigint").alias("items"))


@query("select l_orderkey, l_partkey from lineitem qualify row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber desc, l_partkey desc) = 1")
def last_file_wins(spark, root):
    return U.last_by(table(spark, root, "lineitem"), ["l_orderkey"], [F.col("l_shipdate"), F.col("l_linenumber"), F.col("l_partkey")]).select("l_orderkey", "l_partkey")


@query(
    """select 'both' kind, k from (select c_nationkey k from customer intersect select s_nationkey from supplier)
  union all select 'either', k from (select c_nationkey k from customer union select s_nationkey from supplier)
  union all select 'all', c_nationkey from customer union all select 'all', s_nationkey from supplier
  union all select 'left', k from (select c_nationkey k from customer except select s_nationkey from supplier)"""
)
def set_ops(spark, root):
    a, b = table(spark, root, "customer").select(F.col("c_nationkey").alias("k")), table(spark, root, "supplier").select(F.col("s_nationkey").alias("k"))
    name = lambda df, n: df.select(F.lit(n).alias("kind"), "k")
    return name(a.intersect(b), "both").unionByName(name(a.unionByName(b).distinct(), "either")).unionByName(name(a.unionByName(b), "all")).unionByName(name(a.subtract(b), "left"))


_RELATIONS = ["in front of", "to the left of", "to the right of", "on top of", "next to", "behind", "below", "above", "under"]


@query(
    f"""with p as (select caption, list_filter({_RELATIONS!r}, lambda r: contains(caption, r))[1] relation from samples)
  select relation, count(*) n from p where relation is not null group by 1 having count(*) < 1000 order by n desc, relation"""
)
def relation_counts(spark, root):
    rows = J.first_substring(table(spark, root, "samples"), "caption", _RELATIONS, "relation").filter("relation is not null")
    return rows.groupBy("relation").agg(F.count("*").alias("n")).filter("n < 1000").orderBy(F.desc("n"), "relation")


@query("select p_brand, count(*) filter (r <= 3) n from (select p_brand, row_number() over (partition by p_brand order by p_partkey) r from part) group by 1")
def sample_per_group(spark, root):
    """Rows drawn by hash; their number is fixed."""
    return S.sample_per_group(table(spark, root, "part"), ["p_brand"], "p_partkey", 3, 7).groupBy("p_brand").agg(F.count("*").alias("n"))


@query()
def hash_draws(spark, root):
    """Bernoulli, weighted and uniform draws per part; the same in every run and partitioning."""
    k = F.col("p_partkey")
    return table(spark, root, "part").select(
        "p_partkey", S.chance(0.25, 7, k).alias("kept"), S.weighted(["a", "b", "c"], [0.4, 0.4, 0.2], 7, k).alias("kind"), S.pick(F.array(F.lit("x"), F.lit("y"), F.lit("z")), 7, k).alias("picked"),
        F.array_join(S.shuffled(F.array(F.lit("p"), F.lit("q"), F.lit("r")), 7, k), "").alias("order"),
    )


@query(
    """select n_nationkey, s_suppkey, s_name from nation join supplier on n_nationkey = s_nationkey
  qualify row_number() over (partition by n_nationkey order by s_acctbal desc, s_suppkey) <= 3"""
)
def matching_instances(spark, root):
    n = table(spark, root, "nation").select("n_nationkey")
    s = table(spark, root, "supplier").withColumn("n_nationkey", F.col("s_nationkey"))
    return J.matching_instances(n, s, ["n_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")]).select("n_nationkey", "s_suppkey", "s_name")


@query(
    """with r as (select p_brand, p_size % 2 = 0 verdict, p_partkey, row_number() over (partition by p_brand, p_size % 2 = 0 order by p_retailprice desc, p_partkey) r from part)
  select p_brand, verdict, least(count(*), 4) demos, true as among_best from r group by 1, 2"""
)
def class_demos(spark, root):
    """Which rows are drawn depends on the hash; how many of each verdict, and that they are among the best twelve, doesn't."""
    p = table(spark, root, "part").withColumn("verdict", F.col("p_size") % 2 == 0)
    args = (["p_brand"], "verdict", "p_retailprice", [F.col("p_partkey")])
    best = J.best_per_class(p, ["p_brand", "verdict"], "p_retailprice", [F.col("p_partkey")], 12).select("p_partkey", F.lit(True).alias("best"))
    drawn = J.class_demos(p, *args, 8, 7, F.col("p_partkey")).join(best, "p_partkey", "left")
    return drawn.groupBy("p_brand", "verdict").agg(F.count("*").alias("demos"), F.bool_and(F.coalesce("best", F.lit(False))).alias("among_best"))


@query(
    """with s as (select *, row_number() over (partition by edited_image_path order by scored_at nulls first, score_id, tifa_score) r, coalesce(tifa_score >= 0.75 and not isnan(tifa_score), false) done from image_scores where edited_image_path is not null),
  f as (select edited_image_path p, min(r) first from s where done group by 1)
  select score_id, r::int as attempt from s left join f on p = edited_image_path where r <= 2 and (first is null or r <= first)"""
)
def capped_attempts(spark, root):
    """Scores of a picture as attempts at it: it is tried again once at most, and not after a good one."""
    s = table(spark, root, "image_scores").filter("edited_image_path is not null")
    done = (F.col("tifa_score") >= 0.75) & ~F.isnan("tifa_score")
    return W.capped_attempts(s, ["edited_image_path"], [F.col("scored_at").asc_nulls_first(), F.col("score_id"), F.col("tifa_score")], done).select("score_id", "attempt")


@query(
    f"""with {_FLAT}, u as (select distinct image_id from annotation_files where dataset = (select min(dataset) from annotation_files) and image_id is not null)
  select sample_id, pos, edit_id from flat where image_id is null or image_id not in (select image_id from u)"""
)
def kept_images(spark, root):
    """An image whose counting edits are of an unwanted source goes with all its negatives."""
    f = table(spark, root, "annotation_files")
    least = f.agg(F.min("dataset")).first()[0]
    edits = f.select("image_id", F.when(F.col("dataset") == least, "open_ended").otherwise("coco").alias("image_edit_source"))
    return D.of_kept_images(_flat(spark, root), edits).select("sample_id", "pos", "edit_id")


@query("select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank from part qualify rank <= 5")
def best_per_class(spark, root):
    return J.best_per_class(table(spark, root, "part"), ["p_brand"], "p_retailprice", [F.col("p_partkey")], 5).select("p_brand", "p_partkey", "rank")


def _layouts(spark, root) -> DataFrame:
    """Layouts of two named boxes made of parts; scores go by the size."""
    b = lambda name, x: F.struct(name.alias("name"), F.lit(float(x)).alias("x"), F.lit(10.0).alias("y"), (F.col("p_size") + 20).cast("double").alias("w"), F.lit(30.0).alias("h"))
    p = table(spark, root, "part")
    return p.select(
        F.col("p_partkey").alias("image_id"), F.lower(F.concat("p_type", F.lit(" left of "), "p_brand")).alias("prompt"), F.when(F.col("p_partkey") % 2 == 0, "relation(left)").otherwise("counting").alias("category"),
        F.array(b(F.col("p_type"), 0), F.struct(F.col("p_brand").alias("name"), F.lit(60.0).alias("x"), F.lit(10.0).alias("y"), F.lit(40.0).alias("w"), F.lit(30.0).alias("h"))).alias("bounding_boxes"),
        F.when(F.col("p_size") % 5 > 0, F.col("p_size") / 50.0).alias("score"), F.lit(0.95).alias("edited_score"),
    )


@query(
    """with p as (select p_partkey image_id, lower(p_type || ' left of ' || p_brand) prompt, lower(p_brand) || ' left of ' || lower(p_type) edited, case when p_size % 5 > 0 then p_size / 50.0 end score from part)
  select image_id, edited as edited_caption, 'left' as sub_category from p where coalesce(score, 0) >= 0.5
  and levenshtein(list_aggregate(list_sort(string_split(prompt, '')), 'string_agg', ''), list_aggregate(list_sort(string_split(edited, '')), 'string_agg', '')) <= 5"""
)
def relation_negatives(spark, root):
    return D.relation_negatives(_layouts(spark, root), 0.5).select("image_id", "edited_caption", "sub_category")


@query(
    """with p as (select p_partkey image_id, p_partkey % 2 = 0 relation, p_type, (p_size + 20.0) w from part)
  select image_id, case when regexp_matches(p_type, '(?i)^([aeiou]|hon|hour|herb)') then 'an ' else 'a ' end || p_type as first_name from p
  where (relation and abs(w * 30 - 1200) / greatest(w * 30, 1200) <= 0.5) or (not relation and w <= 60)"""
)
def usable_layouts(spark, root):
    return D.usable_layouts(_layouts(spark, root)).select("image_id", F.col("bounding_boxes")[0]["name"].alias("first_name"))


@query(
    """with q as (select vec_id // 4 id, vec_id % 4 k, cast(embedding as double[]) e from embeddings), n as (select id from q group by 1 having count(*) = 4)
  select a.id, cast(a.k as int) as text, cast(b.k - 2 as int) as image, round(list_cosine_similarity(a.e, b.e), 6) as score, round(100 * list_cosine_similarity(a.e, b.e), 4) as logit
  from q a join q b on a.id = b.id join n on n.id = a.id where a.k < 2 and b.k >= 2"""
)
def all_scores(spark, root):
    e = table(spark, root, "embeddings").withColumn("id", F.floor(F.col("vec_id") / 4)).withColumn("k", F.col("vec_id") % 4)
    side = lambda lo: F.transform(F.filter("all", lambda x: (x["k"] >= lo) & (x["k"] < lo + 2)), lambda x: x["embedding"])
    rows = e.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "embedding"))).alias("all")).filter("size(all) = 4").select("id", side(0).alias("texts"), side(2).alias("images"))
    scored = scorers.all_scores(rows, "id", "texts", "images", "stub-cosine").withColumn("score", F.round("score", 6))
    pairs = rows.select("id", F.posexplode("texts").alias("text", "t"), "images").select("id", "text", "t", F.posexplode("images").alias("image", "i"))
    return scored.join(pairs.select("id", "text", "image", F.round(V.logit(F.col("t"), F.col("i")), 4).alias("logit")), ["id", "text", "image"])


@query("select score_id, region_tifa_score as score from (select distinct score_id, tifa_score, region_tifa_score from image_scores) where tifa_score >= 0.5 and not isnan(tifa_score)")
def cheap_first(spark, root):
    rows = table(spark, root, "image_scores").select("score_id", "tifa_score", "region_tifa_score").distinct()
    return scorers.cheap_first(rows, F.col("tifa_score"), 0.5, F.col("region_tifa_score")).select("score_id", "score")


@query("select p_partkey, 6 as tiles, 448 as x0, 448 as y0 from part")
def picture_tiles(spark, root):
    t = G.tiles(F.lit(3), F.lit(2), 448)
    return table(spark, root, "part").select("p_partkey", F.size(t).alias("tiles"), t[4]["x0"].alias("x0"), t[4]["y0"].alias("y0"))
