"""Metrics and evaluation flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.functions import scorers, vectors as V
from pairloom.functions.arrays import by_parity, parity_label
from pairloom.operators import metrics as M
from pairloom.operators.joins import capped_neighbours
from pairloom.operators.windows import rolling_meter, topk_rescored
from pairloom.query_sets import query
from pairloom.sources import adapters as A
from pairloom.sources.tables import table


def _quads(spark: SparkSession, root: str) -> DataFrame:
    """Four consecutive vectors as two texts and two pictures, with the first one's label as category."""
    e = table(spark, root, "embeddings").withColumn("id", F.floor(F.col("vec_id") / 4)).withColumn("k", F.col("vec_id") % 4)
    part = lambda i, c: F.max(F.when(F.col("k") == i, F.col(c)))
    names = ("t0", "t1", "i0", "i1")
    quads = e.groupBy("id").agg(*[part(i, "embedding").alias(n) for i, n in enumerate(names)], part(0, "label").alias("category"), F.count("*").alias("n")).filter("n = 4")
    return scorers.pair_scores(quads, "stub-cosine", ("t0", "t1"), ("i0", "i1"), ["id", "category"])


_QUADS = """with q as (
  select vec_id // 4 id, max(case when vec_id % 4 = 0 then label end) category, {v}
  from embeddings group by 1 having count(*) = 4),
s as (select id, category, {s} from q)
""".format(
    v=", ".join(f"first(cast(embedding as double[])) filter (vec_id % 4 = {i}) {n}" for i, n in enumerate(("t0", "t1", "i0", "i1"))),
    s=", ".join(f"list_cosine_similarity(t{t}, i{i}) T{t}_I{i}" for t in (0, 1) for i in (0, 1)),
)
_HITS = """count(*) filter (T0_I0 > T1_I0 and T1_I1 > T0_I1) t, count(*) filter (T0_I0 > T0_I1 and T1_I1 > T1_I0) i,
  count(*) filter (T0_I0 > T1_I0 and T1_I1 > T0_I1 and T0_I0 > T0_I1 and T1_I1 > T1_I0) g, count(*) n"""
_RATES = "round_even(100.0::double * t / n, 2) as text, round_even(100.0::double * i / n, 2) as image, round_even(100.0::double * g / n, 2) as \"group\", n as count"


@query(_QUADS + f"select category, {_RATES} from (select category, {_HITS} from s group by category)")
def contrastive_accuracy(spark, root):
    return M.pair_accuracy(_quads(spark, root), ["category"])


@query(_QUADS + f"select {_RATES} from (select {_HITS} from s)")
def itg_global(spark, root):
    return M.pair_accuracy(_quads(spark, root))


@query(_QUADS + f"select category as tag, {_RATES} from (select category, {_HITS} from s group by category)")
def itg_by_tag(spark, root):
    return M.tag_accuracy(_quads(spark, root).withColumnRenamed("category", "tag"), "tag", ("T0_I0", "T0_I1", "T1_I0", "T1_I1"))


@query(_QUADS + "select round(100.0 * count(*) filter (T0_I0 >= T0_I1 and T0_I0 >= T1_I0 and T0_I0 >= T1_I1) / count(*), 6) accuracy, count(*) num_samples from s")
def standard_accuracy(spark, root):
    rows = _quads(spark, root).withColumn("best", V.argmax(F.array("T0_I0", "T0_I1", "T1_I0", "T1_I1")))
    return M.choice_accuracy(rows, "best").withColumn("accuracy", F.round("accuracy", 6))


@query(
    _QUADS
    + """select category, round((count(*) filter (T0_I0 > 0.5) + count(*) filter (T1_I0 < 0.5)) / (2.0 * count(*)), 6) acc,
  round(least(count(*) filter (T0_I0 > 0.5), count(*) filter (T1_I0 < 0.5)) / count(*), 6) min_precision, round(count(*) filter (T0_I0 > T1_I0) / count(*), 6) pairwise_acc, count(*) num_samples from s group by category"""
)
def foil_scores(spark, root):
    out = M.foil_scores(_quads(spark, root), "T0_I0", "T1_I0", ["category"])
    return out.withColumns({c: F.round(c, 6) for c in ("acc", "min_precision", "pairwise_acc")})


@query(_QUADS + "select id, round(T0_I0, 6) a, round(exp(T0_I0) / (exp(T0_I0) + exp(T1_I0)), 6) p from s")
def match_probability(spark, root):
    p = V.softmax(F.array("T0_I0", "T1_I0"))[0]
    return _quads(spark, root).select("id", F.round("T0_I0", 6).alias("a"), F.round(p, 6).alias("p"))


def _answers(spark: SparkSession, root: str) -> DataFrame:
    """Four consecutive events as the answers to two text and two picture questions; the truth goes by the user."""
    kinds = F.array(*map(F.lit, ("click", "purchase", "error", "signup", "view")))
    e = table(spark, root, "events").select(F.floor(F.col("event_id") / 4).alias("id"), (F.col("event_id") % 4).alias("k"), "event_type", F.get(kinds, (F.col("user_id") % 5).cast("int")).alias("truth"))
    names = ("Text_Q0", "Text_Q1", "Image_Q0", "Image_Q1")
    return e.groupBy("id").agg(*[F.max(F.when(F.col("k") == i, F.col(c))).alias(p + n) for i, n in enumerate(names) for c, p in (("event_type", ""), ("truth", "T_"))])


_ANSWERS = """with e as (select event_id // 4 id, event_id % 4 k, event_type, ['click','purchase','error','signup','view'][user_id % 5 + 1] truth from events),
a as (select id, {x} from e group by id)
""".format(x=", ".join(f"bool_and(event_type = truth) filter (k = {i}) q{i}" for i in range(4)))


@query(
    _ANSWERS
    + """select round(100.0 * count(*) filter (q0 and q1) / count(*), 6) text_score, round(100.0 * count(*) filter (q2 and q3) / count(*), 6) image_score,
  round(100.0 * count(*) filter (q0 and q1 and q2 and q3) / count(*), 6) group_score, count(*) num_samples from a"""
)
def vqa_accuracy(spark, root):
    a = _answers(spark, root)
    names = ["Text_Q0", "Text_Q1", "Image_Q0", "Image_Q1"]
    truth = a.select("id", *[F.col(f"T_{n}").alias(n) for n in names])
    out = M.answers_accuracy(a.select("id", *names), truth, "id", names[:2], names[2:])
    return out.withColumns({c: F.round(c, 6) for c in ("text_score", "image_score", "group_score")})


@query(
    _ANSWERS
    + """select round(100.0 * count(*) filter (q0 and q1) / count(*), 6) text_score, round(100.0 * count(*) filter (q2 and q3) / count(*), 6) image_score,
  round(100.0 * count(*) filter (q0 and q1 and q2 and q3) / count(*), 6) group_score, count(*) num_samples from a"""
)
def mllm_itg(spark, root):
    a = _answers(spark, root)
    hit = lambda n: F.col(n) == F.col(f"T_{n}")
    out = M.question_accuracy(a, [hit("Text_Q0"), hit("Text_Q1")], [hit("Image_Q0"), hit("Image_Q1")])
    return out.withColumns({c: F.round(c, 6) for c in ("text_score", "image_score", "group_score")})


@query("select l_linestatus, round(100.0 * count(*) filter (l_returnflag = 'N') / count(*), 6) accuracy, count(*) num_samples from lineitem group by 1")
def mllm_standard(spark, root):
    rows = table(spark, root, "lineitem").withColumn("match", F.col("l_returnflag") == "N")
    return M.match_accuracy(rows, "match", ["l_linestatus"]).withColumn("accuracy", F.round("accuracy", 6))


@query("select l_orderkey, round(avg(case when l_returnflag = 'N' then 1.0 else 0.0 end), 6) score, count(*) questions from lineitem group by 1")
def tifa_mean(spark, root):
    rows = table(spark, root, "lineitem").withColumn("wanted", F.lit("N"))
    return M.answer_score(rows, ["l_orderkey"], "l_returnflag", "wanted").withColumn("score", F.round("score", 6))


@query(
    """select l_orderkey, l_linestatus, l_returnflag from lineitem
  qualify row_number() over (partition by l_orderkey, l_linestatus order by l_linenumber desc, l_partkey desc, l_suppkey desc, l_returnflag desc) = 1"""
)
def question_log(spark, root):
    rows = table(spark, root, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))
    return M.question_log(rows, ["l_orderkey"], "l_linestatus", "l_returnflag", "at")


@query("select l_orderkey, round(avg(m), 6) score, count(*) regions from (select l_orderkey, l_suppkey % 3 r, avg(l_discount) m from lineitem group by 1, 2) group by 1")
def region_mean_of_means(spark, root):
    rows = table(spark, root, "lineitem").withColumn("r", F.col("l_suppkey") % 3)
    return M.mean_of_means(rows, ["l_orderkey"], ["r"], "l_discount").withColumn("score", F.round("score", 6))


@query(
    """select user_id, event_type, n as majority, cast(total as bigint) as votes from (
  select *, sum(n) over (partition by user_id) total, row_number() over (partition by user_id order by n desc, f) r
  from (select user_id, event_type, count(*) n, min(event_id) f from events group by 1, 2)) where r = 1"""
)
def majority_vote(spark, root):
    return M.majority(table(spark, root, "events"), ["user_id"], "event_type", "event_id")


@query(
    """with s as (select split_part(edited_image_path, '/', 3) folder, tifa_score t, region_tifa_score r from image_scores)
  select folder, count(*) filter (t is not null and r is not null) evaluated,
  count(*) filter (t is not null and r is not null and not (t >= 0.95 and r >= 0.95 and not isnan(t) and not isnan(r))) failed,
  count(*) filter (t >= 0.95 and r >= 0.95 and not isnan(t) and not isnan(r)) passed,
  round(count(*) filter (t >= 0.95 and r >= 0.95 and not isnan(t) and not isnan(r)) / nullif(count(*) filter (t is not null and r is not null), 0), 6) pass_rate from s group by 1"""
)
def threshold_counters(spark, root):
    rows = table(spark, root, "image_scores").withColumn("folder", F.split_part("edited_image_path", F.lit("/"), F.lit(3)))
    return M.pass_counters(rows, ["folder"], ["tifa_score", "region_tifa_score"], 0.95).withColumn("pass_rate", F.round("pass_rate", 6))


@query("select word, count(*) n from (select unnest(regexp_split_to_array(lower(text), '\\s+')) word from documents) where word <> '' group by 1")
def word_frequency(spark, root):
    return M.word_frequency(table(spark, root, "documents"), "text")


@query(
    """select event_id, event_type, round(quantile_disc(value, 0.5) over w, 9) median, round(avg(value) over w, 9) window_avg, max(value) over w window_max, value as last,
  round(avg(value) over (partition by event_type order by event_id rows unbounded preceding), 9) global_avg
  from events window w as (partition by event_type order by event_id rows between 19 preceding and current row)"""
)
def rolling_meter_events(spark, root):
    out = rolling_meter(table(spark, root, "events").select("event_id", "event_type", "value"), ["event_type"], [F.col("event_id")], "value")
    return out.select("event_id", "event_type", F.round("median", 9).alias("median"), F.round("window_avg", 9).alias("window_avg"), "window_max", "last", F.round("global_avg", 9).alias("global_avg"))


@query(
    """with q as (select vec_id query, cast(embedding as double[]) a from embeddings where vec_id % 50 = 0),
  p as (select query, vec_id as match, list_cosine_similarity(a, cast(embedding as double[])) s from q, embeddings where vec_id <> query)
  select query, match, round(s, 6) similarity from p where s < 0.3 qualify row_number() over (partition by query order by s desc, match) = 1"""
)
def knn_capped(spark, root):
    e = table(spark, root, "embeddings")
    return capped_neighbours(e, "vec_id", "embedding", e.filter("vec_id % 50 = 0"), 0.3).select("query", "match", F.round("similarity", 6).alias("similarity"))


@query(
    """with q as (select vec_id query, label ql, cast(embedding as double[]) a from embeddings where vec_id % 50 = 0),
  p as (select query, vec_id as match, label, ql, list_cosine_similarity(a, cast(embedding as double[])) s from q, embeddings where vec_id <> query),
  r as (select *, row_number() over (partition by query order by s desc, match) k from p)
  select query, match, round(case when k <= 8 then s + (label = ql)::int else -100 end, 6) final_score from r where k <= 32"""
)
def topk_rerank(spark, root):
    e = table(spark, root, "embeddings")
    near = capped_neighbours(e, "vec_id", "embedding", e.filter("vec_id % 50 = 0"), 2.0, k=32).drop("rank")
    label = e.select(F.col("vec_id").alias("match"), "label").join(near, "match")
    both = label.join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query")
    out = topk_rescored(both, "query", "similarity", [F.col("match")], 8, F.when(F.col("label") == F.col("ql"), 1.0).otherwise(0.0))
    return out.select("query", "match", F.round("final_score", 6).alias("final_score"))


@query(
    """with i as (select id, unnest([
    {'item': 0, 'type': 'text', 'text': p, 'images': [image_0], 'label': 'A'}, {'item': 1, 'type': 'image', 'text': q0, 'images': [image_0, image_1], 'label': 'First'},
    {'item': 2, 'type': 'text', 'text': p, 'images': [image_1], 'label': 'B'}, {'item': 3, 'type': 'image', 'text': q1, 'images': [image_0, image_1], 'label': 'Second'}]) x
    from (select *, 'Does this image best match: (A) ' || caption_0 || ', or (B) ' || caption_1 || '? Choices: A, B.' p,
      'Which image better aligns with the description: "' || caption_0 || '"? Choices: First, Second.' q0, 'Which image better aligns with the description: "' || caption_1 || '"? Choices: First, Second.' q1 from bench_pairs))
  select id, x.item as item, x.type as type, x.text as text, array_to_string(x.images, ' ') as images, x.label as label from i"""
)
def four_items(spark, root):
    return A.four_items(table(spark, root, "bench_pairs")).withColumn("images", F.array_join("images", " "))


@query(
    """with b as (select id, image_0, caption_0, caption_1, cast(split_part(id, '-', 2) as int) p from bench_pairs)
  select id, image_0 as image, 'Does this image best match: (A) ' || (case when p % 2 = 0 then caption_0 else caption_1 end) || ', or (B) ' || (case when p % 2 = 0 then caption_1 else caption_0 end) || '? Choices: A, B.' as text,
  case when p % 2 = 0 then 'A' else 'B' end as label from b"""
)
def parity_text_items(spark, root):
    b = table(spark, root, "bench_pairs").withColumn("p", F.split_part("id", F.lit("-"), F.lit(2)).cast("int"))
    return A.text_items(b.select("id", F.col("image_0").alias("image"), F.array("caption_0", "caption_1").alias("captions"), "p"), "p")


@query(
    """with b as (select id, caption_0, [image_0, image_1] im, cast(split_part(id, '-', 2) as int) p from bench_pairs)
  select id, array_to_string(case when p % 2 = 0 then im else list_reverse(im) end, ' ') as images, 'Which image better aligns with the description: "' || caption_0 || '"? Choices: First, Second.' as text, case when p % 2 = 0 then 'First' else 'Second' end as label from b"""
)
def parity_image_items(spark, root):
    b = table(spark, root, "bench_pairs").withColumn("p", F.split_part("id", F.lit("-"), F.lit(2)).cast("int"))
    out = A.image_items(b.select("id", F.array("image_0", "image_1").alias("images"), F.col("caption_0").alias("caption"), "p"), "p")
    return out.withColumn("images", F.array_join("images", " "))


@query("select event_id, array_to_string(case when event_id % 2 = 0 then [event_type, 'other'] else ['other', event_type] end, ' ') as choices, case when event_id % 2 = 0 then 'A' else 'B' end as label from events")
def parity_labels(spark, root):
    return table(spark, root, "events").select("event_id", F.array_join(by_parity(F.array("event_type", F.lit("other")), F.col("event_id")), " ").alias("choices"), parity_label(F.col("event_id"), "A", "B").alias("label"))


@query(
    """with q as (select p_partkey, ['red', 'green', 'blue', p_type] choices, lower(trim(p_brand)) answer, p_type from part),
  c as (select p_partkey, p_type, case when list_contains(choices, answer) then answer else
    list_sort(list_transform(choices, lambda c, i: {'d': levenshtein(answer, c), 'i': i, 'c': c}))[1].c end a from q)
  select p_type, round(avg((a = 'blue')::int), 6) score, count(*) questions from c group by 1"""
)
def closest_choice_score(spark, root):
    rows = table(spark, root, "part").select("p_partkey", "p_type", F.array(F.lit("red"), F.lit("green"), F.lit("blue"), F.col("p_type")).alias("choices"), F.lit("blue").alias("answer"), F.col("p_brand").alias("prediction"))
    return scorers.question_scores(rows, ["p_type"], "p_partkey", "choices", "answer", "prediction", "p_partkey").withColumn("score", F.round("score", 6))


@query("select id, s as sequence, caption_0 || ' [' || s || ']' as output from bench_pairs, range(3) t(s)")
def generated_texts(spark, root):
    return scorers.generate(table(spark, root, "bench_pairs"), "id", "caption_0", "stub-echo", 3)
