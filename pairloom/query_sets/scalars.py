"""Text, parsing, geometry and array expressions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.functions import arrays as A
from pairloom.functions import captions as C
from pairloom.functions import filters as X
from pairloom.functions import geometry as G
from pairloom.functions import parsing as R
from pairloom.functions import prompts as P
from pairloom.functions import vectors as V
from pairloom.operators import joins as J
from pairloom.operators import metrics as M
from pairloom.query_sets import nested, query
from pairloom.sources.tables import table

_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_FORMAT = f"case when {_STRIP} = '' then '' else upper(left({_STRIP}, 1)) || substr({_STRIP}, 2) || (case when {_STRIP} like '%.' then '' else '.' end) end"


@query(f"select id, {_FORMAT.format('caption_0')} formatted, upper(left(caption_0, 1)) || lower(substr(caption_0, 2)) sentence, regexp_replace(caption_0, '\\.$', '') bare from bench_pairs")
def format_caption(spark, root):
    c = F.col("caption_0")
    return table(spark, root, "bench_pairs").select("id", C.format_caption(c).alias("formatted"), C.sentence_case(c).alias("sentence"), C.drop_full_stop(c).alias("bare"))


@query(
    """select c as category, case when h in ('object', 'attribute', 'relation', 'counting') then h else 'others' end main, s as sub, split_part(c, '(', 1) head, count(*) n from (
  select c, case when c ~ '^.*?\\s*\\(.*?\\)\\s*$' then regexp_extract(c, '^(.*?)\\s*\\((.*?)\\)\\s*$', 1) else trim(split_part(c, '(', 1)) end h,
    case when c ~ '^.*?\\s*\\(.*?\\)\\s*$' then regexp_extract(c, '^(.*?)\\s*\\((.*?)\\)\\s*$', 2) else 'others' end s from (select unnest(negatives).category c from samples) where c is not null) group by all"""
)
def category_parts(spark, root):
    rows = table(spark, root, "samples").select(F.explode("negatives.category").alias("category")).filter("category is not null")
    p = C.category_pair(F.col("category"))
    return rows.select("category", p["category"].alias("main"), p["sub_category"].alias("sub"), C.category_head(F.col("category")).alias("head")).groupBy("category", "main", "sub", "head").agg(F.count("*").alias("n"))


@query(
    """with t as (select id, list_filter(regexp_split_to_array(caption_0, '\\s+'), lambda w: w <> '') w, caption_0 c from bench_pairs)
  select id, list_filter(w, lambda x: x in ('left','right','top','bottom','below','above','under'))[1] direction,
    (contains(c,'left') or contains(c,'right') or contains(c,'top') or contains(c,'bottom') or contains(c,'below') or contains(c,'above') or contains(c,'under')) mentions,
    cast(coalesce(list_sum(list_transform(list_filter(w, lambda x: lower(x) in ('one','two','three','four','five','six','seven','eight','nine','ten')),
      lambda x: list_position(['one','two','three','four','five','six','seven','eight','nine','ten'], lower(x)))), 0)
      + coalesce(list_sum(list_transform(list_filter(w, lambda x: regexp_full_match(x, '[0-9]+')), lambda x: cast(x as bigint))), 0) as bigint) total from t"""
)
def directions_and_counts(spark, root):
    c = F.col("caption_0")
    return table(spark, root, "bench_pairs").select("id", C.first_direction(c).alias("direction"), C.mentions_direction(c).alias("mentions"), C.count_total(c).alias("total"))


_PLURAL = "case when regexp_matches({0}, '[sxz]$') or regexp_matches({0}, '[^aeioudgkprt]h$') then {0} || 'es' when regexp_matches({0}, '[^aeiou]y$') then regexp_replace({0}, 'y$', 'ies') else {0} || 's' end"


@query(
    f"""with w as (select distinct unnest(string_split(p_name, ' ')) n from part)
  select n as noun, {_PLURAL.format('n')} plural, case when lower(split_part(n, ' ', 1)) in ('a', 'an') then n when regexp_matches(n, '(?i)^([aeiou]|hon|hour|herb)') then 'an ' || n else 'a ' || n end named from w where n <> ''"""
)
def pluralize(spark, root):
    rows = table(spark, root, "part").select(F.explode(F.split("p_name", " ")).alias("noun")).filter("noun <> ''").distinct()
    return rows.select("noun", C.pluralize(F.col("noun")).alias("plural"), C.add_article(F.col("noun")).alias("named"))


@query(
    """with s as (select sample_id, pos, input_phrase p from (select sample_id, unnest(negatives).input_phrase input_phrase, generate_subscripts(negatives, 1) pos from samples))
  select sample_id, pos, case when regexp_full_match(p, '(a|an) (.+)') then regexp_extract(p, '^(a|an) (.+)$', 2) else p end bare, regexp_replace(p, '\\b([aA]|[aA]n)\\b', 'one', 'g') one from s where p is not null"""
)
def articles(spark, root):
    rows = table(spark, root, "samples").select("sample_id", F.posexplode("negatives.input_phrase").alias("pos", "p")).filter("p is not null")
    return rows.select("sample_id", (F.col("pos") + 1).cast("bigint").alias("pos"), C.strip_article(F.col("p")).alias("bare"), C.articles_to_one(F.col("p")).alias("one"))


@query(
    """with s as (select sample_id, pos, caption, n.input_phrase a, n.edited_phrase b from (select sample_id, caption, unnest(negatives) n, generate_subscripts(negatives, 1) pos from samples)),
  k as (select *, strpos(lower(caption), lower(a)) i from s)
  select sample_id, pos, case when i > 0 then substr(caption, 1, i - 1) || b || substr(caption, i + length(a)) end replaced from k where caption is not null and a is not null and b is not null"""
)
def replaced_phrases(spark, root):
    rows = table(spark, root, "samples").select("sample_id", "caption", F.posexplode("negatives").alias("pos", "n")).filter("caption is not null and n.input_phrase is not null and n.edited_phrase is not null")
    return rows.select("sample_id", (F.col("pos") + 1).cast("bigint").alias("pos"), C.replace_first(F.col("caption"), F.col("n.input_phrase"), F.col("n.edited_phrase")).alias("replaced"))


_NUMBERS = "['no','one','two','three','four','five','six','seven','eight','nine','ten']"


@query(
    f"""with p as (select p_partkey, p_size % 9 + 2 n from part)
  select p_partkey, {_NUMBERS}[n] || ' ' || (case when n - 1 > 1 then 'dishes' else 'dish' end) fewer, 'There are ' || {_NUMBERS}[n] || ' ' || (case when n - 1 > 1 then 'dishes' else 'dish' end) || ' here.' caption,
    'There are ' || (n - 1) || ' ' || (case when n - 1 > 1 then 'dishes' else 'dish' end) || ' here.' digits from p"""
)
def reduced_counts(spark, root):
    n, dish = (F.col("p_size") % 9 + 2), F.lit("a dish")
    words = F.concat(F.lit("There are "), C.digit_text(n), F.lit(" dishes here."))
    digits = F.concat(F.lit("There are "), n.cast("string"), F.lit(" dishes here."))
    return table(spark, root, "part").select(
        "p_partkey", C.one_fewer(n, F.lit("dish")).alias("fewer"), C.reduced_count_caption(words, dish, n, F.lit(1)).alias("caption"), C.reduced_count_caption(digits, dish, n, F.lit(1)).alias("digits")
    )


@query(
    """with s as (select id, lower(caption_0) p, 'the ' || split_part(lower(caption_0), ' ', 3) a, split_part(lower(caption_0), ' ', 5) b, split_part(lower(caption_0), ' ', 3) x from bench_pairs),
  k as (select *, strpos(p, x) i, strpos(p, b) j from s)
  select id, case when i > 0 and j > 0 and i < j and i + length(x) <= j then substr(p, 1, i - 1) || b || substr(p, i + length(x), j - i - length(x)) || x || substr(p, j + length(b))
    when i > 0 and j > 0 and j < i and j + length(b) <= i then substr(p, 1, j - 1) || x || substr(p, j + length(b), i - j - length(b)) || b || substr(p, i + length(x)) end swapped from k"""
)
def swapped_phrases(spark, root):
    word = lambda i: F.split_part(F.lower("caption_0"), F.lit(" "), F.lit(i))
    return table(spark, root, "bench_pairs").select("id", C.swap_phrases(F.col("caption_0"), word(3), word(5)).alias("swapped"))


@query("select a.id, levenshtein(list_aggregate(list_sort(string_split(a.caption_0, '')), 'string_agg', ''), list_aggregate(list_sort(string_split(a.caption_1, '')), 'string_agg', '')) bag, levenshtein(a.caption_0, a.caption_1) plain, levenshtein(a.caption_0, a.caption_1) <= 5 near from bench_pairs a")
def char_multiset_distance(spark, root):
    a, b = F.col("caption_0"), F.col("caption_1")
    return table(spark, root, "bench_pairs").select("id", C.char_bag_distance(a, b).alias("bag"), F.levenshtein(a, b).alias("plain"), C.within_edits(a, b, 5).alias("near"))


@query(
    """with s as (select id, '(A) ' || caption_0 || E'\\nbecause' t, caption_1 u from bench_pairs),
  n as (select id, 'a' x, lower(trim(regexp_replace(regexp_replace(u, '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))) y from s)
  select id, x as bracketed, y as plain, list_contains(string_split(y, ' '), 'a') or contains(y, 'answer a') or y = 'a' as names_a from n"""
)
def normalize_prediction(spark, root):
    t = F.concat(F.lit("(A) "), "caption_0", F.lit("\nbecause"))
    return table(spark, root, "bench_pairs").select("id", C.normalize_prediction(t).alias("bracketed"), C.normalize_prediction(F.col("caption_1")).alias("plain"), C.label_match(F.col("caption_1"), F.lit("A")).alias("names_a"))


@query("select id, rtrim(lower(split_part(caption_0, ',', 1)), '.:') cut, rtrim(lower(split_part(caption_0, ' ', 1)), '.:') marked from bench_pairs")
def vqa_answers(spark, root):
    marked = F.concat(F.split_part("caption_0", F.lit(" "), F.lit(1)), F.lit(" Answer: no, maybe"))
    return table(spark, root, "bench_pairs").select("id", C.vqa_answer(F.col("caption_0")).alias("cut"), C.vqa_answer(marked).alias("marked"))


@query(
    """select event_id, case when event_id % 3 = 0 then 'YES' when event_id % 3 = 1 then 'NO' else 'YES' end verdict, lower(replace(replace('A/b-' || event_type, '/', ''), '-', '')) slug,
  'b' || event_id || '.png' name, 'png' ext, lpad(event_id::varchar, 12, '0') padded from events"""
)
def names_and_verdicts(spark, root):
    said = F.concat(F.lit("So. Reject: "), F.element_at(F.array(F.lit("YES"), F.lit("NO"), F.lit("perhaps")), (F.col("event_id") % 3).cast("int") + 1))
    path = F.concat(F.lit("/a/b"), F.col("event_id"), F.lit(".png"))
    return table(spark, root, "events").select(
        "event_id", C.verdict(said).alias("verdict"), C.slug(F.concat(F.lit("A/b-"), "event_type")).alias("slug"), C.file_name(path).alias("name"), C.file_extension(path).alias("ext"), C.padded_id(F.col("event_id")).alias("padded")
    )


@query("select id, trim(replace(split_part(caption_0 || '. More.', '.', 1), 'the ', '')) background, case when not contains(caption_0, 'the') then caption_0 when not contains(caption_1, 'the') then caption_1 else 'a photo, outdoor' end free from bench_pairs")
def background_texts(spark, root):
    return table(spark, root, "bench_pairs").select(
        "id", C.first_sentence(F.concat("caption_0", F.lit(". More.")), ["the "]).alias("background"), C.first_without(F.array("caption_0", "caption_1"), F.array(F.lit("the"))).alias("free")
    )


_EDIT = R.EDIT.removeprefix("(?d)").replace("'", "''")
_EDITS = f"""with t as (
    select sample_id, caption, string_agg('{{"InputCaption": "' || caption || '", "SelectedPhrase": "' || n.input_phrase || '", "EditedPhrase": "' || n.edited_phrase || '", "EditedRegionPhrase": "' || n.edited_phrase
      || '", "EditedCaption": "' || n.edited_caption || '", "Category": "' || n.category || '"}}', ', ' order by pos) text
    from (select sample_id, caption, unnest(negatives) n, generate_subscripts(negatives, 1) pos from samples where caption is not null) group by 1, 2),
  m as (select sample_id, caption, unnest(regexp_extract_all(text, '{_EDIT}', 1)) echoed, unnest(regexp_extract_all(text, '{_EDIT}', 2)) input_phrase, unnest(regexp_extract_all(text, '{_EDIT}', 3)) edited_phrase,
    unnest(regexp_extract_all(text, '{_EDIT}', 5)) edited_caption, unnest(regexp_extract_all(text, '{_EDIT}', 6)) category from t)
  select sample_id, {_STRIP.format('input_phrase')} input_phrase, {_STRIP.format('edited_phrase')} edited_phrase, {_STRIP.format('edited_caption')} edited_caption, {_STRIP.format('category')} category from m
  where levenshtein({_STRIP.format('echoed')}, caption) <= 5 and levenshtein(lower({_STRIP.format('edited_phrase')}), 'no attribute change') > 1
    and (contains(split_part(category, '(', 1), 'object') or contains(split_part(category, '(', 1), 'attribute'))"""


@query(_EDITS)
def parse_edits(spark, root):
    """The negatives of each sample written as a model writes edits, quotations, blanks and all, and read again."""
    rows = table(spark, root, "samples").filter("caption is not null")
    one = lambda n: F.concat(
        F.lit('{"InputCaption": "'), F.col("caption"), F.lit('", "SelectedPhrase": "'), n["input_phrase"], F.lit('", "EditedPhrase": "'), n["edited_phrase"], F.lit('", "EditedRegionPhrase": "'), n["edited_phrase"],
        F.lit('", "EditedCaption": "'), n["edited_caption"], F.lit('", "Category": "'), n["category"], F.lit('"}'),
    )
    found = R.parse_edits(F.array_join(F.transform("negatives", one), ", "), F.col("caption"))
    return rows.select("sample_id", F.explode(found).alias("e")).select("sample_id", "e.input_phrase", "e.edited_phrase", "e.edited_caption", "e.category")


@query(
    nested.LEVELS
    + """select question, list_transform(json_extract(e, '$.choices[*]'), lambda c: c ->> '$') choices, trim(translate(e ->> '$.answer', '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', '')) answer, question simple, e ->> '$.answer' reply
    from questions where question is not null and json_type(e) = 'OBJECT' and e ->> '$.answer' is not null and json_type(e, '$.choices') = 'ARRAY'"""
)
def parse_questions(spark, root):
    """The questions of all annotations written as a model writes them, and read again."""
    rows = nested.question_rows(spark, root)
    listed = F.concat(F.lit("['"), F.array_join("choices", "', '"), F.lit("']"))
    text = F.concat(F.lit("Question: "), "question", F.lit(" Choices: "), listed, F.lit(" Answer: "), "answer", F.lit('", "Question: Which? Choices: [unreadable] Answer: a'))
    simple = F.concat(F.lit("['Question: "), "question", F.lit(" Answer: "), "answer", F.lit("']"))
    found = rows.select(F.explode(R.parse_questions(text)).alias("q"), R.parse_simple_questions(simple)[0].alias("s"))
    return found.select("q.question", "q.choices", "q.answer", F.col("s.user").alias("simple"), F.col("s.assistant").alias("reply"))


@query(
    nested.LEVELS
    + """, boxed as (select e, list_transform(json_extract(e, '$.bounding_boxes[*]'), lambda b: (b ->> '$[0]') || ':' || array_to_string(list_transform(json_extract(b, '$[1][*]'), lambda x: (x ->> '$')::int::varchar), ',')) boxes
      from annotations where e ->> '$.prompt' is not null and json_type(e, '$.bounding_boxes') = 'ARRAY' and json_type(e, '$.bounding_boxes[0]') = 'ARRAY' and json_type(e, '$.bounding_boxes[0][0]') = 'VARCHAR')
    select e ->> '$.prompt' prompt, boxes, coalesce(e ->> '$.background_prompt', '') background, coalesce(e ->> '$.negative_prompt', '') negative, coalesce(e ->> '$.category', '') category from boxed"""
)
def parse_layouts(spark, root):
    """The layouts of all annotations written as a model writes them, and read again."""
    rows = nested.layout_rows(spark, root)
    one = lambda b: F.concat(F.lit("('"), b["name"], F.lit("', ["), F.array_join(b["box"].cast("array<string>"), ", "), F.lit("])"))
    text = F.concat(
        F.lit("1. Input: "), "prompt", F.lit(", Bounding boxes: ["), F.array_join(F.transform("boxes", one), ", "), F.lit("], Background prompt: "), "background", F.lit(", Negative prompt: "), "negative", F.lit(", Category: "), "category",
        F.lit("\n2. Input: b, Bounding boxes: [unreadable], Background prompt: b, Negative prompt: n, Category: c"),
    )
    found = rows.select(F.explode(R.parse_layouts(text)).alias("l")).select("l.*")
    box = lambda b: F.concat(b["name"], F.lit(":"), F.array_join(F.array(*[b[c].cast("int").cast("string") for c in "xywh"]), ","))
    return found.select("prompt", F.transform("bounding_boxes", box).alias("boxes"), F.col("background_prompt").alias("background"), F.col("negative_prompt").alias("negative"), "category")


@query("select p_partkey, 'first ' || p_type as cut, 2 as lines, p_brand || '|' || p_type as listed, cast(null as varchar) as junk, p_type || ' of ' || p_brand as reformatted from part")
def parse_pieces(spark, root):
    quoted = F.concat(F.lit("[\""), "p_brand", F.lit("\", \""), "p_type", F.lit("\"]"))
    return table(spark, root, "part").select(
        "p_partkey",
        R.before_numbered(F.concat(F.lit("first "), "p_type", F.lit(" 3. Input: more")), 3, "Input").alias("cut"),
        F.size(R.lines(F.concat("p_brand", F.lit("\n"), "p_type"))).alias("lines"),
        F.array_join(R.json_list_prefix(F.concat(quoted, F.lit("}}}"))), "|").alias("listed"),
        F.array_join(R.parse_list(F.concat(quoted, F.lit(" junk"))), "|").alias("junk"),
        R.reformat(F.concat("p_brand", F.lit(": "), "p_type"), "^(.*?): (.*)$", "%2$s of %1$s", 2).alias("reformatted"),
    )


def _boxes(spark, root) -> DataFrame:
    p = table(spark, root, "part")
    return p.select("p_partkey", "p_brand", G.box(F.col("p_partkey") * 37 % 512, F.col("p_partkey") * 53 % 512, F.col("p_size") + 20, F.col("p_size") * 2 + 10).alias("box"))


_BOXES = "b as (select p_partkey k, p_brand g, (p_partkey * 37 % 512)::double x, (p_partkey * 53 % 512)::double y, (p_size + 20)::double w, (p_size * 2 + 10)::double h from part)"
_INTER = "greatest(least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x), 0) * greatest(least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y), 0)"


@query(f"with {_BOXES} select k as p_partkey from b a where k % 2 = 0 and not exists (select 1 from b c where c.g = a.g and c.k % 2 = 1 and {_INTER} / (a.w * a.h + c.w * c.h - {_INTER}) > 0.2)")
def iou_filter(spark, root):
    b = _boxes(spark, root)
    return J.without_overlap(b.filter("p_partkey % 2 = 0"), b.filter("p_partkey % 2 = 1"), ["p_brand"], "p_partkey").select("p_partkey")


@query(f"with {_BOXES} select a.g as p_brand, a.k as key_a, c.k as key_b from b a join b c on a.g = c.g and a.k < c.k where a.x < c.x + c.w and a.x + a.w > c.x and a.y < c.y + c.h and a.y + a.h > c.y")
def box_overlap(spark, root):
    return J.overlapping_pairs(_boxes(spark, root), ["p_brand"], "p_partkey")


@query(
    f"""with {_BOXES}, q as (select k // 4 q, k % 4 i, x, y, w, h from b), n as (select q, count(*) n from q group by 1 having count(*) = 4),
  d as (select a.q, a.i, min(sqrt((a.x + a.w / 2 - c.x - c.w / 2) ** 2 + (a.y + a.h / 2 - c.y - c.h / 2) ** 2)) d from q a join q c on a.q = c.q and a.i <> c.i join n on n.q = a.q group by 1, 2),
  r as (select q, i, row_number() over (partition by q order by i) r from d where d >= 50)
  select n.q, coalesce(string_agg(i::varchar, ',' order by i) filter (r <= 3), '') isolated from n left join r on n.q = r.q group by 1"""
)
def isolated_boxes(spark, root):
    q = _boxes(spark, root).withColumn("q", F.floor(F.col("p_partkey") / 4)).withColumn("i", F.col("p_partkey") % 4)
    groups = q.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("i", "box"))).alias("s")).filter("size(s) = 4")
    return groups.select("q", F.array_join(G.isolated_positions(F.transform("s", lambda s: s["box"])).cast("array<string>"), ",").alias("isolated"))


@query(
    f"""with {_BOXES} select k as p_partkey, w * h as area, x + w as x1, round(x / 512, 6) as nx, cast(x * 2 as int) as rx, x - w * 0.05 as gx, w * 1.1 as gw,
  case when x <= 0 then x + 5 when x + w >= 512 then x - 5 else x end as sx, case when y <= 0 then y + 5 when y + h >= 512 then y - 5 else y end as sy,
  abs(w * h - 1000.0) / greatest(w * h, 1000.0) as diff, sqrt((x + w / 2 - 256) ** 2 + (y + h / 2 - 256) ** 2) as away from b"""
)
def box_geometry(spark, root):
    b, w = F.col("box"), F.lit(512.0)
    shifted, grown = G.off_edges(b, w, w, 5), G.grown_centred(b)
    return _boxes(spark, root).select(
        "p_partkey", G.area(b).alias("area"), G.corners(b)["x1"].alias("x1"), F.round(G.normalized(b, w, w)["x0"], 6).alias("nx"), G.rescaled(b, w, w, F.lit(1024), F.lit(1024))["x"].alias("rx"),
        grown["x"].alias("gx"), G.grown_right_down(b)["w"].alias("gw"), shifted["x"].alias("sx"), shifted["y"].alias("sy"), G.area_difference(b, G.box(0, 0, 100, 10)).alias("diff"), G.centre_distance(b, G.box(206, 206, 100, 100)).alias("away"),
    )


@query(
    f"""with {_BOXES}, q as (select k // 4 q, k % 4 i, * from b), f as (select q, count(*) n, min(x / 512 * 512 * 0.9) x0, min(y / 512 * 512 * 0.9) y0, max((x + w) / 512 * 512 * 1.1) x1, max((y + h) / 512 * 512 * 1.1) y1,
    count(*) filter (w * h / (512.0 * 512.0) < 0.01) small, first(x order by i) first_x, first(w order by i) first_w from q group by 1)
  select q, cast(trunc(x0) as int) x0, cast(trunc(y0) as int) y0, cast(trunc(x1) as int) x1, cast(trunc(y1) as int) y1, cast(small as int) small, first_x as last_swapped_x from f where n = 4"""
)
def union_boxes(spark, root):
    q = _boxes(spark, root).withColumn("q", F.floor(F.col("p_partkey") / 4)).withColumn("i", F.col("p_partkey") % 4)
    groups = q.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "box"))), lambda s: s["box"]).alias("b")).filter("size(b) = 4")
    w = F.lit(512.0)
    crop = G.union_crop(F.transform("b", lambda b: G.normalized(b, w, w)), w, w)
    return groups.select("q", *[crop[c].alias(c) for c in ("x0", "y0", "x1", "y1")], F.size(G.small_boxes(F.col("b"), w, w, 0.01)).alias("small"), G.swapped_places(F.col("b"))[3]["x"].alias("last_swapped_x"))


@query(
    """with p as (select p_partkey, p_size + 10 w, p_partkey % 60 + 10 h from part)
  select p_partkey, case when w / h > 1 then 256 else cast(trunc(256 * (w / h)) as int) end w, case when w / h > 1 then cast(trunc(256 / (w / h)) as int) else 256 end h from p"""
)
def fitted_sizes(spark, root):
    s = G.fitted_size(F.col("p_size") + 10, F.col("p_partkey") % 60 + 10)
    return table(spark, root, "part").select("p_partkey", s["w"].alias("w"), s["h"].alias("h"))


@query(
    """with p as (select p_partkey, (p_size + 10.0) / (p_partkey % 60 + 10.0) a from part)
  select p_partkey, list_sort([{'d': abs(a - 1.0), 'i': 0, 'c': 1}, {'d': abs(a - 2.0), 'i': 1, 'c': 2}, {'d': abs(a - 0.5), 'i': 2, 'c': 1}, {'d': abs(a - 3.0), 'i': 3, 'c': 3}])[1].c as columns from p"""
)
def closest_tilings(spark, root):
    t = G.closest_ratio(F.col("p_size") + 10, F.col("p_partkey") % 60 + 10, [(1, 1), (2, 1), (1, 2), (3, 1)], 448)
    return table(spark, root, "part").select("p_partkey", t["columns"].alias("columns"))


@query(
    """with l as (select l_orderkey k, list(l_partkey order by l_linenumber, l_partkey) p from lineitem group by 1)
  select k as l_orderkey, p[len(p)] as first_moved, array_to_string(list_slice(p, 1, 2), ',') as head, cast(len(list_distinct(p)) as int) as distinct_n, cast(ceil(len(p) / 2.0) as int) as groups, len(list_filter(p, lambda x: x = p[1])) = 1 as once from l"""
)
def array_operators(spark, root):
    l = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("p"))
    p = F.col("p")
    return l.select(
        "l_orderkey", A.front(p, F.size(p) - 1)[0].alias("first_moved"), F.array_join(F.slice(p, 1, 2).cast("array<string>"), ",").alias("head"), F.size(F.array_distinct(p)).alias("distinct_n"),
        F.size(A.fixed_stride(p.cast("array<string>"), 2)).alias("groups"), A.occurs_once(p, p[0]).alias("once"),
    )


@query("select p_partkey, p_size::double as found, 'x' as fallback, '0,1,4,5;2,3,6,7' as regrouped, 'a;b,c' as ragged, '0;0,1;0,1,2' as prefixes from part")
def map_and_regroup(spark, root):
    scores = F.create_map(F.concat(F.lit("a "), "p_brand"), F.col("p_size").cast("double"))
    join = lambda c: F.array_join(F.transform(c, lambda x: F.array_join(x.cast("array<string>"), ",")), ";")
    items = F.array(*[F.lit(i) for i in range(8)])
    return table(spark, root, "part").select(
        "p_partkey", A.article_lookup(scores, F.col("p_brand")).alias("found"), F.coalesce(F.try_element_at(F.create_map(F.lit("k"), F.lit("v")), F.col("p_brand")), F.lit("x")).alias("fallback"),
        join(A.regrouped(items, 2, 2, 2)).alias("regrouped"), join(A.ragged(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit(1), F.lit(2)))).alias("ragged"), join(G.prefixes(F.array(F.lit(0), F.lit(1), F.lit(2)))).alias("prefixes"),
    )


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) norm, round(list_avg(list_transform(embedding, lambda x: x::double)), 6) mean, list_position(embedding, list_max(embedding)) - 1 as best from embeddings")
def vector_measures(spark, root):
    e = F.col("embedding")
    return table(spark, root, "embeddings").select("vec_id", F.round(V.norm(e), 6).alias("norm"), F.round(V.mean(e), 6).alias("mean"), V.argmax(e).alias("best"))


@query(
    """select id, 9 as asked, 'How many ' || w || 's are there in the image?' as seventh, 'Do you see a ' || w || ' in the image?' as removed, 'Do it.' || chr(10) || '1. one' || chr(10) || '2. two' || chr(10) || '3. In: ' || caption_0 || ' Out:' as prompt,
  'not ' || lower(caption_1) as contrast, 2 as turns from (select *, regexp_replace(lower(split_part(caption_0, ' ', 2)), '[^a-z]', 'x', 'g') || 'ab' w from bench_pairs)"""
)
def prompt_assembly(spark, root):
    name = F.concat(F.lit("a "), F.regexp_replace(F.lower(F.split_part("caption_0", F.lit(" "), F.lit(2))), "[^a-z]", "x"), F.lit("ab"))
    asked = P.existence_questions(name, F.array(F.lit("x"), name))
    return table(spark, root, "bench_pairs").select(
        "id", F.size(asked).alias("asked"), asked[6]["question"].alias("seventh"), P.removal_questions(C.strip_article(name))[0]["question"].alias("removed"),
        P.few_shot(F.lit("Do it.\n"), F.array(F.lit("one"), F.lit("two")), "In", F.col("caption_0"), "Out").alias("prompt"),
        P.verification_captions(F.col("caption_0"), F.col("caption_0"), F.col("caption_1"))[2].alias("contrast"), F.size(P.chat_messages(F.lit("image"), F.col("caption_0"), F.lit("A"))).alias("turns"),
    )


@query(
    """with p as (select id, caption_0 c, image_0 im, split_part(id, '-', 2)::int k from bench_pairs)
  select id, true as in_test, not contains(im, 'train') as in_validation, k % 4 = 0 as degenerate, len(list_filter(string_split(c, ' '), lambda w: w in ('left','right','top','bottom','below','above','under'))) > 0 as directed,
    length(c) >= 3 as long_enough, k % 5 >= 3 as enough, k % 3 = 1 as once from p"""
)
def predicates(spark, root):
    k = F.split_part("id", F.lit("-"), F.lit(2)).cast("int")
    some = lambda n: F.slice(F.array(*[F.lit(i) for i in range(6)]), 1, n)
    nouns = F.when(k % 3 == 1, F.array(F.lit("dog"), F.lit("cat"))).otherwise(F.array(F.lit("dog"), F.lit("dog")))
    return table(spark, root, "bench_pairs").select(
        "id", X.of_split(F.col("image_0"), "test").alias("in_test"), X.of_split(F.col("image_0"), "validation").alias("in_validation"),
        X.degenerate_group(F.when(k % 4 == 0, F.lit("A group of one dog.")).otherwise(F.col("caption_0"))).alias("degenerate"), X.has_direction_token(F.col("caption_0")).alias("directed"),
        X.long_enough(F.col("caption_0")).alias("long_enough"), X.enough_questions(some(k % 5), some(F.lit(2)), some(F.lit(1))).alias("enough"), X.counted_once(nouns, F.lit("dog"), F.lit(2)).alias("once"),
    )


@query("select p_partkey, 1 as usable, p_size % 5 >= 4 as for_each, p_size % 6 >= 3 as fits, case when p_partkey % 2 = 0 then 'b' end as kept from part")
def question_and_box_filters(spark, root):
    asked = F.array(F.struct(F.lit("Is it clearly visible?").alias("question")), F.struct(F.lit("Is it red?").alias("question")))
    three = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    names = F.array(F.lit("a"), F.lit("b"))
    gone = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("z")))
    return table(spark, root, "part").select(
        "p_partkey", F.size(X.usable_questions(asked)).alias("usable"), X.enough_for_each(F.create_map(F.lit("k"), F.slice(F.array(*[F.lit(i) for i in range(6)]), 1, F.col("p_size") % 5))).alias("for_each"),
        X.count_fits(F.concat((F.col("p_size") % 6).cast("string"), F.lit(" dogs")), three).alias("fits"), F.array_join(X.without(names, gone), ",").alias("kept"),
    )


@query("select p_partkey, 'A cup. Not ' || p_type || '.|' || upper(left(p_type, 1)) || substr(p_type, 2) || '. Not a cup.' as contrasts, 'A photo of a ' || p_type || '.' as objects from part")
def layout_texts(spark, root):
    t = F.col("p_type")
    return table(spark, root, "part").select("p_partkey", F.array_join(P.contrast_texts(F.array(F.lit("a cup"), t)), "|").alias("contrasts"), F.array_join(P.object_texts(F.array(t, t)), "|").alias("objects"))


@query("select p_partkey, '1,3;2,4' as columns, p_brand as key, 'new' as merged, 2 as entries from part")
def map_helpers(spark, root):
    flipped = A.inverted(F.create_map(F.col("p_brand"), F.lit("v")))
    both = A.merged(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("old")), F.create_map(F.lit("a"), F.lit("new")))
    cols = A.transposed(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4))))
    return table(spark, root, "part").select(
        "p_partkey", F.array_join(F.transform(cols, lambda c: F.array_join(c.cast("array<string>"), ",")), ";").alias("columns"), flipped["v"].alias("key"), both["a"].alias("merged"), F.size(both).alias("entries")
    )


@query(
    """select vec_id, list_transform(range(1, 5), lambda d: round((embedding[d]::double + (vec_id % 2) * embedding[4 + d]::double + embedding[8 + d]::double) / greatest(2 + vec_id % 2, 1e-9), 6)) pooled,
  list_transform(range(1, 5), lambda d: 0.0::double) of_none from embeddings"""
)
def mean_pooled(spark, root):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 4 + 1, 4))
    mask = F.array(F.lit(1), (F.col("vec_id") % 2).cast("int"), F.lit(1), F.lit(0))
    rounded = lambda c: F.transform(c, lambda x: F.round(x, 6))
    return table(spark, root, "embeddings").select("vec_id", rounded(V.mean_pooled(tokens, mask)).alias("pooled"), rounded(V.mean_pooled(tokens, F.array(*[F.lit(0)] * 4))).alias("of_none"))


@query("select response_id, editedcaption is not null and contains(editedcaption, inputcaption) and contains(editedcaption, editedphrase) whole, contains(editedcaption, 'a') and contains(editedcaption, ' in ') keys from edit_responses where editedcaption is not null and inputcaption is not null and editedphrase is not null")
def keys_present(spark, root):
    r = table(spark, root, "edit_responses").filter("editedcaption is not null and inputcaption is not null and editedphrase is not null")
    said = F.col("editedcaption")
    return r.select("response_id", (F.contains(said, F.col("inputcaption")) & F.contains(said, F.col("editedphrase"))).alias("whole"), C.has_all(said, ["a", " in "]).alias("keys"))


@query("select l_returnflag, l_linestatus, round_even(100.0 * count(*) filter (l_quantity > 25) / count(*), 2) share, round(100.0 * count(*) filter (l_quantity > 25) / count(*), 6) plain from lineitem group by 1, 2")
def rounded_shares(spark, root):
    """Shares in per cent, rounded half to even."""
    hit = F.col("l_quantity") > 25
    return table(spark, root, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(M.percent(hit).alias("share"), F.round(M.percent(hit, None), 6).alias("plain"))
