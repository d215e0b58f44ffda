"""Expected values worked out by hand for expressions and operators of the core."""

import json

import pytest
from pyspark.sql import functions as F

from pairloom.functions import arrays as A
from pairloom.functions import captions as C
from pairloom.functions import geometry as G
from pairloom.functions import parsing as R
from pairloom.functions import prompts as P
from pairloom.functions import sampling as S
from pairloom.functions import scorers
from pairloom.functions import vectors as V
from pairloom.operators import inlining, joins, metrics, skew, upserts, windows
from pairloom.plans import annotations, dataset
from pairloom.sources import adapters, readers, registry, sinks
from pairloom.streaming import resume


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    "expr, expected",
    [
        (lambda: C.format_caption(lit(" a dog ")), "A dog."),
        (lambda: C.format_caption(lit("two Men.")), "Two Men."),
        (lambda: C.format_caption(lit("  ")), ""),
        (lambda: C.format_caption(lit(None).cast("string")), None),
        (lambda: C.category_pair(lit("attribute (color)"))["sub_category"], "color"),
        (lambda: C.category_pair(lit("attribute(color)"))["category"], "attribute"),
        (lambda: C.category_pair(lit("object"))["sub_category"], "others"),
        (lambda: C.category_pair(lit("foo (x)"))["category"], "others"),
        (lambda: C.category_head(lit("attribute (color)")), "attribute "),
        (lambda: C.first_direction(lit("a dog below a cat left")), "below"),
        (lambda: C.first_direction(lit("a dog")), None),
        (lambda: C.pluralize(lit("bus")), "buses"),
        (lambda: C.pluralize(lit("church")), "churches"),
        (lambda: C.pluralize(lit("moth")), "moths"),
        (lambda: C.pluralize(lit("city")), "cities"),
        (lambda: C.pluralize(lit("toy")), "toys"),
        (lambda: C.count_total(lit("two dogs and 3 cats")), 5),
        (lambda: C.normalize_prediction(lit("(A) a dog")), "a"),
        (lambda: C.normalize_prediction(lit("B) cat")), "b"),
        (lambda: C.normalize_prediction(lit("Answer: First.")), "answer first"),
        (lambda: C.normalize_prediction(lit("First\nbecause")), "first"),
        (lambda: C.label_match(lit("A dog"), lit("A")), True),
        (lambda: C.label_match(lit("Answer: First"), lit("First")), True),
        (lambda: C.label_match(lit("second"), lit("First")), False),
        (lambda: C.char_bag_distance(lit("listen"), lit("silent")), 0),
        (lambda: C.char_bag_distance(lit("one cat"), lit("two cats")), 4),
        (lambda: C.replace_first(lit("a Red hat"), lit("red HAT"), lit("cap")), "a cap"),
        (lambda: C.replace_first(lit("a hat"), lit("dog"), lit("cat")), None),
        (lambda: C.swap_phrases(lit("A cat above a dog"), lit("a dog"), lit("a cat")), "a dog above a cat"),
        (lambda: C.swap_phrases(lit("a cat"), lit("a cat"), lit("a dog")), None),
        (lambda: C.add_article(lit("hour glass")), "an hour glass"),
        (lambda: C.article_to_one_before(lit("A dog and a cat"), lit("cat")), "A dog and one cat"),
        (lambda: C.one_fewer(lit(2), lit("dish")), "one dish"),
        (lambda: C.vqa_answer(lit("Yes.\nSure")), "yes"),
        (lambda: C.vqa_answer(lit("two Question: what")), "two"),
        (lambda: C.verdict(lit("hm")), "YES"),
        (lambda: C.sentence_case(lit("aBC")), "Abc"),
        (lambda: G.iou(G.box(0, 0, 100, 10), G.box(60, 0, 40, 10)), 0.4),
        (lambda: G.iou(G.box(0, 0, 100, 10), G.box(50, 0, 10, 10)), 0.1),
        (lambda: G.iou(G.box(0, 0, 100, 10), G.box(100, 0, 5, 5)), 0.0),
        (lambda: G.off_edges(G.box(-3, 500, 20, 12), lit(512), lit(512), 10)["x"], 7.0),
        (lambda: G.off_edges(G.box(-3, 500, 20, 12), lit(512), lit(512), 10)["y"], 490.0),
        (lambda: G.isolated_positions(F.array(G.box(0, 0, 10, 10), G.box(100, 0, 10, 10), G.box(120, 0, 10, 10))), [0]),
        (lambda: G.swapped_places(F.array(G.box(0, 0, 10, 20), G.box(100, 50, 30, 40)))[0]["x"], 100.0),
        (lambda: G.any_overlap(F.array(G.box(0, 0, 10, 10), G.box(10, 0, 5, 5))), False),
        (lambda: A.front(F.array(lit(1), lit(2), lit(3)), lit(2)), [3, 1, 2]),
        (lambda: A.regrouped(F.array(*map(lit, range(8))), 2, 2, 2), [[0, 1, 4, 5], [2, 3, 6, 7]]),
        (lambda: V.argmax(F.array(lit(1.0), lit(3.0), lit(3.0))), 1),
        (lambda: V.cosine(F.array(lit(0.0)), F.array(lit(1.0))), None),
        (lambda: P.text_task(F.array(lit("x"), lit("y"))), "Does this image best match: (A) x, or (B) y? Choices: A, B."),
        (lambda: P.filled(lit("{a} {b}"), {"a": lit("{b}"), "b": lit("z")}), "{b} z"),
        (lambda: R.parse_list(lit("['yes', 'no']")), ["yes", "no"]),
        (lambda: R.parse_list(lit("['yes'] junk")), None),
        (lambda: F.size(R.parse_boxes(lit("[('a', [1, 2, 3, 4]), (\"b\", (5, 6, 7.5, 8))]"))), 2),
        (lambda: R.parse_boxes(lit("__import__('os')")), None),
        (lambda: scorers.closest_choice(lit("cat"), F.array(lit("dog"), lit("cot"))), "cot"),
        (lambda: adapters.path_id(lit("a/b/c.png")), "a-b-c"),
    ],
)
def test_expressions(spark, expr, expected):
    got = value(spark, expr())
    assert got == (pytest.approx(expected) if isinstance(expected, float) else expected)


def test_questions(spark):
    text = "Question: Q1? Choices: ['yes', 'no'] Answer: yes"
    q = value(spark, R.parse_questions(lit(text)))
    assert [(x["question"], x["choices"], x["answer"]) for x in q] == [("Q1?", ["yes", "no"], "yes")]


def test_pair_accuracy_with_ties_and_nan(spark):
    rows = [("a", .9, .1, .2, .8), ("a", .5, .5, .4, .6), ("a", float("nan"), .1, .2, .3), ("b", .3, .2, .4, .5)]
    df = spark.createDataFrame(rows, "category string, T0_I0 double, T0_I1 double, T1_I0 double, T1_I1 double")
    got = {r["category"]: (r["text"], r["image"], r["group"], r["count"]) for r in metrics.pair_accuracy(df, ["category"]).collect()}
    assert got == {"a": (66.67, 33.33, 33.33, 3), "b": (0.0, 100.0, 0.0, 1)}
    assert metrics.pair_accuracy(df.limit(0)).first()["text"] is None


def test_half_even_rounding(spark):
    df = spark.range(800).withColumn("hit", F.col("id") == 0)
    assert df.agg(metrics.percent(F.col("hit")).alias("p")).first()["p"] == pytest.approx(0.12)


def test_majority_tie_goes_to_first_seen(spark):
    df = spark.createDataFrame([(1, 0, "NO"), (1, 1, "NO"), (1, 2, "YES"), (1, 3, "YES"), (1, 4, "YES"), (2, 0, "NO"), (2, 1, "YES")], "g int, i int, v string")
    assert {r["g"]: r["v"] for r in metrics.majority(df, ["g"], "v", "i").collect()} == {1: "YES", 2: "NO"}


@pytest.mark.parametrize("parts", [1, 5])
def test_candidates_do_not_depend_on_partitioning(spark, parts):
    df = spark.createDataFrame([(1, 0, .5), (1, 1, .7), (1, 2, .6), (2, 0, .5), (2, 1, 1.0), (2, 2, 1.0), (3, 0, None), (3, 1, float("nan"))], "g int, i int, s double").repartition(parts)
    assert {r["g"]: r["i"] for r in windows.best_candidate(df, ["g"], "s", "i").collect()} == {1: 1, 2: 1, 3: 0}
    assert {r["g"]: r["i"] for r in windows.first_perfect_else_last(df, ["g"], "s", "i").collect()} == {1: 2, 2: 1, 3: 1}


def test_rolling_meter_takes_lower_median(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 5)], "i int, v double").withColumn("g", F.lit(0))
    last = windows.rolling_meter(df, ["g"], [F.col("i")], "v").filter("i = 4").first()
    assert (last["median"], last["window_avg"], last["window_max"], last["last"]) == (2.0, 2.5, 4.0, 4.0)


def test_rolling_meter_in_blocks_is_the_same(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("g"), F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 101).cast("double")).alias("v"))
    meter = lambda block: sorted(map(str, windows.rolling_meter(df.repartition(5), ["g"], [F.col("id")], "v", 4, block).collect()))
    one = meter(10_000)
    assert len(one) == 300 and meter(7) == one and meter(2) == one


def test_stratified_quota(spark):
    df = spark.createDataFrame([("a", s, i) for s in "xyz" for i in range(9)], "c string, s string, i int")
    got = windows.stratified_quota(df, "c", "s", {"a": 10}, [F.col("i")]).groupBy("s").count().collect()
    assert sorted((r["s"], r["count"]) for r in got) == [("x", 3), ("y", 3), ("z", 3)]


def test_quota_keeps_uncapped_and_null_keys(spark):
    df = spark.createDataFrame([("1", i) for i in range(4)] + [("9", 1), (None, 2)], "k string, i int")
    got = windows.quota(df, "k", {"1": 2}, [F.col("i")]).collect()
    assert sorted((r["k"] or "", r["i"]) for r in got) == [("", 2), ("1", 0), ("1", 1), ("9", 1)]


def test_numbered_is_a_total_order(spark):
    df = spark.range(1000).withColumn("x", F.pmod(F.col("id") * 37, F.lit(1000))).repartition(7)
    got = windows.numbered(df, [F.col("x")], "n").collect()
    assert all(r["n"] == r["x"] for r in got) and len(got) == 1000
    large = spark.range(300_000).withColumn("x", F.pmod(F.col("id") * 7919, F.lit(300_000))).repartition(9)
    assert windows.numbered(large, [F.col("x")], "n").filter("n <> x").count() == 0


def test_upserts(spark):
    old = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    new = spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")
    rows = lambda df: {r["k"]: r["v"] for r in df.collect()}
    assert rows(upserts.old_wins(old, new, ["k"])) == {1: "old", 2: "old", 3: "new"}
    assert rows(upserts.new_wins(old, new, ["k"])) == {1: "old", 2: "new", 3: "new"}
    a = old.groupBy("k").agg(F.collect_list("v").alias("v")).withColumn("h", F.lit("old"))
    b = new.groupBy("k").agg(F.collect_list("v").alias("v")).withColumn("h", F.lit("new"))
    got = {r["k"]: (r["h"], r["v"]) for r in upserts.appended(a, b, "k", "v").collect()}
    assert got == {1: ("old", ["old"]), 2: ("old", ["old", "new"]), 3: ("new", ["new"])}


def test_boxes_without_overlap_checks_every_pair(spark):
    box = lambda i, x, y, w, h: (1, i, (float(x), float(y), float(w), float(h)))
    kind = "g int, k int, box struct<x:double,y:double,w:double,h:double>"
    left = spark.createDataFrame([box(1, 50, 0, 10, 10), box(2, 60, 0, 40, 10)], kind)
    right = spark.createDataFrame([box(3, 0, 0, 100, 10), box(4, 1, 0, 1, 1)], kind)
    assert [r["k"] for r in joins.without_overlap(left, right, ["g"], "k").collect()] == [1]


def test_neighbours_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = [(i, rng.standard_normal(8).tolist()) for i in range(120)] + [(200, None), (201, [0.0] * 8)]
    df = spark.createDataFrame(vectors, "id bigint, v array<double>").repartition(5)
    got = {r["query"]: r["match"] for r in joins.capped_neighbours(df, "id", "v", df.filter("id % 50 = 0"), 0.5).collect()}
    m = np.array([v for _, v in vectors[:120]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 50, 100):
        s = m @ m[q]
        s[q], s[s >= 0.5] = -9, -9
        assert got[q] == int(s.argmax())


@pytest.mark.parametrize("limit, least", [(0, 10), (0, 10**6), (1000, 10)])
def test_spread_join_each_way(spark, monkeypatch, limit, least):
    monkeypatch.setattr(skew, "HOT_LEAST", least)
    big = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).cast("int").alias("k"), "id")
    small = spark.createDataFrame([(1, "a"), (950, "b"), (5, "c")], "k int, v string")
    for how, n in (("inner", 901), ("left", 1000), ("left_semi", 901), ("left_anti", 99)):
        assert skew.spread_join(big, small, ["k"], how, max_rows=limit).count() == n


def test_hot_keys_are_joined_apart(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") < 20_000, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert skew.hot_split_join(rows, groups, "k", "n").count() == 40_000


def test_payload_shapes(spark):
    score = {"p.png": {"tifa_score": float("nan"), "question_details": {"q1?": None, "q2?": {"question": "q2?"}}}, "r.png": None}
    listed = {"s.png": {"question_details": json.dumps([{"question": "q3?"}, None])}}
    payloads = [
        json.dumps({"annotations": [{"edit_id": "a", "scores": score}, None, json.dumps({"scores": json.dumps(listed)})]}),
        json.dumps(json.dumps({"annotations": {"prompt": "x", "scores": None}})),
        json.dumps({"annotations": None}), None, " ", '{"annotations": [', json.dumps('{"broken'), "7",
    ]
    files = spark.createDataFrame(list(enumerate(payloads)), "file_id bigint, payload string").withColumn("node", F.lit("clash"))
    samples = spark.createDataFrame([(5, [("x",), None]), (6, None), (7, [])], "sample_id bigint, negatives array<struct<edited_image_path:string>>")
    got = sorted(tuple(r) for r in annotations.child_rows(samples, files).collect())
    a = "annotation_files"
    assert got == sorted([
        (a, 0, "annotation", 0, "", ""), (a, 0, "annotation", 2, "", ""), (a, 0, "score", 0, "p.png", ""), (a, 0, "score", 0, "r.png", ""), (a, 0, "score", 2, "s.png", ""),
        (a, 0, "question", 0, "p.png", "q1?"), (a, 0, "question", 0, "p.png", "q2?"), (a, 0, "question", 2, "s.png", "q3?"), (a, 1, "annotation", 0, "", ""),
        *[(a, i, "unreadable", 0, "", "") for i in (3, 4, 5, 6)], ("samples", 5, "negative", 0, "", ""),
    ])


@pytest.mark.parametrize("parts", [1, 20])
def test_elements_keyed_by_data_are_found(spark, parts):
    """A hundred payloads with a key each make an element keyed by data, however they are dealt out."""
    docs = [(i, json.dumps({"m": {f"k{i}": {"v": [1, 2]}}, "one": {"deep": {"x": 1}}})) for i in range(100)]
    df = spark.createDataFrame(docs, "id bigint, p string").repartition(parts)
    graph = inlining.Graph(df, "p", {}, {})
    assert graph.keyed == {"m"} and graph.modes == {("m", "{}"): inlining.MAP, ("m{}", "v"): inlining.LIST} and graph.tables == {"$", "m{}", "v"}
    rows = inlining.shred(df, "id", "p", {}, {})
    assert {r["node"]: r["count"] for r in rows.groupBy("node").count().collect()} == {"$": 100, "m{}": 100, "v": 200}
    assert json.loads(rows.filter("node = '$'").first()["inlined"]) == {"one.deep.x": 1}


def test_shared_and_recursive_elements_have_one_table(spark):
    tree = {"name": "a", "child": {"name": "b", "child": {"name": "c"}}, "owner": {"id": 1, "address": {"city": "x"}}}
    docs = [(1, json.dumps({"child": tree, "owner": {"id": 2}})), (2, json.dumps({"groups": [{"groups": [{"groups": [{"n": 3}], "n": 2}], "n": 1}]}))]
    df = spark.createDataFrame(docs, "id bigint, p string")
    assert inlining.Graph(df, "p", {}, {}).tables == {"$", "child", "owner", "groups"}
    rows = inlining.shred(df, "id", "p", {}, {}).withColumns({"own": inlining.element_key("id", F.col("steps")), "up": inlining.element_key("id", inlining.parent_steps(F.col("steps")))}).collect()
    by = {r["own"]: r for r in rows}
    found = sorted(((r["node"], json.loads(r["inlined"]), r["parent"], json.loads(by[r["up"]]["inlined"]) if r["parent"] else None) for r in rows if r["node"] != "$"), key=str)
    assert found == sorted([
        ("child", {"name": "a"}, "$", {}), ("child", {"name": "b"}, "child", {"name": "a"}), ("child", {"name": "c"}, "child", {"name": "b"}),
        ("groups", {"n": 1}, "$", {}), ("groups", {"n": 2}, "groups", {"n": 1}), ("groups", {"n": 3}, "groups", {"n": 2}),
        ("owner", {"id": 1, "address.city": "x"}, "child", {"name": "a"}), ("owner", {"id": 2}, "$", {}),
    ], key=str)
    assert len(by) == len(rows) == 10 and all(r["up"] in by for r in rows if r["parent"])


def test_every_repeated_part_has_a_table(spark):
    one = {"edit_id": "e", "bounding_boxes": [["a dog", [1, 2]], [3]], "diffusion_params": {"steps": 5, "scale": float("nan")}, "negative_prompt": "x", "parts": {"parts": [{"n": 1}]}}
    one["scores"] = {"p.png": {"tifa_score": 1, "note": "y", "question_details": {"q?": {"choices": ["yes", "no"], "hint": "z"}}}}
    docs = [(1, json.dumps({"input_caption": "c", "annotations": [one]})), (2, json.dumps({"annotations": {"parts": [{"parts": [{"n": 2}]}], "scores": {"r.png": {"question_details": [{"question": "q?", "choices": "maybe"}]}}}})), (3, "{")]
    files = spark.createDataFrame(docs, "file_id bigint, payload string")
    rows = annotations.every_element(files).collect()
    got = sorted((r["file_id"], r["node"], tuple(r["steps"]), r["fields"]) for r in rows if r["fields"])
    a, s, q = ("annotations", "0"), ("scores", "p.png"), ("question_details", "q?")
    assert [g for g in got if g[1] != "parts"] == sorted([
        (1, "$", (), {"input_caption": "c"}), (1, "annotations", a, {"edit_id": "e", "diffusion_params.steps": "5", "diffusion_params.scale": "NaN", "negative_prompt": "x"}),
        (1, "bounding_boxes[]", (*a, "bounding_boxes", "0", "[]", "0"), {"value": "a dog"}), (1, "bounding_boxes[][]", (*a, "bounding_boxes", "0", "[]", "1", "[]", "0"), {"value": "1"}),
        (1, "bounding_boxes[][]", (*a, "bounding_boxes", "0", "[]", "1", "[]", "1"), {"value": "2"}), (1, "bounding_boxes[]", (*a, "bounding_boxes", "1", "[]", "0"), {"value": "3"}),
        (1, "scores", (*a, *s), {"tifa_score": "1", "note": "y"}), (1, "question_details", (*a, *s, *q), {"hint": "z"}),
        (1, "choices", (*a, *s, *q, "choices", "0"), {"value": "yes"}), (1, "choices", (*a, *s, *q, "choices", "1"), {"value": "no"}),
        (2, "question_details", (*a, "scores", "r.png", *q), {"question": "q?", "choices": "maybe"}),
    ])
    # An element within itself, as a list below a single object and the other way round: one table.
    assert [g for g in got if g[1] == "parts"] == [(1, "parts", (*a, "parts", "0", "parts", "0"), {"n": "1"}), (2, "parts", (*a, "parts", "0", "parts", "0"), {"n": "2"})]
    keys = {r["element_key"] for r in rows}
    assert len(keys) == len(rows) and all(r["parent_key"] in keys for r in rows if r["node"] not in ("$", "unreadable"))
    assert annotations.flat_tables(files)["annotations"].filter("file_id = 1").first()["more"] == {"diffusion_params.scale": "NaN"}


def test_annotation_tables_keep_their_links(spark):
    root = "/root/testdata/sf0.001"
    t = annotations.flat_tables(spark.read.parquet(f"{root}/annotation_files.parquet"))
    assert t["scores"].join(t["annotations"], "annotation_key", "left_anti").count() == 0
    assert t["questions"].join(t["scores"], "score_key", "left_anti").count() == 0
    assert t["annotations"].count() == t["annotations"].select("annotation_key").distinct().count()


def test_empty_tables(spark):
    files = spark.createDataFrame([], "file_id bigint, payload string")
    samples = spark.createDataFrame([], "sample_id bigint, negatives array<struct<edited_image_path:string>>")
    assert annotations.child_rows(samples, files).count() == 0
    assert windows.keep_first(files, ["file_id"], [F.col("payload")]).count() == 0
    assert windows.numbered(files, [F.col("file_id")], "n").count() == 0


def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(2000)
    draw = lambda d: sorted(r["id"] for r in d.filter(S.chance(0.25, 3, F.col("id"))).collect())
    assert draw(df.repartition(1)) == draw(df.repartition(17))
    assert 380 < len(draw(df)) < 620


def test_readers_and_sinks(spark, tmp_path):
    assert readers.read_or_empty(spark, f"{tmp_path}/none", "a int").count() == 0
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "annotations.json").write_text('{"a": 1}')
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "annotations.json").write_text('{"a": ')
    docs = readers.directory_documents(spark, str(tmp_path), "a int").cache()
    good, bad = readers.quarantined(docs)
    assert [r["image_id"] for r in good.collect()] == ["x"] and [r["image_id"] for r in bad.collect()] == ["y"]
    (tmp_path / "c1.json").write_text('{"k": "old", "m": "x"}')
    (tmp_path / "c2.json").write_text('{"k": "new"}')
    assert {r["key"]: r["value"] for r in readers.keyed_documents(spark, f"{tmp_path}/c*.json", "string").collect()} == {"k": "new", "m": "x"}
    rows = spark.createDataFrame([("object", 'a "b"\tc'), ("zzz", "d")], "category string, t string")
    sinks.tsv_by_category(rows, f"{tmp_path}/out")
    back = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(f"{tmp_path}/out")
    assert [tuple(r) for r in back.collect()] == [('a "b" c', "object")]
    with pytest.raises(FileNotFoundError):
        readers.prompt_template(spark, f"{tmp_path}/nothing.json")
    with pytest.raises(KeyError):
        registry.splits("nothing")


def test_positives_once_per_category(spark):
    n = [(None, "e", "p", "q", c, "s", str(i), None) for i, c in enumerate("xxy")]
    kind = "sample_id int, image_id string, image_path string, caption string, source string, negatives array<struct<edited_image_path:string,edited_caption:string,input_phrase:string,edited_phrase:string,category:string,sub_category:string,edit_id:string,region_crop_bool:boolean>>"
    rows = dataset.contrastive_rows(spark.createDataFrame([(1, "i", "path", "cap", "coco", n)], kind)).collect()
    assert sorted(r["caption"] for r in rows) == ["Cap."] * 2 + ["E."] * 3


def test_queries_have_columns_of_their_sql(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_versions_merge_and_gaps_raise(spark, tmp_path, monkeypatch):
    """What came before is never lost silently: a missing version raises, for the reader and for the next batch."""
    import shutil

    monkeypatch.setattr(resume, "WHOLE", 3)
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    run = lambda: resume.process_new(spark, src, "k bigint, v string", check, lambda b: b, out, ["k"]).awaitTermination()
    for n in range(5):
        spark.createDataFrame([(n, f"{n}"), (100, f"last {n}")], "k bigint, v string").write.mode("append").parquet(src)
        run()
    got = {r["k"]: r["v"] for r in resume.latest(spark, out, ["k"]).collect()}
    assert got == {**{n: f"{n}" for n in range(5)}, 100: "last 4"} and (tmp_path / "out" / "whole=2").exists()
    shutil.rmtree(tmp_path / "out" / "v=4")
    spark.createDataFrame([(7, "7")], "k bigint, v string").write.mode("append").parquet(src)
    with pytest.raises(Exception, match="missing"):
        run()
    shutil.rmtree(tmp_path / "out" / "v=3")
    spark.createDataFrame([(4, "4")], "k bigint, v string").write.parquet(f"{out}/v=4")
    with pytest.raises(FileNotFoundError):
        resume.latest(spark, out, ["k"])


def test_demos_of_each_class(spark):
    rows = spark.range(60).select("id", (F.col("id") % 2).alias("c"), (F.col("id") % 3 == 0).alias("ok"), (F.col("id") / 60).alias("s"))
    got = joins.class_demos(rows, ["c"], "ok", "s", [F.col("id")], 4, 1, F.col("id")).collect()
    assert len(got) == 8 and sorted((r["c"], r["turn"]) for r in got) == [(c, t) for c in (0, 1) for t in (1, 2, 3, 4)]
    best = {(c, ok): sorted((i for i in range(60) if i % 2 == c and (i % 3 == 0) == ok), reverse=True)[:6] for c in (0, 1) for ok in (True, False)}
    assert all(r["id"] in best[r["c"], r["ok"]] for r in got)
    assert joins.class_demos(rows.limit(0), ["c"], "ok", "s", [F.col("id")], 4, 1, F.col("id")).count() == 0


def test_joins_of_sides_that_are_more_than_scans(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_LEAST", 10)
    big = spark.range(1000).groupBy((F.col("id") % 7).alias("k"), "id").count()
    small = spark.range(7).groupBy(F.col("id").alias("k")).agg(F.max("id").alias("v"))
    assert skew.spread_join(big, small, ["k"], max_rows=3).count() == 1000
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 1)
    assert skew.spread_join(big, small, ["k"]).count() == 1000
    left, right = spark.range(300).select(F.lit(None).cast("int").alias("k"), F.col("id").alias("a")), spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias("b"))
    assert skew.pair_join(left, right, ["k"], "a", "b", 10).count() == 0 and skew.pair_join(right.withColumnRenamed("b", "a"), right, ["k"], "a", "b", 10).count() == 90_000
