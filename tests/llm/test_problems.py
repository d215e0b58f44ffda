"""Training-data operators against brute force and on edge cases."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm.components import components
from pairloom.operators import skew
from pairloom.llm import cutoffs, format_ledger, latent_leaks, mixing, quota_sample, records, residue, response_defects, split_overlap

DATA = "/root/testdata/sf0.001"


# --- 1: cutoffs

def brute_cutoffs(rows, targets):
    out = {}
    for g, percent in targets.items():
        s = sorted((x for k, x in rows if k == g and x is not None and not math.isnan(x)), reverse=True)
        need = -(-percent * len(s) // 100)
        if not need:
            out[g] = (None, 0, 0, len(s))
            continue
        c = s[need - 1]
        out[g] = (c, sum(x >= c for x in s), s.count(c), len(s))
    return out


@pytest.mark.parametrize("bracket, rounds", [(5, 12), (5, 0), (200_000, 12)])
def test_cutoffs_are_exact(spark, monkeypatch, bracket, rounds):
    monkeypatch.setattr(cutoffs, "BRACKET_ROWS", bracket)
    monkeypatch.setattr(cutoffs, "MAX_ROUNDS", rounds)
    r = random.Random(5)
    rows = [("hot", r.choice([0.0, 0.25, 0.5, 1.0])) for _ in range(3000)] + [("fine", r.random()) for _ in range(3000)]
    rows += [("few", x) for x in (1.0, None, float("nan"), -0.0, float("inf"))] + [("none", None), (None, 1.0), ("other", 1.0)]
    targets = {"hot": 40, "fine": 37, "few": 50, "none": 50, "missing": 10, "zero": 0}
    df = spark.createDataFrame(rows, "g string, score double").withColumn("cutoff", F.lit("x")).withColumn("percent", F.lit("x")).withColumn("need", F.lit(0))
    aims = spark.createDataFrame(list(targets.items()) + [("hot", 10)], "g string, keep_percent int")
    limits, scored = cutoffs.fraction_cutoffs(df, aims, ["g"])
    got = {x["g"]: (x["cutoff"], x["kept"], x["ties"], x["records"]) for x in limits.collect()}
    assert got == brute_cutoffs(rows, targets)
    assert cutoffs.kept_rows(scored, limits, ["g"]).count() == sum(v[1] for v in got.values())


def test_cutoffs_of_nothing(spark):
    df = spark.createDataFrame([], "g string, score double")
    aims = spark.createDataFrame([("a", 40)], "g string, keep_percent int")
    limits, scored = cutoffs.fraction_cutoffs(df, aims, ["g"])
    assert [(x["cutoff"], x["kept"]) for x in limits.collect()] == [(None, 0)] and scored.count() == 0
    assert cutoffs.fraction_cutoffs(df, aims.limit(0), ["g"])[0].count() == 0


def test_latest_score_row_counts(spark):
    samples = spark.createDataFrame([(" COCO", [("p", "Object (x)"), ("p", "object"), (None, "object"), ("q", None)])], "source string, negatives array<struct<edited_image_path:string,category:string>>")
    samples = samples.withColumn("negatives", F.transform("negatives", lambda n: F.struct(n["edited_image_path"].alias("edited_image_path"), n["category"].alias("category"), F.lit("s").alias("sub_category"))))
    scores = spark.sql("select * from values (1L, 'p', 0.5D, timestamp_ntz'2024-01-01 00:00:00'), (2L, 'p', double('nan'), timestamp_ntz'2024-02-01 00:00:00'), (3L, 'p', 0.7D, null), (4L, 'z', 1D, null) as t(score_id, edited_image_path, tifa_score, scored_at)")
    got = records.scored_records(samples, scores).collect()
    assert [(x["source"], x["category"], x["score_id"]) for x in got] == [("coco", "object", 2)]


# --- 2: quota sample

def test_tilted_probabilities_meet_their_targets():
    n, w = np.array([100.0, 5.0, 7.0, 1e9]), np.array([13.0, 5.0, 1.0, 3.0])
    p = quota_sample.tilted_probabilities(n, [np.arange(4)], w, 0.2)
    assert np.allclose(n * p, w, atol=1e-3) and p.max() <= 1


def test_tilting_on_two_margins():
    """Rows and columns of a table are met together, floors are kept, and the solution is the tilted one."""
    r = np.random.default_rng(5)
    sizes = r.integers(20, 400, 30).astype(float)
    rows, columns = np.repeat(np.arange(5), 6), np.tile(np.arange(6), 5)
    aim = sizes * r.uniform(0.02, 0.6, 30)
    wanted = np.concatenate([np.bincount(rows, aim), np.bincount(columns, aim)])
    p = quota_sample.tilted_probabilities(sizes, [rows, columns + 5], wanted, 0.1)
    assert np.allclose(np.bincount(rows, sizes * p), wanted[:5]) and np.allclose(np.bincount(columns, sizes * p), wanted[5:]) and (p <= 1).all()
    log = np.log(p[p < 1 - 1e-9] / 0.1)  # a sum of a row's and a column's term
    design = np.concatenate([np.eye(5)[rows], np.eye(6)[columns]], 1)[p < 1 - 1e-9]
    assert np.abs(design @ np.linalg.lstsq(design, log, rcond=None)[0] - log).max() < 1e-6
    least = np.minimum(3 / sizes, 1) * (np.arange(30) % 2)
    p = quota_sample.tilted_probabilities(sizes, [rows, columns + 5], wanted, 0.1, least)
    assert (p >= least - 1e-12).all() and np.allclose(np.bincount(rows, sizes * p), wanted[:5])


def test_pivotal_keeps_size_and_probabilities():
    rng, p = np.random.default_rng(1), np.array([0.2, 0.5, 0.8, 0.3, 0.7, 0.5])
    draws = np.array([quota_sample.pivotal(p, rng.random(6)) for _ in range(20_000)])
    draws[np.abs(draws - 1) < 1e-9] = 1
    assert np.allclose(draws.sum(1), 3) and np.allclose(draws.mean(0), p, atol=0.02)


@pytest.mark.parametrize("block", [20_000, 16])
def test_sample_meets_targets_and_floors(spark, monkeypatch, block):
    monkeypatch.setattr(quota_sample, "BLOCK_ROWS", block)
    df = spark.range(3000).select(F.concat(F.lit("p"), "id").alias("path"), F.when(F.col("id") % 3 > 0, "a").when(F.col("id") < 60, "b").otherwise("c").alias("cat"), F.lit("s").alias("sub"), F.lit(1).alias("need"))
    aims = spark.createDataFrame([("a", "s", 500, 1, 9), ("b", "s", 100, 2, 9), ("c", "s", 10, 7, 9), ("d", "s", 0, 2, 9), ("e", "s", 0, 0, 9)], "cat string, sub string, target_permille int, min_rows int, records int")
    cells = quota_sample.quota_cells(df, aims, ["cat", "sub"])
    assert {r["cat"]: (r["records"], r["need"], r["shortfall"]) for r in cells.collect()} == {"a": (2000, 150, 0), "b": (20, 30, 10), "c": (980, 7, 0), "d": (0, 2, 2), "e": (0, 0, 0)}
    draw = lambda parts: quota_sample.quota_sample(df.repartition(parts), cells, ["cat", "sub"], "path").collect()
    one, two = draw(1), draw(9)
    assert sorted(one) == sorted(two) and len({r["path"] for r in one}) == len(one)
    assert collections.Counter(r["cat"] for r in one) == {"a": 150, "b": 20, "c": 7}


def test_sample_of_nothing(spark):
    df = spark.createDataFrame([], "path string, cat string")
    aims = spark.createDataFrame([("a", 500, 1)], "cat string, target_permille int, min_rows int")
    cells = quota_sample.quota_cells(df, aims, ["cat"])
    assert cells.first()["shortfall"] == 1 and quota_sample.quota_sample(df, cells, ["cat"], "path").count() == 0


# --- 3: response defects

EN = "A tired nurse holds a red umbrella behind the old museum on a rainy morning."
CASES = [
    (EN, "a red umbrella", "a blue kite", "A tired nurse holds a blue kite behind the old museum on a rainy morning.", None),
    (EN, "a red umbrella", "a blue kite", "a tired nurse holds a blue kite behind the old museum on a rainy morning", None),
    (EN, "a red umbrella", "a blue kite", "A nurse with a blue kite.", None),
    (EN, "a red umbrella", "a blue kite", "Tired nurse with a blue kite", None),
    (EN, "a red umbrella", "a blue kite", "A tired nurse holds a blue kite", "truncated"),
    (EN, "a red umbrella", "a blue kite", "A tired nurse holds a blue ki", "truncated"),
    (EN, "a red umbrella", "a blue kite", "A tired nurse holds a blue kite behind the ol", "truncated"),
    (EN, "a red umbrella", "a blue kite", "A tired nurse holds a blue kite behind the...", "truncated"),
    (EN, "a red umbrella", "a blue kite", "A tired nurse holds a", "truncated"),
    (EN, "a red umbrella", "a blue kite", "I'm sorry, but this can't be edited.", "refusal"),
    (EN, "a red umbrella", "Je regrette, mais je ne peux pas vous aider.", "", "refusal"),
    (EN, "a red umbrella", "a blue kite", "A tired nurse holds a blue kite behind the old museum on a rainy morning with a sign reading \"Sorry, we cannot open today\".", None),
    (EN, "a red umbrella", "a blue kite", None, "empty"),
    (EN, "a red umbrella", "N/A", "A tired nurse holds a blue kite.", "empty"),
    (EN, "a red umbrella", "a blue kite", "​…", "empty"),
    (EN, "a red umbrella", "a blue kite", "Eine Krankenschwester hält einen Drachen hinter dem Museum an einem regnerischen Morgen.", "other_language"),
    (EN, "a red umbrella", "a blue kite", "Медсестра держит воздушного змея за музеем.", "other_language"),
    ("Un caballo blanco encuentra un paraguas rojo en la terraza en un día de viento.", "un paraguas rojo", "una cometa", "A white horse finds a green kite on the terrace on a windy day.", "other_language"),
    (EN, "a red umbrella", "a blue kite", "A tired nurse holds a blue kite behind the old museum on a rainy morning near a \"Geschlossen am Montag und an dem Feiertag\" sign.", None),
    (EN, "a red umbrella", "a red umbrella", "EDITED CAPTION: a_tired_nurse holds a RED umbrella, behind the old museum on a rainy morning", "copy"),
    ("Ein Hund in der Straße.", "ein Hund", "ein Hund", "EIN HUND IN DER STRASSE!", "copy"),
    (None, None, "a blue kite", "A blue kite.", None),
]


@pytest.mark.parametrize("prompt, selected, phrase, caption, defect", CASES)
def test_defect(prompt, selected, phrase, caption, defect):
    own = response_defects.defect_of(prompt, selected, phrase, caption)
    assert own == defect or defect == "refusal"


def test_defects_of_rows(spark):
    df = spark.createDataFrame([(n, *case[:4]) for n, case in enumerate(CASES)], "id bigint, i string, s string, p string, c string").withColumn("kind", F.lit("x")).withColumn("cue", F.lit("x"))
    got = {r["id"]: r["defect"] for r in response_defects.response_defects(df, "id", "i", "s", "p", "c").collect()}
    assert got == {n: case[4] for n, case in enumerate(CASES) if case[4]}


def test_components(spark):
    r = random.Random(6)
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(0, 60)] + [("hub", f"leaf{i}") for i in range(50)] + [("x", "x"), (None, "y")]
    edges += [(f"r{r.randrange(90):02}", f"r{r.randrange(90):02}") for _ in range(60)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a and b and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = components(spark.createDataFrame(edges, "a string, b string")).collect()
    assert {(x["node"], x["root"]) for x in got} == {(a, find(a)) for a in root} and len(got) == len(root)
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_clusters_join_transitively_and_decide(spark, monkeypatch):
    """A chain of openings, each near the next only, is one cluster; without links fewer refusals are found."""
    words = "Kindly leave every part of that lovely picture exactly as they made that thing for my sake and none other".split()
    chain = [" ".join([*(f"new{k}" for k in range(i)), *words[i:]]) for i in range(5)]
    prompts = "dog cat bus cow hen".split()
    rows = [(i, f"{w} stands beside a {w}ish fence", "x", "a green kite", c) for i, (w, c) in enumerate(zip(prompts, chain))]
    df = spark.createDataFrame(rows, "id bigint, i string, s string, p string, c string")
    found = lambda: {r["id"] for r in response_defects.response_defects(df, "id", "i", "s", "p", "c").filter("defect = 'refusal'").collect()}
    assert found() == set(range(5))
    monkeypatch.setattr(response_defects, "opening_links", lambda openings: openings.select(F.col("opening").alias("a"), F.col("opening").alias("b"), "kind").limit(0))
    assert found() == set()
    monkeypatch.undo()
    monkeypatch.setattr(response_defects, "refusal_templates", lambda f: f.select("opening", "kind").limit(0))
    cases = spark.createDataFrame([(n, *case[:4]) for n, case in enumerate(CASES)], df.schema)
    assert response_defects.response_defects(cases, "id", "i", "s", "p", "c").filter("defect = 'refusal'").count() == 0


def test_links_against_brute_force(spark):
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = set()
    for _ in range(25):
        base = r.sample(vocabulary, 12)
        for _ in range(6):
            w = list(base)
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.add(" ".join(w))
    near = lambda a, b: len(set(a.split()) & set(b.split())) >= 0.8 * len(set(a.split()) | set(b.split()))
    want = {(a, b) for a in texts for b in texts if a < b and near(a, b)}
    got = {tuple(sorted((x["a"], x["b"]))) for x in response_defects.opening_links(spark.createDataFrame([(t, 0) for t in texts], "opening string, kind int")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


@pytest.mark.parametrize("pairs_a_row", [64, 0])
@pytest.mark.parametrize("crowd", [True, False])
def test_links_join_all_that_brute_force_joins(spark, monkeypatch, pairs_a_row, crowd):
    """None is missed, among hundreds that share ten words of twelve or at any length; the pairs compared at once and those after clusters."""
    monkeypatch.setattr(response_defects, "PAIRS_A_ROW", pairs_a_row, raising=False)
    r = random.Random(7)
    if crowd:
        common = [f"c{i}" for i in range(10)]
        texts = {" ".join([*common, f"own{i}", last]) for i in range(300) for last in (f"x{i}", f"y{i}")}
    else:
        texts = set()
        for n in range(1, 25):
            for _ in range(6):
                base = r.sample([f"w{i}" for i in range(30)], n)
                for _ in range(4):
                    w = [x for x in base if r.random() < 0.95] + [f"w{r.randrange(30)}"] * r.randrange(2)
                    r.shuffle(w)
                    texts.add(" ".join(w or base))
    sets = {t: set(t.split()) for t in texts}
    want = {(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    rows = spark.createDataFrame([(t, kind) for t in sorted(texts) for kind in (0, 1)], "opening string, kind int")
    links = response_defects.opening_links(rows).collect()
    for kind in (0, 1):
        got = {tuple(sorted((x["a"], x["b"]))) for x in links if x["kind"] == kind}
        assert got <= want and len(want) > 250 and (pairs_a_row == 0 or got == want)
        assert _joined(texts, got) == _joined(texts, want)


def _joined(nodes, edges):
    root = {n: n for n in nodes}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {n: low if x == high else x for n, x in root.items()}
    return root


def test_templates_that_recur_across_prompts(spark):
    rows = [(i, f"{w} stands beside a {w}ish fence", "x", f"a {w}", "There isn't much that I would alter in here") for i, w in enumerate("dog cat bus cow hen".split())]
    rows += [(10 + i, f"{w} stands beside a fence", w, "a green kite", f"{w} flies a green kite.") for i, w in enumerate("dog cat bus cow hen".split())]
    rows += [(10, "cat stands beside a fence", "cat", "a green kite", "cat flies a green kite.")]
    df = spark.createDataFrame(rows, "id bigint, i string, s string, p string, c string").withColumn("defect", F.lit("x")).withColumn("opening", F.lit("x"))
    got = {r["id"]: r["defect"] for r in response_defects.response_defects(df, "id", "i", "s", "p", "c").collect()}
    assert got == {i: "refusal" for i in range(5)}
    assert response_defects.response_defects(df.limit(0), "id", "i", "s", "p", "c").count() == 0


def test_templates_with_a_word_that_varies(spark):
    things, odd = "dog cat bus cow hen".split(), "lovely splendid charming pleasing tidy".split()
    answers = {
        "of the prompt": [f"That {w} keeps my eyes glad and none calls for another touch" for w in things],
        "in a short answer": [f"My eyes find that {w} perfect, none lacking" for w in things],
        "of its own": [f"That {o} scene keeps my eyes glad and none of it calls for another touch" for o in odd],
        "put in": [f"Every {o} line pleases my eyes, none lacking" for o in (*odd[:4], "")],
        "before free words": [f"This {o} view gives my heart peace and none of it wants work {' '.join(w + str(k) for k in range(9))}" for o, w in zip(odd, things)],
    }
    rows = [(f"{kind} {i}", f"{things[i]} stands beside a {things[i]}ish fence", "x", "a green kite", c) for kind, cs in answers.items() for i, c in enumerate(cs)]
    assert all(response_defects._cue(r[4], r[1], False) == 1 for r in rows)
    # The words of one prompt only, and captions without a cue, are no refusals.
    rows += [(f"one prompt {i}", "a red cart rolls by", "x", "a green kite", f"Those {o} hills make my day complete and none of them wants any more light") for i, o in enumerate(odd)]
    rows += [(f"caption {i}", f"{w} stands beside a {w}ish fence", "x", "a green kite", f"Two {o} horses gallop over golden meadows under heavy clouds while children wave") for i, (w, o) in enumerate(zip(things, odd))]
    df = spark.createDataFrame(rows, "id string, i string, s string, p string, c string")
    got = {r["id"] for r in response_defects.response_defects(df, "id", "i", "s", "p", "c").filter("defect = 'refusal'").collect()}
    assert got == {f"{kind} {i}" for kind in answers for i in range(5)}


def test_prompts_with_a_common_beginning_differ(spark):
    rows = [(i, f"There is a man in the {w}", "x", "a green kite", "My eyes find every part perfect, none lacking") for i, w in enumerate("park house river".split())]
    df = spark.createDataFrame(rows, "id bigint, i string, s string, p string, c string")
    assert {r["id"] for r in response_defects.response_defects(df, "id", "i", "s", "p", "c").filter("defect = 'refusal'").collect()} == {0, 1, 2}


# --- 4: overlaps

def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_overlaps_are_complete(spark):
    r, vocabulary, rows = random.Random(2), "a b c d e f g h".split(), []
    bases = [[r.choice(vocabulary) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 6, 7, 9, 12, 20) for _ in range(6)]
    for i in range(500):
        w = list(r.choice(bases))
        for _ in range(r.randrange(4)):
            k, at = r.randrange(3), r.randrange(len(w) + 1)
            if k == 0:
                w.insert(at, r.choice(vocabulary))
            elif w:
                at = min(at, len(w) - 1)
                w[at : at + 1] = [] if k == 1 else [r.choice(vocabulary)]
        rows.append((i, None, r.choice([" ", "--", ", "]).join(w).upper() + ".", r.choice(["train", "train ", "TEST", "validation", "x", None])))
    rows += [(600, "a/0007.jpg?x=9", None, "train"), (601, "b\\IMG_2_7.png ", None, "test"), (602, "7/none.jpg", None, "test"), (603, "a/007", None, "validation"), (604, None, None, "test"), (605, "00.jpg", None, "test"), (606, "0", "", "train")]
    df = spark.createDataFrame(rows, "id bigint, path string, text string, split string").withColumn("held", F.lit(1)).withColumn("number", F.lit("7"))
    got = sorted((p["train_id"], p["held_id"]) for p in split_overlap.Overlap(df, "id", "path", "text", "split").pairs().collect())
    words = {i: re.findall(r"[^\W_]+", t.lower()) if t is not None else None for i, _, t, _ in rows}
    number = {600: "7", 601: "7", 603: "7", 605: "0", 606: "0"}
    train = [i for i, *_, s in rows if s and s.strip().lower() == "train"]
    held = [i for i, *_, s in rows if s and s.strip().lower() in ("test", "validation")]
    near = lambda a, b: words[a] is not None and words[b] is not None and word_distance(words[a], words[b]) <= 2
    want = sorted((a, b) for a in train for b in held if (a in number and number.get(a) == number.get(b)) or near(a, b))
    assert got == want
    counts = split_overlap.overlap_counts(split_overlap.Overlap(df, "id", "path", "text", "split"), df.withColumn("source", F.lit("S ")), "id", "split", "source").collect()
    assert sum(c["pairs"] for c in counts) == len(want) and {c["source"] for c in counts} == {"s"}


def test_overlaps_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, path string, text string, split string")
    overlap = split_overlap.Overlap(df, "id", "path", "text", "split")
    assert overlap.pairs().count() == 0 and overlap.row_counts().count() == 0


def test_one_caption_and_one_picture_many_times(spark, monkeypatch):
    """A class with most of the rows is paired in blocks: no task makes many more pairs than the others."""
    df = spark.range(1200).select("id", F.when(F.col("id") % 3 == 0, "a/7.jpg").alias("path"), F.when(F.col("id") % 2 == 0, "one caption again and again").otherwise("x y").alias("text"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"))
    overlap = split_overlap.Overlap(df, "id", "path", "text", "split")
    pairs = overlap.pairs()
    rows = df.collect()
    want = sum(1 for a in rows if a["split"] == "train" for b in rows if b["split"] == "test" and (a["text"] == b["text"] or (a["path"] and b["path"])))
    assert pairs.count() == want == pairs.distinct().count() == sum(r["pairs"] for r in overlap.row_counts().collect())
    left = df.filter("split = 'train'").select(F.lit("k").alias("k"), F.col("id").alias("a"))
    right = df.filter("split = 'test'").select(F.lit("k").alias("k"), F.col("id").alias("b"))
    sizes = [r["count"] for r in skew.pair_join(left, right, ["k"], "a", "b", block=50).groupBy(F.pmod(F.xxhash64("a"), F.lit(20)), F.pmod(F.xxhash64("b"), F.lit(5))).count().collect()]
    assert sum(sizes) == 960 * 240 and max(sizes) < 3 * 960 * 240 / len(sizes)


def test_picture_number_of_long_and_odd_paths(spark):
    cases = {"/a/COCO_train2014_000000123.jpg": "123", "x.tar.gz": None, "img-7.webp?size=3&v=9": "7", "  ./a/12.PNG ": "12", "": None, "9" * 50 + ".jpg": "9" * 50, ".5": "5", "a/b/": None}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r["p"]: r["n"] for r in df.select("p", split_overlap.picture_number(F.col("p")).alias("n")).collect()} == cases


# --- 5: ledger

def test_ledger_over_batches_equals_one_count(spark):
    r, rows = random.Random(4), []
    for i in range(400):
        c = r.choice(["A dog.", "a DOG", "a-d-o-g", "a cat", None, "", "…", "Straße", "STRASSE"])
        n = r.choice([None, [], ["x", "Y"], ["y!", " X"], ["x"], [None], [""], ["x", None]])
        rows.append((i, c, n, r.choice([0, 1, 2, None])))
    df = spark.createDataFrame(rows, "id bigint, c string, n array<string>, b int").withColumn("copies", F.lit("x"))
    keyed = df.select("*", format_ledger.canonical_key(F.col("c"), F.col("n")).alias("key"))
    entries, copies = format_ledger.collapse(keyed, "key", "id", [F.coalesce(F.col("b") == i, F.lit(False)) for i in (2, 0, 1)] + [F.col("b").isNull()])
    norm = lambda s: "".join(ch for ch in (s or "").casefold() if ch.isalnum())
    groups = collections.defaultdict(list)
    for i, c, n, _ in rows:
        if c is not None:
            groups[norm(c), tuple(sorted(map(norm, n or [])))].append(i)
    assert sorted((e["keep"], e["copies"]) for e in entries.collect()) == sorted((min(g), len(g)) for g in groups.values())
    assert sorted((x["keep"], x["copy"]) for x in copies.collect()) == sorted((min(g), i) for g in groups.values() for i in g if i != min(g))


def test_ledger_over_sessions(spark, tmp_path, monkeypatch):
    """A second session opens the ledger by its path, adds a batch and reads only the buckets it touches; a failed or repeated update changes nothing."""
    path = str(tmp_path / "ledger")
    monkeypatch.setattr(format_ledger, "BUCKET_ROWS", 100)
    rows = lambda lo, hi: spark.range(lo, hi).select("id", F.unhex(F.md5((F.col("id") % 500).cast("string"))).alias("key"))
    first = format_ledger.Ledger(spark, path, rows=500)
    first.update(rows(0, 900), "key", "id", name="monday")
    assert first.state["buckets"] == 5 and len(first.state["base"]) == 5 and not first.state["delta"]
    again = format_ledger.Ledger(spark.newSession(), path)
    again.update(rows(0, 900), "key", "id", name="monday")
    assert again.version == first.version == 1
    again.update(rows(900, 903), "key", "id", name="tuesday")  # small: it stays beside the buckets it touches
    assert 1 <= len(again.state["delta"]) <= 3
    with pytest.raises(RuntimeError):
        first.update(rows(903, 904), "key", "id")
    assert first.version == 1 and not first.state["delta"]
    third = format_ledger.Ledger(spark.newSession(), path)
    third.update(rows(903, 1700), "key", "id")
    third.vacuum()
    last = format_ledger.Ledger(spark.newSession(), path)
    got = {(r["keep"], r["copies"]) for r in last.read().collect()}
    assert got == {(i, len(range(i, 1700, 500))) for i in range(500)} and last.version == 3
    one = last.read([2])
    assert {r["bucket"] for r in one.select("bucket").distinct().collect()} == {2} and all("bucket=2" in f for f in one.inputFiles())


def test_ledger_of_nothing(spark):
    keyed = spark.createDataFrame([], "id bigint, key binary")
    entries, copies = format_ledger.collapse(keyed, "key", "id", [F.lit(True)])
    assert entries.count() == 0 and copies.count() == 0


# --- 7: leaks

def leaked_by_brute_force(docs, items):
    runs = collections.defaultdict(set)
    for name, text in items:
        w = latent_leaks.clean_words(text)
        for i in range(len(w) - 9):
            runs[tuple(w[i : i + 10])].add(name)
    out = set()
    for key, text in docs:
        w = latent_leaks.clean_words(text)
        for i in range(len(w) - 9):
            out |= {(key, n) for n in runs.get(tuple(w[i : i + 10]), ())}
    return out


def test_clean_words():
    assert latent_leaks.clean_words("A&nbsp;<b>re</b>d <br>Ｃar &amp; to​y&#32;co\xadde") == ["a", "red", "car", "toy", "code"]
    assert latent_leaks.clean_words(None) == [] and latent_leaks.clean_words("<p>") == []
    assert latent_leaks.clean_words("1 < 2 > 0") == ["1", "2", "0"]


@pytest.mark.parametrize("chunk", [60_000, 70])
def test_leaks_are_complete(spark, monkeypatch, chunk):
    monkeypatch.setattr(latent_leaks, "CHUNK", chunk)
    r, vocabulary = random.Random(9), [f"w{i}" for i in range(400)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(f"b{i}", " ".join(say(r.randrange(8, 45)))) for i in range(40)] + [("b0", " ".join(say(30))), ("twin", "")]
    docs = []
    for i in range(150):
        text = say(r.randrange(0, 300))
        for _ in range(r.randrange(3)):
            w = r.choice(items)[1].split()
            n = r.choice([9, 10, 11, 25])
            s = r.randrange(max(1, len(w) - n + 1))
            at = r.randrange(len(text) + 1)
            text[at:at] = w[s : s + n]
        docs.append((i, ", ".join(text).upper()))
    docs += [(900, None), (901, ""), (902, "  "), (903, docs[3][1])]
    df = spark.createDataFrame(docs, "id bigint, text string").withColumn("norm", F.lit(1)).withColumn("t", F.lit(1)).withColumn("item", F.lit(1))
    index = latent_leaks.LatentIndex(df, "id", "text")
    tests = spark.createDataFrame([*items, ("b1", None), (None, docs[4][1])], "name string, said string")
    found = lambda **k: {(x["id"], x["item"]) for x in latent_leaks.leaked(index, tests, "name", ["said"], **k).collect()}
    want = leaked_by_brute_force(docs, items)
    assert found(min_cosine=-1.0) == want and len(want) > 20
    # The rows are of the latent search: what isn't near by it isn't found.
    got = found()
    assert got <= want and len(got) >= 0.9 * len(want)
    assert len(found(min_cosine=0.9)) < len(got)
    monkeypatch.setattr(latent_leaks, "BLOCK_CHARS", 2_000)
    assert found() == got


def test_leaks_in_the_test_tables(spark):
    """Recall of at least 0.9 at the production threshold, by which most pairs of passage and window are no candidates."""
    docs, pairs = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/bench_pairs.parquet")
    index = latent_leaks.LatentIndex(docs, "doc_id", "text")
    got = {(x["doc_id"], x["item"]) for x in latent_leaks.leaked(index, pairs, "id", ["caption_0", "caption_1"]).collect()}
    want = leaked_by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["id"], r[c]) for r in pairs.collect() for c in ("caption_0", "caption_1")])
    assert got <= want and len(got) >= 0.9 * len(want)
    said = [latent_leaks.clean_words(r[c]) for r in pairs.collect() for c in ("caption_0", "caption_1")]
    q = latent_leaks._Queries(index.basis, said, latent_leaks.STEP)
    rows = [np.array([latent_leaks._term(w) for w in latent_leaks.clean_words(r["text"])[:20]]) for r in docs.collect() if r["text"] and r["text"].strip()]
    unit = latent_leaks._unit(np.array([index.basis[r].sum(0) for r in rows if len(r)], np.float32))
    assert sum(len(p) for p, _ in q.candidates(unit, latent_leaks.MIN_COSINE)) < 0.2 * len(unit) * len(q.windows)


def test_common_runs():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 3, (300, 20)), r.integers(0, 3, (300, 20))
    b[:150, 4:15], a[:150, 3:14] = b[:150, 4:15], b[:150, 4:15]
    want = {(i, x, y) for i in range(300) for x in range(11) for y in range(11) if (a[i, x : x + 10] == b[i, y : y + 10]).all()}
    assert set(zip(*(v.tolist() for v in latent_leaks._common_runs(a, b, 10)))) == want and len(want) >= 300
    assert set(np.flatnonzero(latent_leaks._may_share(a, b, 10)).tolist()) >= {i for i, _, _ in want}


def test_paraphrases_by_subsequence(spark):
    item = "the old nurse holds a red umbrella behind the museum on a rainy day in late may near us all"
    other = item.replace("umbrella", "kite")
    docs = [(1, "so " + item.replace("red", "blue").replace("rainy", "sunny") + " then"), (2, "nothing of the kind is said here"), (3, None), (4, item.replace("umbrella", "hat").replace("rainy", "dry"))]
    index = latent_leaks.LatentIndex(spark.createDataFrame(docs, "id bigint, text string"), "id", "text")
    tests = spark.createDataFrame([("x", item, other), ("y", None, "too short")], "name string, a string, b string")
    got = latent_leaks.paraphrased(index, tests, "name", ["a", "b"]).collect()
    assert sorted((x["id"], x["item"], x["answered"]) for x in got) == [(1, "x", True), (4, "x", False)] and min(x["lcs_permille"] for x in got) >= 800
    assert latent_leaks.lcs_length("a b c d".split(), "b x d".split()) == 2


def test_leaks_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    index = latent_leaks.LatentIndex(df, "id", "text")
    tests = spark.createDataFrame([("a", " ".join(map(str, range(20))))], "name string, said string")
    assert latent_leaks.leaked(index, tests, "name", ["said"]).count() == 0
    assert latent_leaks.leaked(index, tests.limit(0), "name", ["said"]).count() == 0 and latent_leaks.paraphrased(index, tests.limit(0), "name", ["said"]).count() == 0


# --- 8: mixing

def test_mixture_fits_its_budgets(spark):
    r = random.Random(8)
    rows = [(i, "word " * r.randrange(1, 40), "hot") for i in range(400)] + [(1000 + i, "word " * 5, " Small ") for i in range(6)] + [(2000, None, "hot"), (2001, "x", None), (2002, "y " * 50, "other"), (2003, "", "small")]
    docs = spark.createDataFrame(rows, "id bigint, text string, source string").withColumn("tokens", F.lit("x")).withColumn("h", F.lit(1))
    aims = spark.createDataFrame([("hot", 55, 2), ("small", 40, 3), ("gone", 5, 2)], "source string, target_percent int, max_repeats int")
    mixture, report = mixing.mix(docs, aims, "id", "text")
    rep = {x["source"]: x for x in report.collect()}
    assert rep["small"]["short"] and rep["gone"]["short"] and not rep["hot"]["short"]
    got = mixture.collect()
    assert max(x["times"] for x in got if x["source"] == "small") == 3 and len([x for x in got if x["source"] == "small"]) == 6
    used = sum(x["tokens"] * x["times"] for x in got if x["source"] == "hot")
    assert used == rep["hot"]["mixed_tokens"] <= rep["hot"]["target_tokens"] < used + 60
    assert sum(x["tokens"] * x["times"] for x in got if x["source"] == "small") == rep["small"]["mixed_tokens"]


def test_smaller_budget_keeps_a_subset(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 9 + 1), "a") for i in range(300)] + [(999, "word " * 9000, "b")], "id bigint, text string, source string")
    kept = lambda p: {x["id"] for x in mixing.mix(docs, spark.createDataFrame([("a", p, 1)], "source string, target_percent int, max_repeats int"), "id", "text")[0].collect()}
    small, large = kept(5), kept(10)
    assert small < large


def test_mixture_of_nothing(spark):
    docs = spark.createDataFrame([], "id bigint, text string, source string")
    mixture, report = mixing.mix(docs, spark.createDataFrame([("a", 50, 2)], "source string, target_percent int, max_repeats int"), "id", "text")
    assert mixture.count() == 0 and [x["mixed_tokens"] for x in report.collect()] == [0]


# --- 9: residue

RESIDUE = {
    "The {date} at the candle.": "slot", "Name: [YOUR NAME HERE]": "slot", "A ${color} hat": "slot", "see <INSERT IMAGE>": "slot", "a __TITLE__ b": "slot", "x %(name)s y": "slot", "<%= date %> z": "slot",
    "{{ answer }}": "slot", "Lorem ipsum dolor sit amet.": "filler", "TBD.\nTBD.": "filler", "description of image description of image description of image": "filler", "Hier steht Ihr Text.": "filler",
    "Menu\nSearch\n404\nPage not found. Try again later.\n(c) viewer": "error", '{"error": {"code": 404}}': "error", "java.lang.IllegalStateException at Edit.doGet(4f:1)": "error",
    "<html><head><title>410</title></head><body><h1>Gone</h1></body></html>": "error", "You need to switch on Java Script to continue.": "script", "Activez JavaScript pour continuer.": "script",
    'Traceback (most recent call last):\n  File "a.py", line 7, in run\nKeyError: x': "error", "Checking your browser. Please wait.": "script",
    "Our prompt writes the slot as `{title}` and fills it before the call.": None, 'The poster reads "404 not found" above a drawing of a cat.': None, "Name: ______": None, None: None, "": None, " \n": None,
    '{"caption": "a candle"}': None, "[('a cup', [1, 2, 3, 4])]": None, "<b>Bold</b> words": None, "The word TODO painted on the barrel is part of the picture and stays in the caption.": None,
    "A magazine mock-up full of lorem ipsum lies on the bench; keep it as an object edit.": None, "See [1] and [note 2].": None,
    "One cat sleeps. " * 30 + "Page not found.": None,
}


@pytest.mark.parametrize("text, kind", RESIDUE.items())
def test_residue(text, kind):
    assert residue.residue_kind(text) == kind


#: Wordings that were written down before they were tried and after which no pattern was changed.
HELD_OUT = [
    "Sorry, the picture you asked for was not found on this server.", "The viewer has stopped working: internal server error.", "This gallery is temporarily unavailable, come back in an hour.",
    "We hit an unexpected error while drawing the boxes.", "Your session has expired. Start again from the list.", "You don't have permission to open this batch.", "The upload failed because the quota exceeded its limit.",
    "HTTP 502 Bad Gateway", "Error: cannot read property 'boxes' of undefined", "RuntimeError: CUDA out of memory", "FATAL: shard 12 is missing", "The caption you are looking for no longer exists.",
    "Something went wrong on our side.", "Request timed out after thirty seconds.", "Access denied for this account.", "This image has been removed by the uploader.", "Too many requests, slow down.",
    "Die angeforderte Seite existiert nicht mehr.", "Der Dienst ist zurzeit nicht verfügbar.", "Beim Laden ist ein Fehler aufgetreten.", "Cette image n'existe plus.", "Le service est indisponible pour le moment.", "Une erreur est survenue.",
    "La imagen ya no existe en este servidor.", "El visor no está disponible ahora.", "Se produjo un error al abrir la lista.",
    "Please enable JavaScript to see the gallery.", "JavaScript is disabled in your browser.", "Our viewer needs JavaScript: allow scripts for this page.", "Accept cookies to go on reading.", "We are checking your browser before letting you in.",
    "Bitte JavaScript aktivieren, um die Bilder zu sehen.", "Pour voir la galerie, activez JavaScript.", "Para ver la galería, active JavaScript.", "Verifying that you are human. Hold on.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod.", "Your text here. Your text here.", "asdf asdf test test", "blah blah blah blah", "Hier steht Ihr Text bald.", "Ici votre texte ici.", "Dummy text for the caption field.",
]


def test_recall_on_held_out_wordings():
    found = [t for t in HELD_OUT if residue.residue_kind(t)]
    assert len(found) >= 0.9 * len(HELD_OUT), sorted(set(HELD_OUT) - set(found))


def test_matched_spans_decide():
    """A known phrase inside a longer text covers too little of it, whatever the length of its sentence."""
    said = "The annotators write down that a page not found by the crawler counts as a lost picture"
    assert residue.residue_kind(said + " and is drawn again from the same source before the next round begins on Monday.") is None
    assert residue.coverage("Page not found.")[0] == 1 and 0 < residue.coverage(said)[0] < residue.MIN_COVER
    assert residue.residue_kind("[" * 20_000) is None and residue.residue_kind("\n" * 20_000 + "503") == "error"


def test_residue_below_page_furniture():
    assert residue.residue_kind("Home | Gallery | About\ntest test test\n(c) 2024") == "filler"
    assert residue.residue_kind("Menu\n503") == "error"
    assert residue.residue_kind("Menu\n503\n" + "One cat sleeps on a mat. " * 3) is None


def test_residue_rows(spark):
    df = spark.createDataFrame([(1, "TBD."), (1, "TBD."), (2, None), (3, "word " * 200_000), (4, "a." * 100_000), (5, "«" * 20_000 + "{" * 20_000)], "id bigint, text string").withColumn("kind", F.lit(1))
    assert [(r["id"], r["kind"]) for r in residue.flag_residue(df, "id", "text").filter("id < 3").collect()] == [(1, "filler")] * 2
    assert residue.flag_residue(df.limit(0), "id", "text").count() == 0


def test_nothing_else_imports_this_package():
    import pathlib

    home = pathlib.Path(residue.__file__).parent
    for path in home.parent.rglob("*.py"):
        if home not in path.parents:
            assert "pairloom.llm" not in path.read_text(), path


def test_batches_without_hits(spark):
    """Partitions and batches that find nothing give typed empty columns."""
    docs = spark.createDataFrame([(i, "nothing of the kind is said here, nor there") for i in range(8)], "id bigint, text string").repartition(6)
    index = latent_leaks.LatentIndex(docs, "id", "text")
    items = spark.createDataFrame([("x", " ".join(f"word{i}" for i in range(30)))], "name string, said string")
    assert latent_leaks.leaked(index, items, "name", ["said"]).count() == 0 and latent_leaks.paraphrased(index, items, "name", ["said"]).count() == 0
    assert residue.flag_residue(docs, "id", "text").count() == 0
    answers = docs.select("id", F.lit(EN).alias("i"), F.lit("a red umbrella").alias("s"), F.lit("a kite").alias("p"), F.lit("A tired nurse holds a kite.").alias("c"))
    assert response_defects.response_defects(answers, "id", "i", "s", "p", "c").count() == 0
