"""Building a training set of minimal-change pairs from edits, verdicts, scores and tags, and its exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.functions import captions as C
from pairloom.functions import geometry as G
from pairloom.functions import prompts as P
from pairloom.functions.sampling import chance, draw
from pairloom.operators.joins import accepted, with_default
from pairloom.operators.skew import spread_join
from pairloom.operators.windows import keep_first, quota, stratified_quota


def flat_negatives(samples: DataFrame) -> DataFrame:
    """One row per negative with its sample's fields, captions formatted."""
    return samples.select(
        "sample_id", "image_id", "image_path", C.format_caption(F.col("caption")).alias("caption"), "source", F.posexplode("negatives").alias("pos", "n")
    ).select(
        "sample_id", "image_id", "image_path", "caption", "source", "pos", "n.edited_image_path", C.format_caption(F.col("n.edited_caption")).alias("edited_caption"), "n.input_phrase", "n.edited_phrase",
        "n.category", "n.sub_category", "n.edit_id", F.coalesce("n.region_crop_bool", F.lit(False)).alias("region_crop_bool"),
    )


def contrastive_rows(samples: DataFrame) -> DataFrame:
    """Picture and caption of each sample once per category of its negatives, and of every negative."""
    flat = flat_negatives(samples).filter("category is not null")
    heads = keep_first(flat, ["sample_id", "category"], [F.col("pos")]).select("category", "image_path", "caption")
    return heads.unionByName(flat.select("category", F.col("edited_image_path").alias("image_path"), F.col("edited_caption").alias("caption")))


def difference_rows(samples: DataFrame, differences: DataFrame) -> DataFrame:
    """Negatives whose visual difference is known, with it."""
    return spread_join(flat_negatives(samples), differences.select("image_id", "edit_id", "visdiff"), ["image_id", "edit_id"]).select("image_path", "edited_image_path", "visdiff", "edit_id")


def matching_rows(samples: DataFrame, seed: int = 7, rate: float = 0.25) -> DataFrame:
    """Training rows of each negative: two picture and two text questions, and captions of each picture and of both, each with the given rate.

    Order of candidates, wordings and optional rows are drawn by hash of sample, edit and row; the
    seed -1 takes the first wording, keeps the order and all optional rows.
    """
    plain = seed < 0
    flat = flat_negatives(samples)
    key = [F.col("sample_id"), F.col("pos")]
    images, captions = ("image_path", "edited_image_path"), ("caption", "edited_caption")
    none, empty = F.lit(None).cast("string"), F.lit("")
    coin = lambda n: F.lit(False) if plain else draw(seed + n, *key) % 2 == 1
    seeded = lambda n: -1 if plain else seed + n
    row = lambda kind, a, b, q, ans, name: F.struct(F.lit(kind).alias("type"), a.alias("image_path_1"), b.alias("image_path_2"), q.alias("question"), ans.alias("answer"), name.alias("edit_id"))
    named = lambda suffix: F.concat_ws(".", "image_id", "edit_id", F.lit(suffix))
    rows = []
    for i in (0, 1):
        swapped = coin(10 + i)
        mine, other = F.col(images[i]), F.col(images[1 - i])
        # The picture that fits the caption is the first one unless swapped.
        first = F.when(swapped, other).otherwise(mine)
        second = F.when(swapped, mine).otherwise(other)
        choice = F.when(swapped, "Second").otherwise("First")
        caption = F.col(captions[i])
        rows.append(row("multi-image", first, second, P.image_question(caption, seeded(20 + i), *key), P.image_answer(choice, caption, seeded(30 + i), *key), named("image_task")))
    for i in (0, 1):
        swapped = coin(40 + i)
        a = F.when(swapped, F.col(captions[1])).otherwise(F.col(captions[0]))
        b = F.when(swapped, F.col(captions[0])).otherwise(F.col(captions[1]))
        letter = F.when(swapped, "AB"[1 - i]).otherwise("AB"[i])
        rows.append(row("image", F.col(images[i]), empty, P.text_question(a, b, seeded(50 + i), *key), P.text_answer(letter, F.col(captions[i]), seeded(60 + i), *key), named("text_task")))
    optional = [
        row("image", F.col(images[1]), empty, empty, F.col(captions[1]), F.col("edit_id")),
        row("image", F.col(images[0]), empty, empty, F.col(captions[0]), F.col("edit_id")),
        row("multi-image", F.col(images[0]), F.col(images[1]), empty, P.joint_caption(F.col(captions[0]), F.col(captions[1]), seeded(70), *key), named("joint_description")),
    ]
    for n, o in enumerate(optional):
        rows.append(o if plain else F.when(chance(rate, seed + 80 + n, *key), o))
    return flat.select("sample_id", "pos", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("sample_id", "pos", "r.*")


def nested_samples(flat: DataFrame, key: list[str], fields: list[str], order: str) -> DataFrame:
    """Samples with their negatives as an ordered array."""
    item = F.struct(F.col(order).alias("__o"), F.struct(*fields).alias("n"))
    return flat.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["n"]).alias("negatives"))


def scored_negatives(edits: DataFrame, verdicts: DataFrame, tags: DataFrame, threshold: float) -> DataFrame:
    """Object and attribute negatives whose verdict is NO and whose scores reach the threshold, with their sub-category tag or ``Others``.

    ``edits`` has image_id, edit_id, category, tifa_score, region_tifa_score; null and NaN scores fail.
    """
    reach = lambda c: (F.col(c) >= threshold) & ~F.isnan(c)
    pair = C.category_pair(F.col("category"))
    kept = edits.filter((F.contains("category", F.lit("object")) | F.contains("category", F.lit("attribute"))) & reach("tifa_score") & reach("region_tifa_score"))
    kept = accepted(kept, verdicts, ["image_id", "edit_id"])
    return with_default(kept.withColumn("category", pair["category"]), tags, ["image_id", "edit_id"], "sub_category", "Others")


def of_kept_images(rows: DataFrame, edits: DataFrame, unwanted: str = "open_ended", image: str = "image_id") -> DataFrame:
    """Rows of images whose counting edits come from a wanted source; an image with an unwanted one goes as a whole, with its object and attribute negatives."""
    return spread_join(rows, edits.filter(F.col("image_edit_source") == unwanted).select(image).filter(F.col(image).isNotNull()).distinct(), [image], "left_anti")


def counting_negatives(edits: DataFrame, refined: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Counting negatives: perfect ones with a picture, one per new caption, at most so many per original count.

    ``edits`` has image_id, pos, id, new_image_path, tifa_score, new_caption, object_name,
    original_object_count, image_edit_source. A refined caption, unless empty, replaces the new one.
    """
    good = of_kept_images(edits, edits).filter("image_edit_source is not null and new_image_path is not null and tifa_score = 1")
    unique = keep_first(good, ["image_id", "new_caption"], [F.col("pos")])
    count = F.col("original_object_count")
    limited = quota(unique.withColumn("sub_category", count.cast("string")), "sub_category", caps, [F.col("image_id"), F.col("pos")])
    phrase = lambda n: F.concat(n.cast("string"), F.lit(" "), F.when(n > 1, C.pluralize(F.col("object_name"))).otherwise(F.col("object_name")))
    better = refined.select("image_id", F.nullif("caption", F.lit("")).alias("__refined"))
    return spread_join(limited, better, ["image_id"], "left").select(
        "image_id", F.col("new_image_path").alias("edited_image_path"), F.coalesce("__refined", "new_caption").alias("edited_caption"), phrase(count).alias("input_phrase"), phrase(count - 1).alias("edited_phrase"),
        F.lit("counting").alias("category"), "sub_category", F.col("id").alias("edit_id"),
    )


def relation_negatives(layouts: DataFrame, threshold: float) -> DataFrame:
    """Relation negatives of layouts with two boxes: both pictures reach the threshold and the swapped prompt differs little.

    ``layouts`` has image_id, prompt, category, bounding_boxes, image_path, edited_image_path, score, edited_score.
    """
    boxes = F.col("bounding_boxes")
    swapped = C.swap_phrases(F.col("prompt"), F.get(boxes, F.lit(0))["name"], F.get(boxes, F.lit(1))["name"])
    good = layouts.filter((F.size(boxes) == 2) & (F.coalesce("score", F.lit(0.0)) >= threshold) & (F.coalesce("edited_score", F.lit(0.0)) >= threshold) & ~F.contains("prompt", F.lit("\n")))
    out = good.withColumn("edited_caption", swapped).filter("edited_caption is not null").filter(C.char_bag_distance(F.col("prompt"), F.col("edited_caption")) <= 5)
    return out.withColumn("sub_category", C.first_direction(F.col("edited_caption")))


def usable_layouts(layouts: DataFrame) -> DataFrame:
    """Layouts of two boxes of similar area with a direction, or of two boxes and more that don't overlap; names get an article."""
    b, head = F.col("bounding_boxes"), C.category_head(F.col("category"))
    first, second = F.get(b, F.lit(0)), F.get(b, F.lit(1))
    relation = (head == "relation") & C.mentions_direction(F.col("prompt")) & (F.size(b) == 2) & ~F.coalesce(G.area_difference(first, second) > 0.5, F.lit(False))
    counting = (head == "counting") & (F.size(b) >= 2) & ~G.any_overlap(b)
    named = F.transform(b, lambda x: F.struct(C.add_article(x["name"]).alias("name"), x["x"].alias("x"), x["y"].alias("y"), x["w"].alias("w"), x["h"].alias("h")))
    return layouts.filter(relation | counting).withColumn("bounding_boxes", named)


def region_crops(negatives: DataFrame) -> DataFrame:
    """Picture regions by phrase, of the input and of the edit; of a phrase that repeats within an image the last counts."""
    from pairloom.operators.upserts import last_by

    part = lambda phrase, image, side: F.struct(F.col(phrase).alias("phrase"), F.col(image).alias("image_path"), F.lit(side).alias("side"))
    rows = negatives.select("image_id", "pos", "category", "sub_category", "edit_id", F.explode(F.array(part("input_phrase", "image_path", 0), part("edited_phrase", "edited_image_path", 1))).alias("p")).select("*", "p.*").drop("p")
    return last_by(rows.filter("phrase is not null"), ["image_id", "phrase"], [F.col("pos"), F.col("side")])


def balanced(flat: DataFrame, caps: dict[str, int], order: list[Column], default: int | None = None) -> DataFrame:
    """Negatives cut to fair shares of sub-categories; samples of a spatial source count as one sub-category, and those without attribute are left out."""
    sub = F.when(F.col("source") == "vsr", "spatially-aware").otherwise(F.col("sub_category"))
    named = flat.withColumn("sub_category", sub).filter("sub_category <> 'No Attribute'")
    return stratified_quota(named, "category", "sub_category", caps, order, default)
