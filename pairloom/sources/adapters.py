"""Benchmarks of different layouts as pairs, candidate lists or picture lists of one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.functions.arrays import by_parity, first_match, front, parity_label
from pairloom.functions.captions import COUNT_WORDS, format_caption, literal_map, padded_id, tokens
from pairloom.functions.prompts import image_task, text_task
from pairloom.functions.sampling import shuffled
from pairloom.operators.windows import paired

# Relations and what denies them.
NEGATIONS = {
    "adjacent to": "nonadjacent to", "alongside": "away from", "at the side of": "away from", "at the right side of": "at the left side of",
    "at the left side of": "at the right side of", "attached to": "disconnect from", "at the back of": "at the front of", "ahead of": "not ahead of",
    "against": "away from", "at the edge of": "far from the edge of", "off": "on", "past": "before", "toward": "away from", "down": "up",
    "away from": "not away from", "along": "not along", "around": "not around", "into": "not into", "across": "not accross",
    "across from": "not across from", "down from": "up from", "facing": "facing away from", "facing away from": "facing",
    "parallel to": "perpendicular to", "perpendicular to": "parallel to", "by": "far away from", "close to": "far from", "near": "far from",
    "far from": "close to", "far away from": "by", "connected to": "detached from", "detached from": "connected to",
    "has as a part": "does not have a part", "part of": "not part of", "contains": "does not contain", "within": "outside of", "at": "not at",
    "on": "not on", "in": "not in", "with": "not with", "surrounding": "not surrounding", "among": "not among",
    "consists of": "does not consists of", "out of": "not out of", "between": "not between", "inside": "outside", "outside": "inside",
    "touching": "not touching", "beyond": "inside", "next to": "far from", "opposite to": "not opposite to", "enclosed by": "not enclosed by",
    "above": "below", "below": "above", "behind": "in front of", "on top of": "not on top of", "under": "over", "over": "under",
    "left of": "right of", "right of": "left of", "in front of": "behind", "beneath": "not beneath", "beside": "not beside",
    "in the middle of": "not in the middle of", "congruent": "incongruent",
}
# Prepositions in file names, and their opposites.
FILE_PREPOSITIONS = {"left_of": "left", "right_of": "right", "_on_": "on", "under": "under", "_in-front_of_": "front", "_behind_": "behind"}
OPPOSITES = {"left": "right", "right": "left", "on": "under", "under": "on", "front": "behind", "behind": "front"}


def at(root: str, path: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), path)


def path_id(path: Column) -> Column:
    """The first three parts of a path as an id, without the picture's extension."""
    return F.replace(F.array_join(F.slice(F.split(path, "/"), 1, 3), "-"), F.lit(".png"), F.lit(""))


def path_pairs(rows: DataFrame, root: str) -> DataFrame:
    """Pairs whose id and tag come from the first picture's path."""
    return rows.select(
        at(root, F.col("image0")).alias("image_0"), format_caption(F.col("caption0")).alias("caption_0"), at(root, F.col("image1")).alias("image_1"), format_caption(F.col("caption1")).alias("caption_1"),
        path_id(F.col("image0")).alias("id"), F.split("image0", "/")[0].alias("tag"),
    )


def subject_pairs(rows: DataFrame, nested: str, root: str) -> DataFrame:
    """Pairs of a map video -> subject -> frames; of a list of captions the first counts."""
    frames = rows.select(F.explode(nested).alias("video", "s")).select("video", F.explode("s").alias("subject", "f")).select("video", "subject", F.explode("f").alias("f"))
    return frames.select("subject", at(root, F.col("f.image0")).alias("image_0"), F.get("f.caption0", F.lit(0)).alias("caption_0"), at(root, F.col("f.image1")).alias("image_1"), F.get("f.caption1", F.lit(0)).alias("caption_1"))


def video_pairs(rows: DataFrame, nested: str, root: str) -> DataFrame:
    """Pairs of a map video -> frames."""
    return flat_pairs(rows.select(F.explode(nested).alias("video", "f")).select(F.explode("f").alias("f")).select("f.*"), root)


def flat_pairs(rows: DataFrame, root: str) -> DataFrame:
    """Pairs listed one by one."""
    return rows.select(at(root, F.col("image0")).alias("image_0"), F.col("caption0").alias("caption_0"), at(root, F.col("image1")).alias("image_1"), F.col("caption1").alias("caption_1"))


def four_items(pairs: DataFrame) -> DataFrame:
    """The four questions of a pair: for each picture which text, and for each text which picture."""
    both = F.array("image_0", "image_1")
    prompt = text_task(F.array("caption_0", "caption_1"))
    item = lambda i: [
        F.struct(F.lit("text").alias("type"), prompt.alias("text"), F.array(F.col(f"image_{i}")).alias("images"), F.lit("AB"[i]).alias("label")),
        F.struct(F.lit("image").alias("type"), image_task(F.col(f"caption_{i}")).alias("text"), both.alias("images"), F.lit(("First", "Second")[i]).alias("label")),
    ]
    return pairs.select("id", F.posexplode(F.array(*item(0), *item(1))).alias("item", "x")).select("id", "item", "x.*")


def edited_pairs(rows: DataFrame, root: str) -> DataFrame:
    """Pairs of an original and an edited picture."""
    lead = lambda c, folder: at(f"{root}/{folder}", F.regexp_replace(c, "^/+", ""))
    return rows.select(lead("image_path", "original_images").alias("image_0"), F.col("caption").alias("caption_0"), lead("edited_image_path", "edited_images").alias("image_1"), F.col("edited_caption").alias("caption_1"), F.col("edit_id").alias("id"))


def consecutive_pairs(rows: DataFrame, position: str, root: str) -> DataFrame:
    """Pairs of two consecutive questions; an odd last one is left out."""
    both = paired(rows.withColumn("qid", F.col("qid").cast("int")), position, ["qid", "kind", "statement"])
    image = lambda i: F.concat(F.lit(f"{root}/"), F.col(f"kind_{i}"), F.lit("/"), F.col(f"qid_{i}").cast("string"), F.lit(".jpg"))
    return both.select(image(0).alias("image_0"), image(1).alias("image_1"), format_caption(F.col("statement_0")).alias("caption_0"), format_caption(F.col("statement_1")).alias("caption_1"), F.col("qid_0").alias("id"))


def labelled_captions(rows: DataFrame, root: str, position: str) -> DataFrame:
    """A picture and candidate captions, the right one first."""
    return rows.select(at(root, F.col("query")).alias("image"), front(F.col("keys"), F.col("label")).alias("captions"), F.concat(F.lit("speci2t-"), F.col(position)).alias("id"), position)


def labelled_images(rows: DataFrame, root: str, position: str) -> DataFrame:
    """A caption and candidate pictures, the right one first."""
    images = F.transform(front(F.col("keys"), F.col("label")), lambda k: at(root, k))
    return rows.select(images.alias("images"), F.col("query").alias("caption"), F.concat(F.lit("spect2i-"), F.col(position)).alias("id"), position)


def text_items(rows: DataFrame, position: str) -> DataFrame:
    """Question items of candidate captions: two of them, in turn in order and reversed."""
    two = by_parity(F.slice("captions", 1, 2), F.col(position))
    return rows.select("id", F.col("image"), text_task(two).alias("text"), parity_label(F.col(position), "A", "B").alias("label"))


def image_items(rows: DataFrame, position: str) -> DataFrame:
    """Question items of candidate pictures: two of them, in turn in order and reversed."""
    return rows.select("id", by_parity(F.slice("images", 1, 2), F.col(position)).alias("images"), image_task(F.col("caption")).alias("text"), parity_label(F.col(position), "First", "Second").alias("label"))


def approved_foils(rows: DataFrame, root: str, position: str, least: int = 2) -> DataFrame:
    """Caption and foil of entries that raters approved; an entry without ratings stays. A picture of the other split lies in that split's folder."""
    file = F.col("image_file")
    folder = F.when(F.contains(file, F.lit("val")) & F.contains(F.lit(root), F.lit("train")), root.replace("train", "val")).when(F.contains(file, F.lit("train")) & F.contains(F.lit(root), F.lit("val")), root.replace("val", "train")).otherwise(root)
    return rows.filter(F.col("mturk").isNull() | (F.col("mturk") > least)).select(
        F.concat_ws("/", folder, file).alias("image"), by_parity(F.array("caption", "foil"), F.col(position)).alias("captions"), parity_label(F.col(position), "A", "B").alias("label"), "caption", F.array("foil").alias("foils"), F.col("foil_id").alias("id"),
    )


def recovered_foils(rows: DataFrame) -> DataFrame:
    """Foils with the original caption, which has the target word for the foil word."""
    return rows.filter("foil").select(
        "foil_id", F.concat(F.lit("COCO_val2014_"), padded_id(F.col("image_id")), F.lit(".jpg")).alias("image_file"), F.expr("replace(caption, foil_word, target_word)").alias("caption"), F.col("caption").alias("foil"),
        F.col("target_word").alias("classes"), F.col("foil_word").alias("classes_foil"), F.lit(None).cast("int").alias("mturk"),
    )


def count_candidates(rows: DataFrame, root: str, position: str, seed: int = 7) -> DataFrame:
    """A caption with a count and one with another count from two to nine, drawn by hash; only files of the usual picture types."""
    file = F.substring_index("image_url", "/", -1)
    word = F.element_at(F.array(*map(F.lit, COUNT_WORDS)), F.col("number"))
    others = F.transform(F.filter(F.sequence(F.lit(2), F.lit(9)), lambda i: i != F.col("number")), lambda i: F.replace(F.col("text"), word, F.element_at(F.array(*map(F.lit, COUNT_WORDS)), i)))
    drawn = F.get(shuffled(others, seed, F.col(position)), F.lit(0))
    return rows.filter(file.rlike(r"\.(jpg|jpeg|png)$")).select(at(root, file).alias("image"), F.array(F.col("text"), drawn).alias("captions"), F.concat(F.lit("count-"), F.col(position)).alias("id"), position)


def negated_relations(rows: DataFrame, root: str, position: str, split: str = "validation") -> DataFrame:
    """True captions and the same with the relation denied; a relation that isn't known gives a null."""
    denied = F.try_element_at(literal_map(NEGATIONS), F.col("relation"))
    path = at(root, F.col("image"))
    return rows.filter("label").select(
        F.when(F.contains(F.col("image_link"), F.lit("val")), F.replace(path, F.lit("train"), F.lit("val"))).otherwise(path).alias("image"),
        F.array("caption", F.replace(F.col("caption"), F.col("relation"), denied)).alias("captions"), F.concat(F.lit(f"{split}-"), F.col(position)).alias("id"), position,
    )


def captioned_negatives(rows: DataFrame, nested: str, root: str) -> DataFrame:
    """A map id -> {filename, caption, negative_caption}."""
    return rows.select(F.explode(nested).alias("id", "d")).select(at(root, F.col("d.filename")).alias("image"), F.array("d.caption", "d.negative_caption").alias("captions"), "id")


def spatial_pairs(rows: DataFrame, root: str, position: str, subset: str, coco: bool) -> DataFrame:
    """Caption and foil with a tag: the last word, or what the first known phrase stands for, or a default."""
    known = {"left of": "left", "right of": "right", "above": "above"} if coco else {"left of": "left", "right of": "right", "front of": "front", "behind": "behind"}
    if subset == "one":
        tag = F.try_element_at(tokens(F.col("caption")), F.lit(-1))
    else:
        tag = F.lit("below" if coco else "top")
        for phrase, name in reversed(known.items()):
            tag = F.when(F.contains(F.col("caption"), F.lit(phrase)), name).otherwise(tag)
    name = padded_id(F.col("image_id")) if coco else F.col("image_id").cast("string")
    return rows.select(F.concat(F.lit(f"{root}/"), name, F.lit(".jpg")).alias("image"), F.array(format_caption(F.col("caption")), format_caption(F.col("foil"))).alias("captions"), tag.alias("tag"), F.col(position).alias("id"))


def frame_pairs(rows: DataFrame, position: str) -> DataFrame:
    """The right and the wrong frame of a folder, whose files are ordered by the number after a three-letter prefix."""
    number = lambda f: F.substring(F.substring_index(F.substring_index(f, "/", -1), ".", 1), 4, 20).try_cast("int")
    ordered = F.transform(F.array_sort(F.transform("files", lambda f: F.struct(number(f).alias("n"), f.alias("f")))), lambda s: s["f"])
    return rows.select(F.array(F.get(ordered, F.col("pos_idx")), F.get(ordered, F.col("neg_idx"))).alias("images"), F.trim("caption").alias("caption"), F.concat("directory", F.lit("-"), F.col(position)).alias("id"), position)


def preposition_options(rows: DataFrame, position: str) -> tuple[DataFrame, DataFrame]:
    """``(pairs, inconsistent)``: the option with the file name's preposition and one with its opposite; rows where the former is missing or not alone are set apart."""
    name = F.substring_index("image_path", "/", -1)
    word = F.lit(None).cast("string")
    for mark, prep in reversed(FILE_PREPOSITIONS.items()):
        word = F.when(F.contains(name, F.lit(mark)), prep).otherwise(word)
    rows = rows.withColumn("__w", word).withColumn("__o", F.try_element_at(literal_map(OPPOSITES), F.col("__w")))
    has = lambda t, w: F.array_contains(tokens(t), w)
    hits = F.size(F.filter("caption_options", lambda t: has(t, F.col("__w"))))
    out = rows.withColumn("__hits", hits).select(
        name.alias("image"), F.array(first_match(F.col("caption_options"), lambda t: has(t, F.col("__w"))), first_match(F.col("caption_options"), lambda t: has(t, F.col("__o")))).alias("captions"), F.concat(F.lit("whatsup-"), F.col(position)).alias("id"), position, "__hits",
    )
    good = F.coalesce(F.col("__hits") == 1, F.lit(False))
    return out.filter(good).drop("__hits"), out.filter(~good).drop("__hits")
