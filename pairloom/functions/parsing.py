"""Structured parts of text that a language model wrote, as arrays of structs. Nothing is evaluated as code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pairloom.functions.captions import PUNCTUATION, strip, within_edits

# The formats in which edits, questions and layouts are written.
EDIT = r'(?d)\{\s*"InputCaption": "(.*?)",\s*"SelectedPhrase": "(.*?)",\s*"EditedPhrase": "(.*?)",\s*"EditedRegionPhrase": "(.*?)",\s*"EditedCaption": "(.*?)",\s*"Category": "(.*?)"\s*\}'
QUESTION = r'(?d)Question: (.*?) Choices: (\[.*?\]) Answer: (.*?)(?=", "Question|$)'
SIMPLE_QUESTION = r"(?s)'Question: (.*?) Answer: (.*?)'(?:, |$)"
LAYOUT = r"(?s)(?:\d+\.\s)?Input: (.*?), Bounding boxes: (\[.*?\]), Background prompt: (.*?), Negative prompt: (.*?), Category: (.*?)(?=(?:\d+\.\s)?Input:|$)"


#: Marks put around the matches and between the groups; they are no characters of a text and are dropped from one that has them.
OPEN, BETWEEN, CLOSE = "\x1c", "\x1d", "\x1e"


def find_all(text: Column, pattern: str, names: list[str]) -> Column:
    """All matches of a pattern, one struct per match with a trimmed field per group. One search over the text marks every match and its groups."""
    bare = F.translate(text, OPEN + BETWEEN + CLOSE, "")
    marked = F.regexp_replace(bare, pattern, OPEN + BETWEEN.join(f"${i + 1}" for i in range(len(names))) + CLOSE)
    whole = F.transform(F.slice(F.split(marked, OPEN), 2, 1_000_000_000), lambda x: F.split(F.substring_index(x, CLOSE, 1), BETWEEN))
    return F.transform(whole, lambda m: F.struct(*[strip(m[i]).alias(n) for i, n in enumerate(names)]))


def parse_edits(text: Column, prompt: Column, most: int = 5) -> Column:
    """Edit instructions whose echoed caption is within ``most`` edits of the prompt and whose phrase isn't a note that nothing changed."""
    found = find_all(text, EDIT, ["input_caption", "input_phrase", "edited_phrase", "edited_region_phrase", "edited_caption", "category"])
    kept = F.filter(found, lambda m: within_edits(m["input_caption"], prompt, most) & ~within_edits(F.lower(m["edited_phrase"]), F.lit("no attribute change"), 1))
    return F.filter(kept, lambda m: F.contains(F.substring_index(m["category"], "(", 1), F.lit("object")) | F.contains(F.substring_index(m["category"], "(", 1), F.lit("attribute")))


def parse_list(text: Column) -> Column:
    """A list of strings in either kind of quotes; null if it isn't one from end to end."""
    return F.when(text.rlike(r"(?s)^\s*\[.*\]\s*$"), F.from_json(text, "array<string>"))


def parse_questions(text: Column) -> Column:
    """Questions with choices and an answer without punctuation; those whose choices can't be read are left out."""
    found = find_all(text, QUESTION, ["question", "choices", "answer"])
    made = F.transform(found, lambda m: F.struct(m["question"].alias("question"), parse_list(m["choices"]).alias("choices"), F.trim(F.translate(m["answer"], PUNCTUATION, "")).alias("answer")))
    return F.filter(made, lambda m: m["choices"].isNotNull())


def parse_simple_questions(text: Column) -> Column:
    return find_all(F.btrim(text, F.lit("[]")), SIMPLE_QUESTION, ["user", "assistant"])


def parse_boxes(text: Column) -> Column:
    """``[(name, [x, y, w, h]), ...]`` as an array of structs, null if it isn't of this form."""
    number = r"\s*(-?\d+(?:\.\d+)?)\s*"
    one = rf"[\(\[]\s*['\"]([^'\"]*)['\"]\s*,\s*[\(\[]{number},{number},{number},{number}[\)\]]\s*[\)\]]"
    fields = [F.regexp_extract_all(text, F.lit(one), F.lit(i + 1)).alias(n) for i, n in enumerate(["name", *"xywh"])]
    boxes = F.transform(F.arrays_zip(*fields), lambda m: F.struct(m["name"].alias("name"), *[m[c].try_cast("double").alias(c) for c in "xywh"]))
    return F.when(text.rlike(rf"(?s)^\s*\[\s*(?:{one}\s*,?\s*)*\]\s*$"), boxes)


def parse_layouts(text: Column) -> Column:
    """Layouts with their boxes; those whose boxes can't be read are left out."""
    found = find_all(text, LAYOUT, ["prompt", "boxes", "background_prompt", "negative_prompt", "category"])
    made = F.transform(found, lambda m: F.struct(m["prompt"].alias("prompt"), parse_boxes(m["boxes"]).alias("bounding_boxes"), m["background_prompt"].alias("background_prompt"), m["negative_prompt"].alias("negative_prompt"), m["category"].alias("category")))
    return F.filter(made, lambda m: m["bounding_boxes"].isNotNull())


def before_numbered(text: Column, number: int, key: str) -> Column:
    """The text before the next numbered example, trimmed."""
    return F.trim(F.split(text, rf"\s*{number}\.\s*{key}:")[0])


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def json_list_prefix(text: Column) -> Column:
    """A list that a completion opened, cut at the first closing brace; null if it can't be read."""
    return parse_list(F.trim(F.substring_index(text, "}", 1)))


def reformat(text: Column, pattern: str, template: str, groups: int) -> Column:
    """The groups of the first match put into a template of ``%s``; the text itself without a match."""
    return F.when(text.rlike(pattern), F.format_string(template, *[F.regexp_extract(text, pattern, i + 1) for i in range(groups)])).otherwise(text)
