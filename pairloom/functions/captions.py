"""Caption and phrase expressions: formatting, categories, counts, phrase replacement, answer matching.

All take and return columns, stay inside generated code, and give null for null unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Spatial directions, count words, digits as text.
DIRECTIONS = ["left", "right", "top", "bottom", "below", "above", "under"]
CATEGORIES = ["object", "attribute", "relation", "counting"]
COUNT_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
DIGIT_TEXT = {str(i): w for i, w in enumerate(["no", *COUNT_WORDS])}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def literal_map(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def tokens(text: Column) -> Column:
    """Parts between white space, as written; no empty parts."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def strip(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def format_caption(text: Column) -> Column:
    """Stripped, first letter in upper case, a full stop at the end. An empty caption stays empty."""
    t = strip(text)
    head = F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))
    return F.when(t == "", t).when(F.endswith(t, F.lit(".")), head).otherwise(F.concat(head, F.lit(".")))


def sentence_case(text: Column) -> Column:
    """First letter in upper case, the rest in lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def drop_full_stop(text: Column) -> Column:
    return F.regexp_replace(text, r"\.$", "")


def category_pair(text: Column) -> Column:
    """Struct of category and sub_category of ``category (sub)``; without a bracket ``others``, and an unknown category is ``others``."""
    shape = r"^(?d)(.*?)\s*\((.*?)\)\s*$"
    head = F.when(text.rlike(shape), F.regexp_extract(text, shape, 1)).otherwise(F.trim(F.substring_index(text, "(", 1)))
    sub = F.when(text.rlike(shape), F.regexp_extract(text, shape, 2)).otherwise("others")
    return F.when(text.isNotNull(), F.struct(F.when(head.isin(CATEGORIES), head).otherwise("others").alias("category"), sub.alias("sub_category")))


def category_head(text: Column) -> Column:
    """What stands before the first bracket, blanks kept."""
    return F.substring_index(text, "(", 1)


def first_direction(caption: Column) -> Column:
    """The direction word that comes first among the tokens, or null."""
    return F.try_element_at(F.filter(tokens(caption), lambda t: t.isin(DIRECTIONS)), F.lit(1))


def mentions_direction(caption: Column) -> Column:
    """Whether a direction occurs anywhere in the text, inside a word too."""
    return F.reduce(F.array(*map(F.lit, DIRECTIONS)), F.lit(False), lambda acc, d: acc | F.contains(caption, d))


def pluralize(noun: Column) -> Column:
    return (
        F.when(noun.rlike("[sxz]$") | noun.rlike("[^aeioudgkprt]h$"), F.concat(noun, F.lit("es")))
        .when(noun.rlike("[^aeiou]y$"), F.regexp_replace(noun, "y$", "ies"))
        .otherwise(F.concat(noun, F.lit("s")))
    )


def swap_phrases(prompt: Column, first: Column, second: Column) -> Column:
    """The prompt in lower case with two phrases exchanged; null unless both occur, apart from each other."""
    p, a, b = F.lower(prompt), F.lower(first), F.lower(second)
    at, bt = F.instr(p, a), F.instr(p, b)
    x, y = F.when(at < bt, a).otherwise(b), F.when(at < bt, b).otherwise(a)
    i, j = F.least(at, bt), F.greatest(at, bt)
    swapped = F.concat(F.substring(p, F.lit(1), i - 1), y, F.substring(p, i + F.length(x), j - i - F.length(x)), x, F.substring(p, j + F.length(y), F.length(p)))
    return F.when((at > 0) & (bt > 0) & (i + F.length(x) <= j), swapped)


def add_article(noun: Column) -> Column:
    """``a`` or ``an`` before a noun that has none."""
    n = F.trim(noun)
    return F.when(F.lower(F.substring_index(n, " ", 1)).isin("a", "an"), noun).when(n.rlike("(?i)^(?:[aeiou]|hon|hour|herb)"), F.concat(F.lit("an "), n)).otherwise(F.concat(F.lit("a "), n))


def strip_article(noun: Column) -> Column:
    """The noun without a leading ``a`` or ``an``."""
    return F.when(noun.rlike("^(a|an) (.+)$"), F.regexp_extract(noun, "^(a|an) (.+)$", 2)).otherwise(noun)


def articles_to_one(text: Column) -> Column:
    return F.regexp_replace(text, r"\b([aA]|[aA]n)\b", "one")


def article_to_one_before(text: Column, noun: Column) -> Column:
    """``one`` for the article just before ``noun``, without case."""
    quoted = F.concat(F.lit(r"(?i)\b(a|an)\s+(?=\Q"), noun, F.lit(r"\E)"))
    return F.regexp_replace(text, quoted, F.lit("one "))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """``text`` with the first ``old``, found without case, replaced; null where it doesn't occur."""
    at = F.instr(F.lower(text), F.lower(old))
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text))))


def digit_text(number: Column) -> Column:
    """``no`` to ``ten`` for 0 to 10, else null."""
    return F.try_element_at(literal_map(DIGIT_TEXT), number.cast("string"))


def one_fewer(count: Column, noun: Column) -> Column:
    """A count phrase with one object fewer, in words."""
    return F.concat(digit_text(count - 1), F.lit(" "), F.when(count - 1 > 1, pluralize(noun)).otherwise(noun))


def count_total(caption: Column) -> Column:
    """The sum of all count words and numerals of a caption; 0 without any."""
    values = literal_map({w: i + 1 for i, w in enumerate(COUNT_WORDS)})
    value = lambda t: F.coalesce(F.try_element_at(values, t).cast("bigint"), F.when(t.rlike("^[0-9]{1,18}$"), t.try_cast("bigint")), F.lit(0).cast("bigint"))
    return F.aggregate(F.transform(tokens(F.lower(caption)), value), F.lit(0).cast("bigint"), lambda a, b: a + b)


def leading_count(chunk: Column) -> Column:
    """The number that the first token of a noun chunk names, in words or digits, or null."""
    first = F.lower(F.try_element_at(tokens(chunk), F.lit(1)))
    return F.coalesce(F.try_element_at(literal_map({w: i + 1 for i, w in enumerate(COUNT_WORDS)}), first), F.when(first.rlike("^[0-9]{1,9}$"), first.try_cast("int")))


def reduced_count_caption(caption: Column, noun: Column, count: Column, fewer: Column) -> Column:
    """A caption with the count of ``noun`` lowered by ``fewer``, in digits if it has digits; null if the phrase isn't there."""
    name, left = strip_article(noun), count - fewer
    form = lambda n, text: F.concat(text, F.lit(" "), F.when(n > 1, pluralize(name)).otherwise(name))
    digits = replace_first(caption, form(count, count.cast("string")), form(left, left.cast("string")))
    words = replace_first(caption, form(count, digit_text(count)), form(left, digit_text(left)))
    return F.when(F.contains(caption, count.cast("string")), digits).otherwise(words)


def normalize_prediction(text: Column) -> Column:
    """An answer reduced for comparison: what the first brackets hold, of that a letter before a bracket, the first line, without punctuation, in lower case."""
    inner = F.when(text.rlike(r"(?d)\(.*?\)"), F.regexp_extract(text, r"(?d)\((.*?)\)", 1)).otherwise(text)
    letter = F.when(inner.rlike(r"[A-Za-z]\)"), F.regexp_extract(inner, r"([A-Za-z])\)", 1)).otherwise(inner)
    line = F.substring_index(letter, "\n", 1)
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, r"(?U)[^\w\s]", ""), r"\s+", " ")))


def label_match(output: Column, label: Column) -> Column:
    """Whether an answer names a label: as a token, in the phrase ``answer <label>``, or as a whole."""
    out, want = normalize_prediction(output), normalize_prediction(label)
    phrase = normalize_prediction(F.concat(F.lit("ANSWER: "), label))
    return F.array_contains(F.split(out, " "), want) | F.contains(out, phrase) | (out == want)


def vqa_answer(text: Column) -> Column:
    """A free answer cut at the first marker, else at the first line end or comma, in lower case without outer punctuation."""
    marked = r"(?s)^(.*?)(Answer the|Please answer the following|Answer the multiple-choice question|Answer:|USER:|Explanation:|Question:)"
    cut = F.when(text.rlike(marked), F.regexp_extract(text, marked, 1)).otherwise(F.split(text, "[\n,]")[0])
    return F.btrim(F.lower(cut), F.lit(PUNCTUATION + " \t\n\r\x0b\x0c"))


def sorted_chars(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, "")), "")


def char_bag_distance(a: Column, b: Column) -> Column:
    """Edit distance of the sorted characters, which ignores their order."""
    return F.levenshtein(sorted_chars(a), sorted_chars(b))


def within_edits(a: Column, b: Column, most: int) -> Column:
    return F.levenshtein(a, b, most) >= 0


def slug(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[/\-]", ""))


def file_slug(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+|/", "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_extension(path: Column) -> Column:
    return F.when(F.contains(file_name(path), F.lit(".")), F.substring_index(file_name(path), ".", -1)).otherwise("")


def padded_id(number: Column) -> Column:
    """An image number as twelve digits."""
    return F.lpad(number.cast("string"), 12, "0")


def first_sentence(text: Column, remove: list[str] = ()) -> Column:
    """The text up to the first full stop, without the given boilerplate, trimmed."""
    out = F.split_part(text, F.lit("."), F.lit(1))
    for phrase in remove:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    return F.trim(out)


def first_without(texts: Column, names: Column, default: str = "a photo, outdoor") -> Column:
    """The first text that mentions none of ``names``, else the default."""
    free = F.filter(texts, lambda t: ~F.exists(names, lambda n: F.contains(t, n)))
    return F.coalesce(F.try_element_at(free, F.lit(1)), F.lit(default))


def verdict(output: Column) -> Column:
    """``NO`` if a validator's output says so and not yes before, else ``YES``."""
    return F.when(F.contains(output, F.lit("Reject: YES")), "YES").when(F.contains(output, F.lit("Reject: NO")), "NO").otherwise("YES")


def has_all(text: Column, keys: list[str]) -> Column:
    return F.forall(F.array(*map(F.lit, keys)), lambda k: F.contains(text, k))
