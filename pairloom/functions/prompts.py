"""Prompt and answer texts for matching tasks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pairloom.functions.captions import drop_full_stop, format_caption, pluralize, sentence_case, strip_article
from pairloom.functions.sampling import draw

# Wordings of picture questions; {c} is the caption.
IMAGE_QUESTIONS = [
    'You are given two images. Which one better aligns with the description: "{c}"? The first or the second image?',
    'Question: You are given two images. Which one better aligns with the description? "{c}" Choices: First, Second.',
    'Question: Two images are presented. Which one better aligns with the description: "{c}"? Options: First, Second.',
    'Based on the description: "{c}", please select one of the given options that best matches the image. Choices: First, Second.',
    'Which image corresponds more accurately to the description: "{c}"? Image 1 or Image 2?',
    'Based on the description: "{c}", which image is more appropriate? Is it the first or the second image?',
    'Considering the description: "{c}", which image would you say matches it better? The first one or the second one?',
    'Given the description: "{c}", which image would you select? The first or the second?',
    'If the description is: "{c}", which image would you choose? The first or the second?',
    'Which image is more likely to be described as: "{c}"? The first or the second?',
    'Which image fits the description: "{c}" more accurately? The first or the second?',
    'If you were to match the description: "{c}" with one of the images, which one would it be? The first or the second?',
    'Given the caption: "{c}", which of the two images aligns more closely with this description? Choose either First or Second.',
    'Considering the caption: "{c}", select the image that best represents this description. Is it Image 1 or Image 2?',
    'For the description: "{c}", which image would you say fits the description more closely? First or Second?',
    'Reflecting on the description: "{c}", which of these two images would you associate with it? First or Second?',
    'With the description: "{c}" in mind, which image would you say is a better match? First or Second?',
    'Analyzing the description: "{c}", choose the image that best captures the essence of this caption. Is it the first or the second?',
    'Based on the description given as: "{c}", which of the two images reflects the description more precisely? First or Second?',
    'When considering the description: "{c}", which of the two given images more accurately represents it? Choose between the first and the second.',
    'Taking into account the description: "{c}", which of the two provided images would you select as the more accurate depiction? First or Second?',
    'Look at the description: "{c}". Of the two given images, which one do you think corresponds better to it? Option: First or Second?',
    'From the given description: "{c}", which of the two images do you believe more accurately captures the described scene? First or Second?',
    'Using the description: "{c}" as a guide, which of the two images do you feel better captures its spirit? First or Second?',
]
# Wordings of their answers; {l} is the choice in lower case, {k} as it is, {c} the caption.
IMAGE_ANSWERS = [
    "The correct answer is: {l} image.",
    "The answer is: {l} image.",
    "The image that better aligns with the description is the {l} image.",
    "The {l} image better matches the description.",
    'The {l} image better aligns with the description: "{c}"',
    "The image that corresponds more accurately to the description is the {l} image.",
    "The {l} image is more appropriate.",
    "{k}",
    'The image that best fits the description: "{c}" is the {l} image.',
    'The image that is more likely to be described as "{c}" is the {l} image.',
    'The image that is a better match for the description "{c}" is the {l} image.',
]
# Wordings of text questions; {a} and {b} are the candidates.
TEXT_QUESTIONS = [
    "Question: Does this image depict: (A) {a}, or (B) {b}? Choices: A, B.",
    "Does this image best match: (A) {a}, or (B) {b}?",
    "Does this image best represent: (A) {a}, or (B) {b}?",
    "Does this image best describe: (A) {a}, or (B) {b}? Choices: A, B.",
    "Question: Which of the following best matches the image: (A) {a}, or (B) {b}? Choices: A, B.",
    "Question: Does this image best characterize: (A) {a}, or (B) {b}?",
    "Does this image best capture: (A) {a}, or (B) {b}?",
    "Does this image best illustrate: (A) {a}, or (B) {b}?",
    "Which of the following best describes the image: (A) {a}, or (B) {b}?",
    "Which of the following best represents the image: (A) {a}, or (B) {b}?",
    "Which of the following best matches the image: (A) {a}, or (B) {b}?",
    "Which of the following best captures the image: (A) {a}, or (B) {b}?",
    "Which of the following best illustrates the image: (A) {a}, or (B) {b}?",
    "Which of the following best describes the image: (A) {a}, or (B) {b}?",
    "Which of the following best represents the image: (A) {a}, or (B) {b}?",
    "Which of the following best matches the image: (A) {a}, or (B) {b}?",
    "Which of the following best captures the image: (A) {a}, or (B) {b}?",
    "Which of the following best illustrates the image: (A) {a}, or (B) {b}?",
    "Which description is more accurate for the image: (A) {a}, or (B) {b}?",
    "Which description is more fitting for the image: (A) {a}, or (B) {b}?",
    "Which description is more suitable for the image: (A) {a}, or (B) {b}?",
    "Which description is more appropriate for the image: (A) {a}, or (B) {b}?",
    "Which description is more precise for the image: (A) {a}, or (B) {b}?",
    "Which description is more exact for the image: (A) {a}, or (B) {b}?",
    "Which description is more correct for the image: (A) {a}, or (B) {b}?",
]
# Wordings of their answers; {k} is the letter, {c} the caption, {s} the caption in sentence case.
TEXT_ANSWERS = [
    "The correct answer is: ({k}) {c}",
    "The answer is: ({k}) {c}",
    "The description that best fits the image is: ({k}) {c}",
    "The ({k}) {c} description better matches the image.",
    "The description that corresponds more accurately to the image is: ({k}) {c}.",
    "({k}) {s} description is more appropriate.",
    "({k}) {c}",
    "The description that best matches the image is: ({k}) {c}.",
    "The description that is a better match for the image is: ({k}) {c}.",
    "The correct answer is: {k}.",
    "The answer is: {k}.",
    "The correct choice is: {k}.",
    "{k}",
]
# Wordings that join the captions {a} and {b} of two pictures.
JOINT = [
    "The first image shows: {a}. The second image shows: {b}.",
    "First, we see an image where {a}. Then, the second image shows {b}.",
    "In the first image, {a}. In the second image, {b}.",
    "In the image on the left, {a}. In the image on the right, {b}.",
    "The first image shows {a}, while the second image shows {b}.",
    "The image on the left displays {a}, while the image on the right displays {b}.",
]


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with its places filled; values that look like places stay as they are, since each place is cut out once."""
    out = template
    marks = {name: f"\x01{i}\x01" for i, name in enumerate(values)}
    for name, mark in marks.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.lit(mark))
    for name, mark in marks.items():
        out = F.replace(out, F.lit(mark), values[name])
    return out


def chosen(templates: list[str], seed: int, key: list[Column]) -> Column:
    """One of the templates, drawn for the key; the first one for the seed -1."""
    if seed < 0:
        return F.lit(templates[0])
    return F.element_at(F.array(*map(F.lit, templates)), (draw(seed, *key) % len(templates)).cast("int") + 1)


def image_question(caption: Column, seed: int, *key: Column) -> Column:
    return filled(chosen(IMAGE_QUESTIONS, seed, list(key)), {"c": caption})


def image_answer(choice: Column, caption: Column, seed: int, *key: Column) -> Column:
    return filled(chosen(IMAGE_ANSWERS, seed, list(key)), {"l": F.lower(choice), "k": choice, "c": caption})


def text_question(a: Column, b: Column, seed: int, *key: Column) -> Column:
    return filled(chosen(TEXT_QUESTIONS, seed, list(key)), {"a": drop_full_stop(a), "b": drop_full_stop(b)})


def text_answer(choice: Column, caption: Column, seed: int, *key: Column) -> Column:
    return filled(chosen(TEXT_ANSWERS, seed, list(key)), {"k": choice, "c": caption, "s": sentence_case(caption)})


def joint_caption(a: Column, b: Column, seed: int, *key: Column) -> Column:
    return filled(chosen(JOINT, seed, list(key)), {"a": F.lower(drop_full_stop(a)), "b": F.lower(drop_full_stop(b))})


def text_task(captions: Column) -> Column:
    """The fixed text task: lettered captions, the last one after ``or``, and the letters to choose from."""
    letter = lambda i: F.char(i + 65)
    options = F.transform(captions, lambda c, i: F.concat(F.when(i == F.size(captions) - 1, "or (").otherwise("("), letter(i), F.lit(") "), c))
    letters = F.transform(captions, lambda c, i: letter(i))
    return F.concat(F.lit("Does this image best match: "), F.array_join(options, ", "), F.lit("? Choices: "), F.array_join(letters, ", "), F.lit("."))


def image_task(caption: Column) -> Column:
    return F.concat(F.lit('Which image better aligns with the description: "'), caption, F.lit('"? Choices: First, Second.'))


def _qa(question: Column, choices: Column, answer: Column) -> Column:
    return F.struct(question.alias("question"), choices.alias("choices"), answer.alias("answer"))


def _choices(*values: str) -> Column:
    return F.array(*map(F.lit, values))


def existence_questions(name: Column, choices: Column) -> Column:
    """Questions on whether an object is there; three more on its number where the name has an article."""
    yes_no = _choices("yes", "no")
    say = lambda a, b: F.concat(F.lit(a), name, F.lit(b))
    # Wordings of the questions.
    base = [
        _qa(F.lit("What is in the image?"), choices, name),
        _qa(F.lit("What object is visible in the image?"), choices, name),
        *[_qa(say(a, b), yes_no, F.lit("yes")) for a, b in (("Is this ", "?"), ("Do you see ", " in the image?"), ("Is there ", " present in the image?"), ("In the image, is there ", "?"))],
    ]
    many = pluralize(strip_article(name))
    number = [
        _qa(F.concat(F.lit("How many "), many, F.lit(" are there in the image?")), _choices("0", "1", "2", "3"), F.lit("1")),
        _qa(F.concat(F.lit("Are there multiple "), many, F.lit(" in the image?")), yes_no, F.lit("no")),
        _qa(F.concat(F.lit("Is there more than one "), many, F.lit(" in the image?")), yes_no, F.lit("no")),
    ]
    return F.when(name.rlike("^(a|an) (.+)$"), F.array(*base, *number)).otherwise(F.array(*base))


def removal_questions(name: Column) -> Column:
    """Questions on whether an object is gone."""
    say = lambda a, b: F.concat(F.lit(a), name, F.lit(b))
    return F.array(
        _qa(say("Do you see a ", " in the image?"), _choices("yes", "no"), F.lit("no")),
        _qa(say("Is there a ", " present in the image?"), _choices("present", "not present"), F.lit("not present")),
        _qa(say("In the image, is there a ", "?"), _choices("yes", "no"), F.lit("no")),
    )


def few_shot(instruction: Column, examples: Column, input_key: str, text: Column, output_key: str) -> Column:
    """An instruction, numbered examples, and the open last one."""
    listed = F.array_join(F.transform(examples, lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e, F.lit("\n"))), "")
    return F.concat(instruction, listed, (F.size(examples) + 1).cast("string"), F.lit(f". {input_key}: "), text, F.lit(f" {output_key}:"))


def verification_captions(region: Column, full: Column, contrast: Column) -> Column:
    """The texts that questions are written for: the region, the full caption, and what must not be there."""
    return F.array(region, full, F.concat(F.lit("not "), F.lower(contrast)))


def chat_messages(kind: Column, question: Column, answer: Column) -> Column:
    """User and assistant turns of a training example: one picture or two, then the question if there is one."""
    item = lambda t, x: F.struct(F.lit(t).alias("type"), x.alias("text"))
    none = F.lit(None).cast("string")
    pictures = F.when(kind == "multi-image", F.array(item("image", none), item("image", none))).otherwise(F.array(item("image", none)))
    asked = F.when(F.coalesce(question, F.lit("")) != "", F.array(item("text", question))).otherwise(F.slice(pictures, 1, 0))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("user", F.concat(pictures, asked)), turn("assistant", F.array(item("text", answer))))


def contrast_texts(names: Column) -> Column:
    """The texts that questions on a pair of objects are written for: each one, and not the other."""
    say = lambda i: format_caption(F.concat(F.get(names, F.lit(i)), F.lit(". Not "), F.get(names, F.lit(1 - i))))
    return F.when(F.size(names) == 2, F.array(say(0), say(1)))


def object_texts(names: Column) -> Column:
    """The texts that questions on counted objects are written for, one per distinct object."""
    return F.transform(F.array_distinct(names), lambda n: format_caption(F.concat(F.lit("A photo of a "), n)))
