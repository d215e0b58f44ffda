"""Hooks for models, by name. The stubs are deterministic stand-ins that exercise the plans around them; their scores say nothing about any model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.functions.vectors import cosine

Scorer = Callable[[Column, Column], Column]
_scorers: dict[str, Scorer] = {}
_generators: dict[str, Callable[[str, int], str]] = {}


def scorer(name: str) -> Callable[[Scorer], Scorer]:
    """Register a function of two columns (text side, picture side) that gives a score column."""

    def add(f: Scorer) -> Scorer:
        _scorers[name] = f
        return f

    return add


def find_scorer(name: str) -> Scorer:
    """The scorer whose registered name is part of a model's name."""
    for known, f in _scorers.items():
        if known in name:
            return f
    raise KeyError(f"no scorer for {name}; known: {', '.join(sorted(_scorers))}")


@scorer("stub-cosine")
def stub_cosine(text: Column, image: Column) -> Column:
    """Cosine of two vectors."""
    return cosine(text, image)


def pair_scores(pairs: DataFrame, name: str, text: tuple[str, str], image: tuple[str, str], keep: list[str]) -> DataFrame:
    """The four scores of two texts and two pictures: T0_I0, T0_I1, T1_I0, T1_I1."""
    f = find_scorer(name)
    return pairs.select(*keep, *[f(F.col(text[t]), F.col(image[i])).alias(f"T{t}_I{i}") for t in (0, 1) for i in (0, 1)])


def closest_choice(answer: Column, choices: Column) -> Column:
    """The answer if it is among the choices, else the choice at the least edit distance, the first of equals. A stand-in for a sentence model."""
    ranked = F.array_sort(F.transform(choices, lambda c, i: F.struct(F.levenshtein(answer, c).alias("d"), i.alias("i"), c.alias("c"))))
    return F.when(F.array_contains(choices, answer), answer).otherwise(F.get(ranked, F.lit(0))["c"])


def generator(name: str) -> Callable:
    """Register a text generator: a prompt and the number of a sequence give a text."""

    def add(f):
        _generators[name] = f
        return f

    return add


@generator("stub-echo")
def stub_echo(prompt: str, sequence: int) -> str:
    """The last line of a prompt with the sequence's number."""
    return f"{prompt.splitlines()[-1] if prompt else ''} [{sequence}]"


def generate(prompts: DataFrame, key: str, prompt: str, name: str, sequences: int) -> DataFrame:
    """``sequences`` texts per prompt: key, sequence, output. Batches reach the model whole; a null prompt has none."""
    if name not in _generators:
        raise KeyError(f"no generator {name}; known: {', '.join(sorted(_generators))}")
    f = _generators[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b[prompt].notna()]
            rows = [(k, s, f(p, s)) for k, p in zip(b[key], b[prompt]) for s in range(sequences)]
            yield pd.DataFrame(rows, columns=[key, "sequence", "output"], dtype=object if not rows else None)

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, prompt).mapInPandas(run, f"{key} {kind}, sequence int, output string")


def question_scores(questions: DataFrame, by: list[str], question: str, choices: str, answer: str, prediction: str, position: str) -> DataFrame:
    """Share of questions answered right, a free answer being read as the closest choice."""
    from pairloom.functions.captions import vqa_answer
    from pairloom.operators.metrics import answer_score

    read = questions.withColumn("__a", closest_choice(vqa_answer(F.col(prediction)), F.col(choices)))
    return answer_score(read, by, "__a", answer)


def all_scores(samples: DataFrame, key: str, texts: str, images: str, name: str) -> DataFrame:
    """The score of every text with every picture of a sample: key, text, image (positions), score."""
    f = find_scorer(name)
    long = samples.select(key, F.posexplode(texts).alias("text", "__t"), F.col(images).alias("__i")).select(key, "text", "__t", F.posexplode("__i").alias("image", "__v"))
    return long.select(key, "text", "image", f(F.col("__t"), F.col("__v")).alias("score"))


def cheap_first(rows: DataFrame, cheap: Column, least: float, costly: Column, name: str = "score") -> DataFrame:
    """Rows whose cheap score reaches a limit, with the costly one. The filter stands before the projection, which Spark doesn't move below it when it calls Python."""
    passed = rows.withColumn("__cheap", cheap).filter(F.coalesce((F.col("__cheap") >= least) & ~F.isnan("__cheap"), F.lit(False)))
    return passed.withColumn(name, costly).drop("__cheap")
