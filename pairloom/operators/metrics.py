"""Accuracy metrics of image-text matching, as conditional aggregations in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def greater(a: Column, b: Column) -> Column:
    """a > b, false for null and NaN."""
    return F.coalesce((a > b) & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def percent(hits: Column, places: int | None = 2) -> Column:
    """Share of true values in per cent, rounded half to even if places are given; null for no rows."""
    share = F.try_divide(F.count_if(hits) * 100, F.count(F.lit(1)))
    return share if places is None else F.bround(share, places)


def pair_hits(t0i0: str, t0i1: str, t1i0: str, t1i1: str) -> tuple[Column, Column]:
    """Whether texts and pictures are matched right. ``t0i1`` is the score of text 0 with picture 1."""
    a, b, c, d = map(F.col, (t0i0, t0i1, t1i0, t1i1))
    return greater(a, c) & greater(d, b), greater(a, b) & greater(d, c)


def pair_accuracy(scores: DataFrame, by: list[str] = (), places: int | None = 2, columns: tuple[str, str, str, str] = ("T0_I0", "T0_I1", "T1_I0", "T1_I1")) -> DataFrame:
    """Text, image and group accuracy in per cent and the number of pairs, by group or of all."""
    text, image = pair_hits(*columns)
    return scores.groupBy(*by).agg(percent(text, places).alias("text"), percent(image, places).alias("image"), percent(text & image, places).alias("group"), F.count("*").alias("count"))


def tag_accuracy(scores: DataFrame, tag: str, columns: tuple[str, str, str, str]) -> DataFrame:
    """Accuracy by tag, the largest first."""
    return pair_accuracy(scores, [tag], 2, columns).orderBy(F.desc("count"), tag)


def choice_accuracy(rows: DataFrame, predicted: str, right: int = 0) -> DataFrame:
    """Share of predictions that chose the right position."""
    return rows.agg(percent(F.coalesce(F.col(predicted) == right, F.lit(False)), None).alias("accuracy"), F.count("*").alias("num_samples"))


def match_accuracy(rows: DataFrame, match: str, by: list[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(percent(F.coalesce(F.col(match), F.lit(False)), None).alias("accuracy"), F.count("*").alias("num_samples"))


def question_accuracy(rows: DataFrame, text: list[Column], image: list[Column]) -> DataFrame:
    """Text, image and group accuracy where all questions of a kind must be right; a null answer is wrong."""
    all_of = lambda cs: F.forall(F.array(*[F.coalesce(c, F.lit(False)) for c in cs]), lambda x: x)
    t, i = all_of(text), all_of(image)
    return rows.agg(percent(t, None).alias("text_score"), percent(i, None).alias("image_score"), percent(t & i, None).alias("group_score"), F.count("*").alias("num_samples"))


def answers_accuracy(predictions: DataFrame, truth: DataFrame, key: str, text: list[str], image: list[str]) -> DataFrame:
    """Accuracy of predictions against the truth of the same id; a prediction without truth is wrong."""
    renamed = truth.select(key, *[F.col(c).alias(f"__{c}") for c in (*text, *image)])
    both = predictions.join(renamed, key, "left")
    same = lambda c: F.col(c) == F.col(f"__{c}")
    return question_accuracy(both, [same(c) for c in text], [same(c) for c in image])


def foil_scores(rows: DataFrame, caption: str, foil: str, by: list[str] = (), limit: float = 0.5) -> DataFrame:
    """Accuracy against a limit, the lesser of caption and foil precision, and pairwise accuracy."""
    c, f = F.col(caption), F.col(foil)
    share = lambda x: F.try_divide(F.count_if(x), F.count(F.lit(1)))
    right, wrong = greater(c, F.lit(limit)), greater(F.lit(limit), f)
    return rows.groupBy(*by).agg(
        F.try_divide(F.count_if(right) + F.count_if(wrong), F.count(F.lit(1)) * 2).alias("acc"),
        F.least(share(right), share(wrong)).alias("min_precision"),
        share(greater(c, f)).alias("pairwise_acc"),
        F.count("*").alias("num_samples"),
    )


def answer_score(rows: DataFrame, by: list[str], answer: str, wanted: str) -> DataFrame:
    """Share of right answers among the questions of each group; repeated questions count each time."""
    return rows.groupBy(*by).agg(F.avg(F.when(F.coalesce(F.col(answer) == F.col(wanted), F.lit(False)), 1.0).otherwise(0.0)).alias("score"), F.count("*").alias("questions"))


def question_log(rows: DataFrame, by: list[str], question: str, answer: str, position: str) -> DataFrame:
    """The last answer to each question of a group."""
    return rows.groupBy(*by, question).agg(F.max_by(answer, position).alias(answer))


def mean_of_means(rows: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """The mean over regions of the regions' own means."""
    return rows.groupBy(*outer, *inner).agg(F.avg(value).alias("__m")).groupBy(*outer).agg(F.avg("__m").alias("score"), F.count("*").alias("regions"))


def majority(rows: DataFrame, by: list[str], vote: str, position: str) -> DataFrame:
    """The most frequent vote of each group; of equally frequent ones the one seen first. Votes are counted before they meet."""
    counted = rows.groupBy(*by, vote).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    order = F.struct(F.col("n"), -F.col("first"), F.col(vote))
    return counted.groupBy(*by).agg(F.max(order).alias("m"), F.sum("n").alias("votes")).select(*by, F.col(f"m.{vote}").alias(vote), F.col("m.n").alias("majority"), "votes")


def distribution(rows: DataFrame, by: list[str], at_least: int = 0) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") >= at_least)


def pass_counters(rows: DataFrame, by: list[str], scores: list[str], least: float) -> DataFrame:
    """Rows with all scores, rows that fail and pass a threshold, and the pass rate."""
    known = F.forall(F.array(*[F.col(s).isNotNull() for s in scores]), lambda x: x)
    good = F.forall(F.array(*[F.coalesce((F.col(s) >= least) & ~F.isnan(s), F.lit(False)) for s in scores]), lambda x: x)
    return rows.groupBy(*by).agg(
        F.count_if(known).alias("evaluated"), F.count_if(known & ~good).alias("failed"), F.count_if(good).alias("passed"), F.try_divide(F.count_if(good), F.count_if(known)).alias("pass_rate")
    )


def word_frequency(rows: DataFrame, text: str) -> DataFrame:
    from pairloom.functions.captions import tokens

    return rows.select(F.explode(tokens(F.lower(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
