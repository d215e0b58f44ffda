"""Queries on the training-data problems, and the SQL that states some of them for checking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.functions.text import main_category, plain, sub_category
from pairloom.llm import cutoffs, format_ledger, latent_leaks, mixing, quota_sample, records, residue, response_defects, split_overlap
from pairloom.session import materialize
from pairloom.sources.tables import table

GROUP = ["source", "category"]
CELL = ["category", "sub_category"]


def _cutoffs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, root, "keep_targets").select(plain(F.col("source")).alias("source"), main_category(F.col("category")).alias("category"), "keep_percent")
    scored = records.scored_records(table(spark, root, "samples"), table(spark, root, "image_scores"))
    return cutoffs.fraction_cutoffs(scored, targets, GROUP)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    limits, scored = _cutoffs(spark, root)
    return cutoffs.kept_rows(scored, limits, GROUP).select("score_id")


def p1_cutoffs(spark: SparkSession, root: str) -> DataFrame:
    return _cutoffs(spark, root)[0]


def _cells(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    found = materialize(records.negative_records(table(spark, root, "samples")).select("edited_image_path", *CELL), "negatives")
    targets = table(spark, root, "sample_targets").select(main_category(F.col("category")).alias("category"), sub_category(F.col("sub_category")).alias("sub_category"), "target_permille", "min_rows")
    return found, quota_sample.quota_cells(found, targets, CELL)


def _report(spark: SparkSession, root: str) -> DataFrame:
    found, cells = _cells(spark, root)
    return quota_sample.quota_report(cells, quota_sample.quota_sample(found, cells, CELL, "edited_image_path"), CELL)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """The cells from which the sample drawn has fewer records than they need."""
    return _report(spark, root).filter("drawn < need").select(*CELL)


def p2_cells(spark: SparkSession, root: str) -> DataFrame:
    return _cells(spark, root)[1].drop("floor")


def p2_sample(spark: SparkSession, root: str) -> DataFrame:
    found, cells = _cells(spark, root)
    return quota_sample.quota_sample(found, cells, CELL, "edited_image_path")


def p2_report(spark: SparkSession, root: str) -> DataFrame:
    """Per target cell what was needed, held and drawn."""
    return _report(spark, root).drop("floor")


def p2_margins(spark: SparkSession, root: str) -> DataFrame:
    """A sample calibrated on the totals of the categories and of the sub-categories only: wanted of each, as far as their cells hold it, and whether the draw met it but for rounding."""
    found, cells = _cells(spark, root)
    report = quota_sample.quota_report(cells, quota_sample.quota_sample(found, cells, CELL, "edited_image_path", margins=[["category"], ["sub_category"]]), CELL)
    level = F.explode(F.array(*(F.struct(F.lit(c).alias("margin"), F.col(c).alias("value")) for c in CELL)))
    totals = report.withColumn("m", level).groupBy("m.margin", "m.value").agg(F.sum(F.least("need", "records")).alias("wanted"), F.sum("drawn").alias("drawn"), F.count_if(F.col("drawn") < F.least("floor", "records")).alias("below_floor"), F.count("*").alias("n"))
    # A cell is drawn to its probability but for one record.
    return totals.select("margin", "value", "wanted", (F.abs(F.col("drawn") - F.col("wanted")) <= F.col("n")).alias("met"), "below_floor")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return response_defects.response_defects(table(spark, root, "edit_responses"), "response_id", "inputcaption", "selectedphrase", "editedphrase", "editedcaption")


def p3_counts(spark: SparkSession, root: str) -> DataFrame:
    return p3_found(spark, root).groupBy("defect").agg(F.count("*").alias("responses"))


def _overlap(spark: SparkSession, root: str) -> split_overlap.Overlap:
    return split_overlap.Overlap(table(spark, root, "samples"), "sample_id", "image_path", "caption", "split")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return _overlap(spark, root).pairs().select(F.least("train_id", "held_id").alias("sample_id_a"), F.greatest("train_id", "held_id").alias("sample_id_b"))


def p4_counts(spark: SparkSession, root: str) -> DataFrame:
    return split_overlap.overlap_counts(_overlap(spark, root), table(spark, root, "samples"), "sample_id", "split", "source")


def _collapsed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, root, "samples").select("sample_id", "ingested_at", format_ledger.canonical_key(F.col("caption"), F.col("negatives.edited_caption")).alias("key"))
    # Two batches by arrival: what arrived before the middle of 2024, and the rest.
    early = F.coalesce(F.col("ingested_at") < F.lit("2024-07-01").cast("timestamp_ntz"), F.lit(False))
    return format_ledger.collapse(rows, "key", "sample_id", [early, ~early])


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return _collapsed(spark, root)[1].select(F.col("keep").alias("keep_id"), F.col("copy").alias("copy_id"))


def p5_groups(spark: SparkSession, root: str) -> DataFrame:
    return _collapsed(spark, root)[0].select(F.col("keep").alias("keep_id"), "copies")


def _index(spark: SparkSession, root: str) -> latent_leaks.LatentIndex:
    return latent_leaks.LatentIndex(table(spark, root, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return latent_leaks.leaked(_index(spark, root), table(spark, root, "bench_pairs"), "id", ["caption_0", "caption_1"]).withColumnRenamed("item", "bench_id")


def p7_paraphrases(spark: SparkSession, root: str) -> DataFrame:
    return latent_leaks.paraphrased(_index(spark, root), table(spark, root, "bench_pairs"), "id", ["caption_0", "caption_1"]).withColumnRenamed("item", "bench_id")


def _mix(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_targets"), "doc_id", "text")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """The sources that fall short in the mixture made."""
    return mixing.shares(*_mix(spark, root)).filter("short").select("source")


def p8_mixture(spark: SparkSession, root: str) -> DataFrame:
    return _mix(spark, root)[0].select("doc_id", "source", "times")


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.shares(*_mix(spark, root))


def p8_word_shares(spark: SparkSession, root: str) -> DataFrame:
    """The report of a mixture measured in words instead of tokens, without what depends on the hashes."""
    docs = table(spark, root, "documents").withColumn("size", F.size(F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda w: w != "")))
    made = mixing.mix(docs, table(spark, root, "mix_targets"), "doc_id", "text", size="size")
    # No threshold leaves out more than the one document that doesn't fit any more.
    largest = docs.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    near = (F.col("mixed_tokens") <= F.col("target_tokens")) & (F.col("short") | (F.col("target_tokens") - F.col("mixed_tokens") <= largest))
    return mixing.shares(*made).select("source", "tokens", "documents", "target_tokens", "short", F.coalesce(near, F.lit(True)).alias("fits"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return residue.flag_residue(table(spark, root, "documents"), "doc_id", "text").select("doc_id")


def p9_kinds(spark: SparkSession, root: str) -> DataFrame:
    return residue.flag_residue(table(spark, root, "documents"), "doc_id", "text").groupBy("kind").agg(F.count("*").alias("documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_cutoffs, p2_found, p2_cells, p2_sample, p2_report, p2_margins, p3_found, p3_counts, p4_found, p4_counts, p5_found, p5_groups, p7_found, p7_paraphrases, p8_found, p8_mixture, p8_shares, p8_word_shares, p9_found, p9_kinds)}


_NEGATIVES = """
neg as (
  select n.edited_image_path path, max(lower(trim(source))) source, max(lower(trim(split_part(n.category, '(', 1)))) category,
    max(case when n.sub_category is null or trim(n.sub_category) = '' then 'others' else lower(trim(n.sub_category)) end) sub_category
  from (select source, unnest(negatives) n from samples) where n.edited_image_path is not null group by 1)"""

_SCORED = f"""with {_NEGATIVES},
last as (
  select edited_image_path path, score_id, tifa_score score from image_scores where edited_image_path is not null
  qualify row_number() over (partition by edited_image_path order by scored_at desc nulls last, score_id desc) = 1),
rec as (
  select neg.source, neg.category, k.keep_percent, score_id, score from neg join last using (path)
  join keep_targets k on k.source = neg.source and k.category = neg.category where score is not null and not isnan(score)),
tied as (select source, category, keep_percent, score, count(*) ties from rec group by all),
steps as (
  select *, sum(ties) over (partition by source, category order by score desc) kept, sum(ties) over (partition by source, category) n from tied),
cut as (
  select source, category, n, score cutoff, kept, ties from steps
  where kept * 100 >= keep_percent * n qualify row_number() over (partition by source, category order by score desc) = 1)
"""

_CELLS = f"""with {_NEGATIVES},
have as (select category, sub_category, count(*) n from neg where category is not null group by all),
need as (
  select t.category, t.sub_category, coalesce(h.n, 0) records,
    greatest(min_rows, ((select coalesce(sum(n), 0) from have) // 10) * target_permille // 1000) need
  from sample_targets t left join have h on t.category = h.category and t.sub_category = h.sub_category)
"""

# The edit distance of two word lists: one row of its table after the other, from the left to the right of each.
_OVERLAPS = r"""with base as (
  select sample_id, lower(trim(split)) split, lower(trim(source)) source,
    nullif(ltrim(regexp_extract(regexp_replace(regexp_replace(regexp_replace(image_path, '\?.*$', ''), '^.*[/\\]', ''), '(.)\.[^.]*$', '\1'), '([0-9]+)[^0-9]*$', 1), '0'), '') number,
    case when caption is not null then list_filter(string_split_regex(lower(caption), '[^\p{L}\p{N}]+'), lambda w: w <> '') end w
  from samples where lower(trim(split)) in ('train', 'validation', 'test')),
duo as (select a.sample_id a, b.sample_id b, a.number m, b.number n, a.w v, b.w w from base a, base b where a.split = 'train' and b.split <> 'train'),
likely as (
  select * from duo where v is not null and w is not null and abs(len(v) - len(w)) <= 2
    and len(list_filter(list_distinct(v), lambda x: not list_contains(w, x))) <= 2 and len(list_filter(list_distinct(w), lambda x: not list_contains(v, x))) <= 2),
near as (
  select a, b from likely where list_reduce(
    list_prepend(range(len(w) + 1), list_transform(v, lambda x: [hash(x)::hugeint])),
    lambda above, x: list_reduce(list_prepend([above[1] + 1], list_transform(range(1, len(w) + 1), lambda j: [j])),
      lambda now, j: list_append(now, least(now[len(now)] + 1, above[j[1]::bigint + 1] + 1, above[j[1]::bigint] + case when hash(w[j[1]::bigint])::hugeint = x[1] then 0 else 1 end))))[len(w) + 1] <= 2),
pairs as (select a, b from duo where m = n union select a, b from near)
"""

_KEYS = r"""with keyed as (
  select sample_id, regexp_replace(lower(caption), '[^\p{L}\p{N}]+', '', 'g') || '|' ||
    coalesce(array_to_string(list_sort(list_transform(coalesce(negatives, []), lambda n: regexp_replace(lower(coalesce(n.edited_caption, '')), '[^\p{L}\p{N}]+', '', 'g'))), ','), '') k
  from samples where caption is not null),
groups as (select k, min(sample_id) keep_id, count(*) copies from keyed group by k)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _SCORED + "select score_id from rec join cut using (source, category) where score >= cutoff",
        "p1_cutoffs": _SCORED
        + """select k.source, k.category, cast(k.keep_percent as bigint) percent, cast(coalesce(n, 0) as bigint) records, cutoff,
          cast(coalesce(kept, 0) as bigint) kept, cast(coalesce(ties, 0) as bigint) ties from keep_targets k left join cut using (source, category)""",
        "p2_found": _CELLS + "select category, sub_category from need where records < need",
        "p2_cells": _CELLS + "select category, sub_category, records, cast(need as bigint) need, cast(greatest(need - records, 0) as bigint) shortfall from need",
        "p2_report": _CELLS + "select category, sub_category, records, cast(need as bigint) need, cast(greatest(need - records, 0) as bigint) shortfall, cast(least(need, records) as bigint) drawn from need",
        "p2_margins": _CELLS
        + """select m.margin, m.value, cast(sum(least(need, records)) as bigint) wanted, true met, 0::bigint below_floor
          from (select *, unnest([{'margin': 'category', 'value': category}, {'margin': 'sub_category', 'value': sub_category}]) m from need) group by all""",
        "p4_found": _OVERLAPS + "select least(a, b) sample_id_a, greatest(a, b) sample_id_b from pairs",
        "p4_counts": _OVERLAPS + "select split, source, count(distinct b) overlapping_rows, count(*) pairs from pairs join base on b = sample_id group by all",
        "p5_found": _KEYS + "select keep_id, sample_id copy_id from keyed join groups using (k) where sample_id <> keep_id",
        "p5_groups": _KEYS + "select keep_id, copies from groups",
        "p8_word_shares": r"""with t as (
          select lower(trim(source)) source, coalesce(sum(len(list_filter(string_split_regex(text, '[^\p{L}\p{N}]+'), lambda w: w <> ''))), 0)::bigint n, count(*) c
          from documents where source is not null and trim(source) <> '' group by 1)
          select lower(trim(m.source)) source, coalesce(t.n, 0)::bigint tokens, coalesce(c, 0)::bigint documents, ((select sum(n) from t) * target_percent // 100)::bigint target_tokens,
            100 * m.max_repeats * coalesce(t.n, 0) < m.target_percent * (select sum(n) from t) short, true fits from mix_targets m left join t on t.source = lower(trim(m.source))""",
        # A word or another mark stands for a token: the result is the same for any usual tokenizer.
        "p8_found": r"""with t as (
          select lower(trim(source)) source, coalesce(sum(length(text) / 4.0), 0) n from documents where source is not null group by 1)
          select m.source from mix_targets m left join t using (source)
          where 100 * m.max_repeats * coalesce(t.n, 0) < m.target_percent * (select sum(n) from t)""",
    }
