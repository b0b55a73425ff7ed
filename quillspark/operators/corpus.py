"""Answer corpora: best answer by case, rows by image, deduplication, majority, counts, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.arrays import dedupe_answers, longest_answer, valid_answers
from quillspark.functions.text import clean_text, is_blank, normalize_text


def with_longest_answer(cases: DataFrame, responses: str = "responses", field: str | None = None, out: str = "answer") -> DataFrame:
    """Cases with their longest valid answer; cases without one are left out."""
    return cases.withColumn(out, longest_answer(valid_answers(responses, field))).filter(F.col(out).isNotNull())


def answer_counters(cases: DataFrame, responses: str = "responses", field: str | None = None) -> DataFrame:
    """One row: cases, with and without a valid answer."""
    has = F.size(valid_answers(responses, field)) > 0
    return cases.agg(F.count(F.lit(1)).alias("cases"), F.count_if(has).alias("with_answer"), F.count_if(~has).alias("skipped"))


def with_distinct_answers(cases: DataFrame, responses: str = "responses", field: str | None = None) -> DataFrame:
    valid = valid_answers(responses, field)
    return cases.withColumn("source_answers", valid).withColumn("distinct_answers", dedupe_answers(F.col("source_answers")))


def majority_answer(answers: DataFrame, case: str, position: str, text: str) -> DataFrame:
    """Per case the answer whose normalised text is most frequent (the first seen among equals) and its share."""
    keyed = answers.filter(~is_blank(text)).withColumn("key", normalize_text(text))
    groups = keyed.groupBy(case, "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col(position).alias("p"), F.col(text).alias("t"))).alias("f"))
    ranked = groups.withColumn("total", F.sum("n").over(Window.partitionBy(case))).withColumn("r", F.row_number().over(Window.partitionBy(case).orderBy(F.desc("n"), "f.p")))
    return ranked.filter("r = 1").select(case, F.col("f.t").alias("majority_answer"), (F.col("n") / F.col("total")).alias("agreement"))


def by_image(cases: DataFrame, images: str = "image_ids", out: str = "image_id") -> DataFrame:
    """A row for each image of a case; cases without images are left out."""
    return cases.select(*[c for c in cases.columns if c != images], F.explode(images).alias(out))


def split_counts(rows: DataFrame, case: str, images: Column | None = None) -> DataFrame:
    """Rows, cases and images by split, with a total row `all`."""
    measures = [F.count(F.lit(1)).alias("rows"), F.count_distinct(case).alias("cases")] + ([F.sum(images).alias("images")] if images is not None else [])
    return rows.rollup("split").agg(*measures).withColumn("split", F.coalesce("split", F.lit("all")))


def quality_counts(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """One row: rows, duplicate keys, empty texts by column; one pass and one small group by key."""
    per_key = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(clean_text(c) == "").alias(f"empty_{c}") for c in texts])
    return per_key.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicate_keys"), *[F.sum(f"empty_{c}").alias(f"empty_{c}") for c in texts])


def leakage(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that are in more than one split."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("splits"), F.array_sort(F.collect_set(split)).alias("found_in")).filter("splits > 1")


def assert_unique(rows: DataFrame, keys: list[str]) -> None:
    if not rows.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"rows aren't unique by {keys}")


def require_columns(df: DataFrame, columns: list[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")


def require_split(df: DataFrame, split: str) -> DataFrame:
    """Rows of the split; an empty one raises."""
    out = df.filter(F.col("split") == split)
    if out.isEmpty():
        raise ValueError(f"no rows in split {split}")
    return out


def trainable(rows: DataFrame, image: str = "image_path", answer: str = "answer") -> DataFrame:
    return rows.filter(~is_blank(image) & ~is_blank(answer))


def cached_and_missing(cases: DataFrame, cache: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cases with what the cache holds for their key, cases to compute)."""
    hits = cases.join(cache.select(*keys, *columns).dropDuplicates(keys), keys)
    return hits, cases.join(cache.select(*keys).distinct(), keys, "left_anti")


def scorable(pairs: DataFrame, prediction: str, reference: str) -> DataFrame:
    """Pairs of which neither side is blank."""
    return pairs.filter(~is_blank(prediction) & ~is_blank(reference))


def failed_rows(cases: DataFrame, results: DataFrame, keys: list[str], failed: Column) -> DataFrame:
    """Cases whose result failed, to run again."""
    return cases.join(results.filter(failed).select(*keys).distinct(), keys, "left_semi")


def attach(rows: DataFrame, other: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """rows with columns of another table under new names, null where it has no such key; a key that it has twice raises."""
    once = other.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(new) for c, new in columns.items()])
    one = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"rows aren't unique by {keys}"))).otherwise(F.lit(True))
    return rows.join(once, keys, "left").filter(F.coalesce(one.cast("boolean"), F.lit(True))).drop("_n")


def context_histogram(rows: DataFrame, contexts: str) -> DataFrame:
    """contexts, rows: how many rows have how many contexts."""
    return rows.groupBy(F.size(F.coalesce(contexts, F.array())).cast("long").alias("contexts")).agg(F.count(F.lit(1)).alias("rows"))


def merge_reruns(old: DataFrame, rerun: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows that the rerun replaces; a rerun that has a key twice raises."""
    assert_unique(rerun, keys)
    values = [c for c in old.columns if c not in keys]
    joined = old.alias("o").join(rerun.select(*keys, F.struct(*values).alias("_new")), keys, "left")
    return joined.select(*keys, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in values])


def pivot_methods(rows: DataFrame, key: str, method: str, value: str, methods: list[str]) -> DataFrame:
    return rows.groupBy(key).pivot(method, methods).agg(F.first(value))


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns that a frame lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
