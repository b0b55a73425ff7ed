"""Case selection: ranked buckets, representative rows, low, high and middle samples, ordered report rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.storage import stored

from .rollup import quantiles


def ranked(rows: DataFrame, bucket: str, order: int, score: str, n: int, largest: bool, ties: list[str]) -> DataFrame:
    """The n first rows by score (ties by the given columns), with bucket, its order and the reason. A top-k, not a total sort."""
    top = rows.orderBy(F.desc(score) if largest else F.asc(score), *ties).limit(n)
    rank = F.row_number().over(Window.orderBy(F.desc(score) if largest else F.asc(score), *ties))  # over n rows
    return top.withColumn("_rank", rank).withColumn("bucket", F.lit(bucket)).withColumn("_order", F.lit(order)).withColumn("reason", F.format_string(f"{bucket}: rank=%d, {score}=%.4f", "_rank", score))


def contrastive(wide: DataFrame, specs: list[tuple[str, str, bool]], keys: list[str], n: int, case: str, spread: str, count: str) -> DataFrame:
    """Rows that any bucket picked, with their buckets and reasons in order. The last bucket takes all rows of the n multi-row cases of
    greatest spread. The rows are computed once; each bucket is a top-k over its columns of the written table."""
    wide = stored(wide, "selection")
    parts = [ranked(wide, b, i, s, n, largest, keys) for i, (b, s, largest) in enumerate(specs)]
    multi = wide.filter(F.col(count) > 1)
    cases = multi.select(case, spread).distinct().orderBy(F.desc(spread), case).limit(n).select(case)
    inside = multi.join(F.broadcast(cases), case).withColumn("_rank", F.row_number().over(Window.partitionBy(case).orderBy(*keys)))  # n rows
    b = "multi_image_inconsistency"
    parts.append(inside.withColumn("bucket", F.lit(b)).withColumn("_order", F.lit(len(specs))).withColumn("reason", F.format_string(f"{b}: rank=%d, {spread}=%.4f", "_rank", spread)).select(*parts[0].columns))
    every = reduce(DataFrame.unionByName, parts)
    packed = every.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_order", "_rank", "bucket", "reason"))).alias("_p"))
    joined = lambda f, sep: F.array_join(F.transform("_p", lambda x: x[f]), sep)
    return packed.select(*keys, joined("bucket", ";").alias("selection_buckets"), joined("reason", " | ").alias("selection_reasons"))


def representative(rows: DataFrame, case: str, value: str, tie: str) -> DataFrame:
    """Of each case the row nearest to the case's mean."""
    mean = F.avg(value).over(Window.partitionBy(case))
    far = rows.withColumn("_far", F.coalesce(F.abs(F.col(value) - mean), F.lit(float("inf"))))
    return far.withColumn("_r", F.row_number().over(Window.partitionBy(case).orderBy("_far", tie))).filter("_r = 1").drop("_far", "_r")


def first_rows(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def low_and_high(rows: DataFrame, value: str, key: str, n: int) -> DataFrame:
    low = rows.orderBy(value, key).limit(n).withColumn("bucket", F.lit("low"))
    high = rows.orderBy(F.desc(value), F.desc(key)).limit(n).withColumn("bucket", F.lit("high"))
    return low.unionByName(high)


def review_sample(cases: DataFrame, value: str, key: str, named: list, n: int = 20, ends: int = 7) -> DataFrame:
    """n cases: named ones, lowest, highest, then those nearest to the upper median; a case keeps its first bucket."""
    middle = quantiles(cases, [], value, [0.5], "higher").select(F.get("q", F.lit(0)).alias("_m"))
    parts = [
        cases.filter(F.col(key).isin(named)).withColumn("_o", F.array_position(F.array(*[F.lit(x) for x in named]), F.col(key)).cast("double")) if named else cases.limit(0).withColumn("_o", F.lit(0.0)),
        cases.orderBy(value, key).limit(ends).withColumn("_o", F.col(value).cast("double")),
        cases.orderBy(F.desc(value), F.desc(key)).limit(ends).withColumn("_o", -F.col(value).cast("double")),
        cases.crossJoin(F.broadcast(middle)).withColumn("_o", F.abs(F.col(value) - F.col("_m")).cast("double")).orderBy("_o", value, key).limit(n + len(named) + 2 * ends).drop("_m"),
    ]
    names = ["survey_named_case", "low_metric_case", "high_metric_case", "middle_metric_case"]
    every = reduce(DataFrame.unionByName, [p.withColumn("_b", F.lit(i)).withColumn("case_bucket", F.lit(b)) for i, (p, b) in enumerate(zip(parts, names))])
    once = first_rows(every, [key], ["_b"])
    return once.orderBy("_b", "_o", value, key).limit(n).drop("_b", "_o")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of least hash of seed and key."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


#: Order of the main report's rows: fixed values.
MAIN_ORDER = {
    ("dataset_enriched", "retrieval_tfidf"): 10,
    ("dataset_enriched", "retrieval_e5"): 11,
    ("dataset_enriched", "retrieval_sbert"): 12,
    ("dataset_enriched", "vlm_lora_case_avg"): 13,
    ("dataset_enriched", "vlm_zero_shot"): 14,
    ("dataset_enriched", "vlm_zero_shot_rag_e5_small_enriched"): 15,
    ("dataset_enriched", "vlm_lora_rag_e5_small_enriched"): 16,
    ("dataset_longest_answer", "retrieval_tfidf_train_only"): 20,
    ("dataset_longest_answer", "retrieval_sbert"): 21,
    ("dataset_longest_answer", "retrieval_multimodal"): 22,
    ("dataset_longest_answer", "vlm_zero_shot"): 23,
    ("dataset_longest_answer", "vlm_lora"): 24,
    ("dataset_longest_answer", "vlm_zero_shot_by_image"): 25,
    ("dataset_longest_answer", "vlm_zero_shot_by_image_rag_e5_small_longest"): 26,
    ("dataset_longest_answer", "vlm_lora_by_image"): 27,
    ("dataset_longest_answer", "vlm_lora_by_image_rag_e5_small_longest"): 28,
}


def main_rows(summaries: DataFrame) -> DataFrame:
    """Rows of the main report with their place. A data set with train-only retrieval shows that retrieval alone."""
    train_only = "retrieval_tfidf_train_only"
    held = summaries.filter((F.col("split") == "test") & (F.col("method") == train_only)).select("dataset_variant").distinct().withColumn("_held", F.lit(True))
    marked = summaries.join(held, "dataset_variant", "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    test = (F.col("split") == "test") & ~((F.col("dataset_variant") == "dataset_enriched") & (F.col("method") == "vlm_lora")) & ~(F.col("_held") & F.col("method").startswith("retrieval_") & (F.col("method") != train_only))
    extra = (F.col("split") == "all") & (F.col("dataset_variant") == "dataset_longest_answer") & ~F.col("_held") & F.col("method").isin("retrieval_sbert", "retrieval_multimodal")
    place: Column = F.lit(999)
    for (d, m), at in MAIN_ORDER.items():
        place = F.when((F.col("dataset_variant") == d) & (F.col("method") == m), at).otherwise(place)
    return marked.filter(test | extra).drop("_held").withColumn("place", place)
