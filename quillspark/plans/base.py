"""Frames that the registered queries share, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.storage import scratch  # noqa: F401

TRAIN, VALID, TEST = "train", "valid", "test"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_by(key: str) -> Column:
    """Splits by the id's last digit: 0-7 train, 8 valid, 9 test."""
    digit = F.col(key) % 10
    return F.when(digit < 8, TRAIN).when(digit == 8, VALID).otherwise(TEST)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, split, question (first user turn), responses (assistant texts in turn order)."""
    conv = table(spark, sf_dir, "conversations")
    turn = F.struct("turn", "text")
    per = conv.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "user", turn)).alias("q"), F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", turn))).alias("a"))
    return per.select("conv_id", split_by("conv_id").alias("split"), F.col("q.text").alias("question"), F.transform("a", lambda x: x["text"]).alias("responses"))


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, split, question, answer (the longest)."""
    from quillspark.operators.corpus import with_longest_answer

    return with_longest_answer(cases(spark, sf_dir)).select("conv_id", "split", "question", "answer")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the image rows of cases: key columns, an ordinal, and four scores for each of four methods."""
    line = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    scores = {
        "zero_shot": [F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, (F.col("l_discount") + F.col("l_tax")) / 2],
        "zero_shot_rag": [F.col("l_discount") * 1.1, F.col("l_tax"), F.col("l_quantity") / 49, (F.col("l_discount") + F.col("l_tax")) / 2],
        "lora": [F.col("l_tax") * 2, F.col("l_discount"), F.col("l_quantity") / 40, F.col("l_extendedprice") / 100000],
        "lora_rag": [F.col("l_tax") * 2.5, F.col("l_discount") / 2, F.col("l_quantity") / 45, F.col("l_extendedprice") / 110000],
    }
    flat = [c.alias(f"{m}_{x}") for m, cs in scores.items() for x, c in zip(METRICS, cs)]
    return line.select(F.col("l_orderkey").alias("encounter_id"), F.row_number().over(order).cast("long").alias("image_id"), F.col("l_quantity").cast("long").alias("reference_words"), split_by("l_orderkey").alias("split"), *flat)


METRICS = ["chrf", "rouge_l", "token_f1", "bertscore_f1"]
METHODS = ["zero_shot", "zero_shot_rag", "lora", "lora_rag"]

SPLIT_SQL = "CASE WHEN {k} % 10 < 8 THEN 'train' WHEN {k} % 10 = 8 THEN 'valid' ELSE 'test' END"

CASES_SQL = f"""
cases AS (
  SELECT conv_id, {SPLIT_SQL.format(k='conv_id')} AS split,
    min(CASE WHEN role = 'user' THEN {{'turn': turn, 'text': text}} END).text AS question,
    list(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS responses
  FROM conversations GROUP BY conv_id),
answers AS (SELECT conv_id, split, question, unnest(responses) AS a, unnest(range(1, len(responses) + 1)) AS p FROM cases),
answered AS (
  SELECT conv_id, split, question, a AS answer FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(a) DESC, p) AS r FROM answers WHERE trim(a) <> '') WHERE r = 1)
"""

_METRIC_SQL = {
    "zero_shot": ["l_discount", "l_tax", "l_quantity / 50", "(l_discount + l_tax) / 2"],
    "zero_shot_rag": ["l_discount * 1.1::DOUBLE", "l_tax", "l_quantity / 49", "(l_discount + l_tax) / 2"],
    "lora": ["l_tax * 2", "l_discount", "l_quantity / 40", "l_extendedprice / 100000"],
    "lora_rag": ["l_tax * 2.5::DOUBLE", "l_discount / 2", "l_quantity / 45", "l_extendedprice / 110000"],
}

IMAGES_SQL = f"""
images AS (
  SELECT l_orderkey AS encounter_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS image_id,
    CAST(l_quantity AS BIGINT) AS reference_words, {SPLIT_SQL.format(k='l_orderkey')} AS split,
    {', '.join(f'{e} AS {m}_{x}' for m, es in _METRIC_SQL.items() for x, e in zip(METRICS, es))}
  FROM lineitem),
wide AS (
  SELECT *, {', '.join(f'({" + ".join(f"{m}_{x}" for x in METRICS)}) / 4 AS {m}_mean_score' for m in METHODS)},
    count(*) OVER (PARTITION BY encounter_id) AS images_in_encounter FROM images),
effects AS (
  SELECT *, lora_mean_score - zero_shot_mean_score AS delta_lora_vs_zero_shot, zero_shot_rag_mean_score - zero_shot_mean_score AS delta_rag_on_zero_shot, lora_rag_mean_score - lora_mean_score AS delta_rag_on_lora,
    CASE WHEN reference_words <= 20 THEN 'short_0_20' WHEN reference_words <= 60 THEN 'medium_21_60' ELSE 'long_61_plus' END AS reference_length,
    CASE WHEN images_in_encounter > 1 THEN 'multiple_images' ELSE 'single_image' END AS image_count,
    max(lora_mean_score) OVER (PARTITION BY encounter_id) - min(lora_mean_score) OVER (PARTITION BY encounter_id) AS image_spread
  FROM wide)
"""
