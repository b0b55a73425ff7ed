"""Append-only review log: validated reviews, one a job; audit figures; approved cases that rejoin the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.metrics import token_f1
from quillspark.functions.text import strip

ENTRY = "id string, timestamp string, job_id string, accion string, revisor string, nota string, consulta string, borrador_original string, texto_final string, seguridad_nivel string"
ACTIONS = ("aprobar", "editar", "rechazar")


def resolved(reviews: DataFrame) -> DataFrame:
    """Valid reviews with their final text: approval keeps the draft, an edit needs a text, a rejection has none."""
    edited = strip(F.coalesce("texto_final", F.lit("")))
    valid = F.col("accion").isin(*ACTIONS) & ((F.col("accion") != "editar") | (edited != ""))
    final = F.when(F.col("accion") == "aprobar", F.col("borrador_original")).when(F.col("accion") == "editar", edited)
    return reviews.filter(valid).withColumn("texto_final", final)


def first_reviews(reviews: DataFrame, log: DataFrame | None = None, job: str = "job_id", order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """The first review of each job that the log doesn't hold."""
    fresh = reviews if log is None else reviews.join(log.select(job).distinct(), job, "left_anti")
    return fresh.withColumn("_r", F.row_number().over(Window.partitionBy(job).orderBy(*order))).filter("_r = 1").drop("_r")


def counts(entries: DataFrame, column: str, unknown: str = "desconocido") -> DataFrame:
    return entries.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(unknown)).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def audit_summary(entries: DataFrame) -> DataFrame:
    """One row: total, counts by action, approval rate, mean similarity of draft and final text and its complement, counts by level."""
    both = (F.coalesce("borrador_original", F.lit("")) != "") & (F.coalesce("texto_final", F.lit("")) != "")
    scored = entries.withColumn("_s", F.when(both, token_f1("borrador_original", "texto_final", "service")))
    accepted = F.count_if(F.col("accion").isin("aprobar", "editar"))
    n = F.count(F.lit(1))
    out = scored.agg(n.alias("total"), *[F.count_if(F.col("accion") == a).alias(a) for a in ACTIONS], F.when(n > 0, F.round(accepted / n, 4)).alias("tasa_aprobacion"), F.round(F.avg("_s"), 4).alias("similitud"))
    return out.withColumn("edicion_media", F.round(1 - F.col("similitud"), 4))


def approved_cases(entries: DataFrame) -> DataFrame:
    """Approved and edited reviews as cases of the corpus."""
    return entries.filter(F.col("accion").isin("aprobar", "editar")).select(F.concat(F.lit("APR-"), F.substring(F.sha2(F.concat_ws("|", "job_id", "id"), 256), 1, 10)).alias("encounter_id"), "timestamp", "consulta", F.col("texto_final").alias("respuesta"), "revisor", "job_id")


def health(cases: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: cases, reviews, and the approved ones among them."""
    n = F.count(F.lit(1))
    return cases.agg(n.alias("cases")).crossJoin(entries.agg(n.alias("reviews"), F.count_if(F.col("accion").isin("aprobar", "editar")).alias("approved")))  # one row each


def export_stats(cases: DataFrame, images: str = "image_ids") -> DataFrame:
    has = F.coalesce(F.size(images), F.lit(0)) > 0
    return cases.agg(F.count(F.lit(1)).alias("total"), F.count_if(has).alias("with_image"), F.count_if(~has).alias("text_only"))
