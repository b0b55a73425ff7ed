"""Model boundary: prompts, chat messages and deterministic stand-ins; models are injected and never live here."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.payloads import valid_synthesis
from quillspark.functions.text import clean_text, strip
from quillspark.sources import readers

# The texts of the prompts.
INSTRUCTION = (
    "Sos un asistente que redacta un BORRADOR de respuesta dermatológica para que "
    "un médico lo revise y apruebe. Basate ÚNICAMENTE en los casos similares de "
    "referencia (y en la imagen, si está). No inventes diagnósticos, estudios ni "
    "tratamientos que no estén respaldados por la evidencia. Si los casos son "
    "insuficientes o se contradicen, decilo explícitamente en lugar de inventar."
)
CLOSING = "Redactá un borrador conciso en español, fiel a los casos de referencia. Recordá: es un borrador para revisión médica, no una indicación final."
CURRENT, SIMILAR = "Consulta actual:", "Casos similares recuperados del conjunto de entrenamiento:"
ANSWER_NOW = "Responde ahora la consulta actual en espanol clinico, claro y prudente."
NO_META = "No digas que estas usando RAG ni que 'las respuestas sugieren'."


class Encoder(Protocol):
    """Texts or image bytes to vectors."""

    def __call__(self, batch: list) -> list[list[float]]: ...


def encoded(df: DataFrame, make: Callable[[], Encoder], column: str, out: str, prefix: str = "", batch: int = 64) -> DataFrame:
    """df with vectors of an injected encoder, made once a worker."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for s in frames:
            rows = [prefix + (x or "") if isinstance(x, str) or x is None else x for x in s]
            yield pd.Series([v for i in range(0, len(rows), batch) for v in encoder(rows[i : i + batch])])

    return df.withColumn(out, run(column))


#: Image paths that may be broadcast to the scan.
BROADCAST_PATHS = 100_000


def image_vectors(rows: DataFrame, folders: list[str], make: Callable[[], Encoder], name: str = "image_id", out: str = "vector", batch: int = 64) -> DataFrame:
    """rows with image_path, the vector of the image and has_image. Image files below the folders are scanned once, those that rows
    name are encoded in batches by an injected encoder of bytes, once each, and vectors, not images, are joined to the rows; a row
    whose image is missing or can't be read has none."""
    spark = rows.sparkSession
    named = readers.find_images(rows, readers.image_index(spark, folders), name)
    wanted = named.select(F.col("image_path").alias("path")).filter("path is not null").distinct()
    parts = [spark.read.format("binaryFile").option("pathGlobFilter", readers.IMAGE_GLOB).option("recursiveFileLookup", "true").load(f).select("path", "content") for f in folders]
    scanned = reduce(DataFrame.unionByName, parts).join(F.broadcast(wanted) if wanted.count() <= BROADCAST_PATHS else wanted, "path", "left_semi")

    def predictor() -> Callable:
        encoder = make()

        def predict(content: np.ndarray) -> np.ndarray:
            return np.asarray(encoder([bytes(x) for x in content]), np.float32)

        return predict

    encode = predict_batch_udf(predictor, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    vectors = scanned.filter(F.octet_length("content") > 0).select(F.col("path").alias("image_path"), encode("content").alias(out))
    return named.join(vectors, "image_path", "left").select(*rows.columns, "image_path", out, F.col(out).isNotNull().alias("has_image"))


class Transient(Exception):
    """What a client raises when the same call may work later."""


#: Attempts of a synthesis in order: name, response format, what is added to the prompt.
LADDER = (
    ("structured", "json_schema", ""),
    ("json_retry", "json_object", "La respuesta no era JSON válido. Devolvé solo el objeto JSON con las claves pedidas."),
    ("plain_retry", None, "Devolvé solo el objeto JSON con las claves pedidas, sin formato ni texto alrededor."),
    ("compact_retry", None, "Si el caso es ambiguo, respondé en forma breve y prudente con lo que dicen las respuestas originales, en el mismo JSON."),
)
MOST_CALLS = 5
Client = Callable[[str, str | None], str]


def synthesized(df: DataFrame, make: Callable[[], Client], prompt: str, wait: Callable[[int], None] | None = None) -> DataFrame:
    """df with `payload` (the first valid answer of the ladder, null if there is none), `attempt` (its number) and `calls`. The client
    is injected and made once a worker; a transient error is tried again up to MOST_CALLS times, any other error ends the row."""
    names = df.columns
    schema = T.StructType([*df.schema, T.StructField("payload", T.StringType()), T.StructField("attempt", T.LongType()), T.StructField("calls", T.LongType())])

    def one(client: Client, text: str) -> tuple[str | None, int | None, int]:
        calls = 0
        for number, (_, form, more) in enumerate(LADDER, 1):
            for again in range(MOST_CALLS):
                calls += 1
                try:
                    raw = client(f"{text}\n{more}" if more else text, form)
                    break
                except Transient:
                    if again == MOST_CALLS - 1:
                        return None, None, calls
                    if wait:
                        wait(again)
            if valid_synthesis(raw):
                return raw, number, calls
        return None, None, calls

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for f in frames:
            found = [one(client, t or "") for t in f[prompt]]
            yield f[names].assign(payload=[x[0] for x in found], attempt=pd.array([x[1] for x in found], "Int64"), calls=[x[2] for x in found])

    return df.mapInPandas(run, schema)


def case_prompt(question: Column | str, contexts: Column | str, no_meta: bool = False) -> Column:
    """Prompt of a question and array<struct<question_es, answer_es>>."""
    c = F.col(contexts) if isinstance(contexts, str) else contexts
    cases = F.transform(c, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". Pregunta similar: "), x["question_es"], F.lit("\n   Respuesta del caso similar: "), x["answer_es"]))
    head = F.array(F.lit(CURRENT), clean_text(question), F.lit(""), F.lit(SIMILAR))
    tail = F.array(F.lit(""), F.lit(ANSWER_NOW), *([F.lit(NO_META)] if no_meta else []))
    return F.array_join(F.concat(head, cases, tail), "\n")


def draft_prompt(query: Column | str, evidence: Column | str) -> Column:
    """Prompt of the service: array<struct<answer, similitud>>."""
    q, e = (F.col(x) if isinstance(x, str) else x for x in (query, evidence))
    cases = F.transform(e, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"), F.when(x["similitud"].isNotNull(), F.format_string(" (similitud %.2f)", x["similitud"])).otherwise(""), F.lit(" "), strip(F.coalesce(x["answer"], F.lit("")))))
    middle = F.when(F.size(e) > 0, F.concat(F.array(F.lit("CASOS SIMILARES DE REFERENCIA:")), cases)).otherwise(F.array(F.lit("(No se encontraron casos similares de referencia.)")))
    return F.array_join(F.concat(F.array(F.lit(INSTRUCTION), F.lit(""), F.concat(F.lit("CONSULTA DEL PACIENTE:\n"), strip(q)), F.lit("")), middle, F.array(F.lit(""), F.lit(CLOSING))), "\n")


def stub_draft(evidence: Column | str, images: Column | None = None, how: str = "elegí un generador con modelo") -> Column:
    """Deterministic draft from the first evidence; stands in for a model. `how` tells the reader how to get one."""
    e = F.col(evidence) if isinstance(evidence, str) else evidence
    head = F.lit("[BORRADOR DE PRUEBA — sin VLM]\n")
    shown = F.when(images > 0, F.concat(F.lit(" Se recibieron "), images.cast("string"), F.lit(" imagen(es)."))).otherwise("") if images is not None else F.lit("")
    some = F.concat(head, F.lit("Basado en "), F.size(e).cast("string"), F.lit(" caso(s) similar(es)."), shown, F.lit("\n\nEl caso más parecido sugiere:\n"), strip(F.coalesce(F.get(e, F.lit(0))["answer"], F.lit(""))), F.lit("\n\n⚠️ Borrador automático preliminar — requiere revisión y aprobación médica. Para generar texto real con el modelo, "), F.lit(f"{how}."))
    none = F.concat(head, F.lit("No se encontraron casos similares para fundamentar un borrador. Para usar el modelo real, "), F.lit(f"{how}."))
    return F.when(F.size(e) > 0, some).otherwise(none)


def chat_messages(question: Column | str, image: Column | str | None = None, answer: Column | str | None = None) -> Column:
    """array<struct<role, type, content>>: the user's image and question, and the answer in training examples."""
    part = lambda r, t, c: F.struct(F.lit(r).alias("role"), F.lit(t).alias("type"), (F.col(c) if isinstance(c, str) else c).alias("content"))
    return F.array(*([part("user", "image", image)] if image is not None else []), part("user", "text", question), *([part("assistant", "text", answer)] if answer is not None else []))
