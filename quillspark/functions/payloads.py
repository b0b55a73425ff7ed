"""JSON payloads of generators: repair, validation, contexts."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, let, strip

LEVELS = ("low", "medium", "high")
MIN_SYNTHESIS_WORDS = 5
FIELDS = "struct<synthesized_answer_es:string,has_conflict:boolean,conflict_note:string,source_support_level:string,final:string,output:string,result:string>"
CONTEXTS = "array<struct<encounter_id:string,question_es:string,answer_es:string,score:double>>"


def _parses(c: Column) -> Column:
    """Whether the text is one JSON object; what doesn't begin like one isn't parsed."""
    return strip(c).startswith("{") & F.try_parse_json(c).isNotNull()


def repair_json(c: Column | str) -> Column:
    """JSON object text of a payload: as it is, without a code fence, or from the first { to the last }; null if none parses. Each form is
    made once, and parsed where it is another one than that before."""

    def repaired(raw: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(raw, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
        embedded = lambda plain: let(F.regexp_extract(plain, r"(?s)\{.*\}", 0), lambda inner: F.when((inner != plain) & _parses(inner), inner))
        return F.when(_parses(raw), raw).otherwise(let(plain, lambda plain: F.when((plain != raw) & _parses(plain), plain).otherwise(embedded(plain))))

    return let(strip(c), repaired)


def synthesis(c: Column | str) -> Column:
    """Struct of a synthesis payload: unwrapped from final, output or result, support level defaulted, null where it has no answer of
    MIN_SYNTHESIS_WORDS words or misses a field. A payload is repaired and parsed once."""

    def picked(outer: Column, inner: Column) -> Column:
        pick = lambda k: F.coalesce(inner[k], outer[k])
        level = F.when(pick("source_support_level").isin(*LEVELS), pick("source_support_level")).when(pick("source_support_level").isNotNull(), "medium")

        def checked(answer: Column) -> Column:
            long_enough = F.size(F.regexp_extract_all(answer, F.lit(r"(?U)\w+"), F.lit(0))) >= MIN_SYNTHESIS_WORDS
            found = F.struct(answer.alias("synthesized_answer_es"), pick("has_conflict").alias("has_conflict"), strip(F.coalesce(pick("conflict_note"), F.lit(""))).alias("conflict_note"), level.alias("source_support_level"))
            return F.when(pick("has_conflict").isNotNull() & level.isNotNull() & long_enough, found)

        return let(strip(pick("synthesized_answer_es")), checked)

    def unwrapped(outer: Column) -> Column:
        wrapped = F.coalesce(*[F.when(outer[k].isNotNull() & _parses(outer[k]), outer[k]) for k in ("final", "output", "result")])
        return let(F.from_json(wrapped, FIELDS), lambda inner: picked(outer, inner))

    return let(F.from_json(repair_json(c), FIELDS), unwrapped)


def _loaded(text: object) -> dict | None:
    """A JSON object, or that of a text that begins with one; what follows it is left out, as the JVM's parser does."""
    if isinstance(text, str):
        try:
            text = json.JSONDecoder().raw_decode(text.strip())[0]
        except ValueError:
            return None
    return text if isinstance(text, dict) else None


def valid_synthesis(raw: str | None) -> bool:
    """Whether a client's answer is a synthesis, told on the spot: the rules of synthesis() for one text."""
    text = (raw or "").strip()
    plain = re.sub(r"\s*```$", "", re.sub(r"(?i)^```(?:json)?\s*", "", text))
    inner = re.search(r"(?s)\{.*\}", plain)
    outer = next((x for t in (text, plain, inner[0] if inner else "") if (x := _loaded(t)) is not None), None)
    if outer is None:
        return False
    wrapped = next((x for k in ("final", "output", "result") if (x := _loaded(outer.get(k))) is not None), {})
    pick = lambda k: outer.get(k) if wrapped.get(k) is None else wrapped[k]
    answer = pick("synthesized_answer_es")
    words = re.findall(r"\w+", answer if isinstance(answer, str) else json.dumps(answer) if answer is not None else "")
    return len(words) >= MIN_SYNTHESIS_WORDS and isinstance(pick("has_conflict"), bool) and pick("source_support_level") is not None


def contexts(c: Column | str) -> Column:
    """Retrieved contexts of a JSON string, none where it is malformed."""
    return F.coalesce(F.from_json(c, CONTEXTS), F.array().cast(CONTEXTS))


def mock_synthesis(answers: Column | str) -> Column:
    """Deterministic synthesis of 0, 1 or more answers: first four joined; support by their number."""
    a = F.col(answers) if isinstance(answers, str) else answers
    n = F.size(a)
    text = (
        F.when(n == 0, "No hay respuestas medicas disponibles para sintetizar.")
        .when(n == 1, F.concat(F.lit("El cuadro es compatible con "), F.regexp_replace(F.get(a, F.lit(0)), r"\.+$", ""), F.lit(".")))
        .otherwise(F.array_join(F.slice(a, 1, 4), " "))
    )
    return F.struct(F.trim(text).alias("synthesized_answer_es"), F.lit(False).alias("has_conflict"), F.lit("").alias("conflict_note"), F.when(n < 2, "low").when(n < 5, "medium").otherwise("high").alias("source_support_level"))


def explanation_payload(c: Column | str) -> Column:
    """Struct of an explanation payload, lists made of scalars, blanks dropped. A payload is repaired and parsed once."""

    def told(p: Column, body: Column) -> Column:
        listed = let(p["evidence"], lambda e: F.coalesce(F.when(F.ltrim(e, F.lit(" \t\r\n")).startswith("["), F.from_json(e, "array<string>")), F.array(e)))
        return F.struct(clean_text(p["answer"]).alias("answer"), F.filter(F.transform(listed, clean_text), lambda x: x != "").alias("evidence"), clean_text(p["explanation"]).alias("explanation"), body.isNull().alias("parse_error"))

    return let(repair_json(c), lambda body: let(F.from_json(body, "struct<answer:string,evidence:string,explanation:string>"), lambda p: told(p, body)))
