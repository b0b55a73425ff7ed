"""Queries over the safety rules. Drafts, evidence and queries are made of conversation turns and lexicon terms."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import fold
from quillspark.operators import generation, lexicon, safety

from .base import CASES_SQL, cases, table

FOUND: dict = {}


def query(sql: str | None = None):
    def keep(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return keep


_TERMS = [*lexicon.CONDITIONS, *lexicon.RECOMMENDATIONS, *[t for ts in lexicon.RISK_TERMS.values() for t in ts]]
_SIGNS = [" y ".join(g) for _, groups in lexicon.RED_FLAGS for g in groups]
_SQL_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

#: conv_id, turn, draft, e1, e2, ask, sim: a turn's text with terms picked by its numbers.
_TEXTS_SQL = f"""texts AS (SELECT conv_id, turn, coalesce(text, '') || ' Posible ' || {_SQL_LIST(_TERMS)}[CAST((conv_id * 7 + turn * 3) % {len(_TERMS)} AS INTEGER) + 1] || ', ' || {_SQL_LIST(lexicon.REASSURING)}[CAST((conv_id + turn) % {len(lexicon.REASSURING)} AS INTEGER) + 1] || '.' AS draft,
  'Caso de ' || {_SQL_LIST(_TERMS)}[CAST((conv_id * 7 + turn * (turn % 2 + 2)) % {len(_TERMS)} AS INTEGER) + 1] AS e1, 'Otro con ' || {_SQL_LIST(_TERMS)}[CAST((conv_id + turn * 11) % {len(_TERMS)} AS INTEGER) + 1] AS e2,
  CASE WHEN conv_id % 3 = 0 THEN 'Paciente con ' || {_SQL_LIST(_SIGNS)}[CAST((conv_id + turn * 5) % {len(_SIGNS)} AS INTEGER) + 1] ELSE 'consulta' END AS ask, CAST((conv_id + turn) % 10 AS DOUBLE) / 10 AS sim FROM conversations),
n AS (SELECT conv_id, turn, sim, strip_accents(lower(draft)) AS d, strip_accents(lower(e1)) AS e1, strip_accents(lower(e2)) AS e2, strip_accents(lower(ask)) AS q, draft FROM texts)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs) + 1).cast("int"))
    draft = F.concat(F.coalesce("text", F.lit("")), F.lit(" Posible "), pick(_TERMS, c * 7 + t * 3), F.lit(", "), pick(lexicon.REASSURING, c + t), F.lit("."))
    e1, e2 = F.concat(F.lit("Caso de "), pick(_TERMS, c * 7 + t * (t % 2 + 2))), F.concat(F.lit("Otro con "), pick(_TERMS, c + t * 11))
    ask = F.when(c % 3 == 0, F.concat(F.lit("Paciente con "), pick(_SIGNS, c + t * 5))).otherwise("consulta")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", draft.alias("draft"), F.array(e1, e2).alias("evidence"), ask.alias("ask"), (((c + t) % 10).cast("double") / 10).alias("sim"))


def _in(col: str, term: str) -> str:
    return rf"regexp_matches({col}, '\b{re.escape(term)}\b')".replace("\\ ", " ")


def _found(col: str, terms: list[str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_in(col, t)} THEN '{t}' END" for t in terms) + "], lambda x: x IS NOT NULL)"


def _unsupported(terms: list[str]) -> str:
    return "list_sort([" + ", ".join(f"CASE WHEN {_in('d', t)} AND NOT {_in('e1', t)} AND NOT {_in('e2', t)} THEN '{t}' END" for t in terms) + "])"


def _joined(expr: str) -> str:
    return f"array_to_string(list_filter({expr}, lambda x: x IS NOT NULL), ',')"


@query("""WITH t AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS t FROM conversations), s AS (SELECT conv_id, turn, count(*) AS c FROM (SELECT conv_id, turn, lower(trim(unnest(regexp_split_to_array(t, '[.\\n]')))) AS s FROM t) WHERE length(s) > 8 GROUP BY conv_id, turn, s)
SELECT conv_id, turn, CASE WHEN t = '' THEN 'vacio' ELSE concat_ws(',', CASE WHEN len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) < 12 THEN 'muy_corto' END, CASE WHEN coalesce((SELECT max(c) FROM s WHERE s.conv_id = t.conv_id AND s.turn = t.turn), 0) >= 3 THEN 'repetitivo' END) END AS flags FROM t""")
def safety_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(safety.draft_flags("text"), ",").alias("flags"))


@query(f"WITH {_TEXTS_SQL} SELECT conv_id, turn, {_joined(_found('d', lexicon.CONDITIONS))} AS conditions, {_joined(_found('d', lexicon.RECOMMENDATIONS))} AS recommendations FROM n")
def lexicon_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _texts(spark, sf_dir)
    return t.select("conv_id", "turn", F.array_join(safety.terms_in(fold("draft"), lexicon.CONDITIONS), ",").alias("conditions"), F.array_join(safety.terms_in(fold("draft"), lexicon.RECOMMENDATIONS), ",").alias("recommendations"))


@query(f"WITH {_TEXTS_SQL} SELECT conv_id, turn, {_joined(_unsupported(lexicon.CONDITIONS))} AS diagnoses, {_joined(_unsupported(lexicon.RECOMMENDATIONS))} AS recommendations FROM n")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _texts(spark, sf_dir)
    return t.select("conv_id", "turn", F.array_join(safety.unsupported("draft", "evidence", lexicon.CONDITIONS), ",").alias("diagnoses"), F.array_join(safety.unsupported("draft", "evidence", lexicon.RECOMMENDATIONS), ",").alias("recommendations"))


_RISKS = "[" + ", ".join(f"CASE WHEN {_in('d', t)} THEN '{t}:{c}' END" for c, ts in lexicon.RISK_TERMS.items() for t in ts) + "]"


@query(f"WITH {_TEXTS_SQL} SELECT conv_id, turn, {_joined(_RISKS)} AS risks FROM n")
def risk_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _texts(spark, sf_dir)
    return t.select("conv_id", "turn", F.array_join(F.transform(safety.risk_terms("draft"), lambda r: F.concat(r["termino"], F.lit(":"), r["categoria"])), ",").alias("risks"))


_FLAGS = "[" + ", ".join("CASE WHEN " + " OR ".join("(" + " AND ".join(_in("q", t) for t in g) + ")" for g in groups) + f" THEN '{s}' END" for s, groups in lexicon.RED_FLAGS) + "]"


@query(f"WITH {_TEXTS_SQL} SELECT conv_id, turn, {_joined(_FLAGS)} AS red_flags FROM n")
def red_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("conv_id", "turn", F.array_join(safety.red_flags("ask"), ",").alias("red_flags"))


@query(f"WITH {_TEXTS_SQL}, x AS (SELECT conv_id, turn, {_found('d', lexicon.CONDITIONS)} AS a, {_found('e1', lexicon.CONDITIONS)} AS b FROM n) SELECT conv_id, turn, len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) = 0 AS changed FROM x")
def entity_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("conv_id", "turn", safety.entity_changed("draft", "evidence").alias("changed"))


_CALM = " OR ".join(_in("d", p) for p in lexicon.REASSURING)
_HIGH = " OR ".join(_in("d", t) for c in lexicon.HIGH_RISK for t in lexicon.RISK_TERMS[c])
_ANY_RISK = " OR ".join(_in("d", t) for ts in lexicon.RISK_TERMS.values() for t in ts)
_SENTENCES = r"list_filter(list_transform(regexp_split_to_array(trim(draft), '[.\n]'), lambda x: lower(trim(x))), lambda x: length(x) > 8)"


@query(rf"""WITH {_TEXTS_SQL},
x AS (SELECT conv_id, turn, sim, {_joined(_FLAGS)} <> '' AS red, ({_CALM}) AS calm, ({_HIGH}) AS high, ({_ANY_RISK}) AS risky, {_joined(_unsupported(lexicon.CONDITIONS))} <> '' AS dx, {_joined(_unsupported(lexicon.RECOMMENDATIONS))} <> '' AS rec, {_found('d', lexicon.CONDITIONS)} AS a, {_found('e1', lexicon.CONDITIONS)} AS b,
  trim(draft) = '' AS empty, len(list_filter(regexp_split_to_array(trim(draft), '\s+'), lambda x: x <> '')) < 12 AS few, {_SENTENCES} AS s FROM n),
y AS (SELECT *, len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) = 0 AS changed, len(list_filter(list_distinct(s), lambda t: len(list_filter(s, lambda u: u = t)) >= 3)) > 0 AS again FROM x)
SELECT conv_id, turn, CASE WHEN empty OR dx OR changed OR red OR high THEN 'alto' WHEN few OR again OR risky OR rec OR sim < 0.35::DOUBLE THEN 'medio' ELSE 'bajo' END AS level, red AND calm AS false_reassurance, sim < 0.35::DOUBLE AS weak FROM y""")
def risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole verdict: level, false reassurance, weak evidence."""
    v = safety.analyze(_texts(spark, sf_dir), "draft", "evidence", "ask", "sim")
    return v.select("conv_id", "turn", F.col("verdict.nivel").alias("level"), F.col("verdict.falsa_tranquilizacion").alias("false_reassurance"), F.col("verdict.evidencia_debil").alias("weak"))


_LINES = lambda *parts: " || chr(10) || ".join(parts)
_STUB = "'[BORRADOR DE PRUEBA — sin VLM]'"
_HOW = "elegí un generador con modelo."


@query(f"""WITH {CASES_SQL}, e AS (SELECT conv_id, trim(question) AS q, len(coalesce(responses, [])) > 0 AS has, trim(coalesce(responses[1], '')) AS a FROM cases)
SELECT conv_id, {_LINES(f"'{generation.INSTRUCTION}'", "''", "'CONSULTA DEL PACIENTE:'", "q", "''", "CASE WHEN has THEN 'CASOS SIMILARES DE REFERENCIA:' || chr(10) || '[1] (similitud 0.50) ' || a ELSE '(No se encontraron casos similares de referencia.)' END", "''", f"'{generation.CLOSING}'")} AS prompt,
CASE WHEN has THEN {_LINES(_STUB, "'Basado en 1 caso(s) similar(es).'", "''", "'El caso más parecido sugiere:'", "a", "''", f"'⚠️ Borrador automático preliminar — requiere revisión y aprobación médica. Para generar texto real con el modelo, {_HOW}'")}
ELSE {_LINES(_STUB, f"'No se encontraron casos similares para fundamentar un borrador. Para usar el modelo real, {_HOW}'")} END AS draft FROM e""")
def draft_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service prompt and stub draft of every case, its first response as evidence."""
    c = cases(spark, sf_dir).withColumn("evidence", F.transform(F.slice("responses", 1, 1), lambda a: F.struct(a.alias("answer"), F.lit(0.5).alias("similitud"))))
    return c.select("conv_id", generation.draft_prompt("question", "evidence").alias("prompt"), generation.stub_draft("evidence").alias("draft"))
