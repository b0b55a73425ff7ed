"""Queries over text functions, corpus building and data checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import arrays, payloads, text
from quillspark.operators import corpus, reviewlog
from quillspark.sources import readers, writers

from .base import CASES_SQL, SPLIT_SQL, answered, cases, split_by, table

FOUND: dict = {}


def query(sql: str | None = None):
    def keep(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return keep


_CLEAN = r"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"
_LOW = r"trim(regexp_replace(lower(coalesce({c}, '')), '\s+', ' ', 'g'))"
_NTEXT = r"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[.,;:]', '', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_CLEAN.format(c='text')}) AS clean, sha256({_LOW.format(c='text')}) AS norm, sha256({_NTEXT.format(c='text')}) AS norm_text FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(text.clean_text("text"), 256).alias("clean"), F.sha2(text.normalize("text"), 256).alias("norm"), F.sha2(text.normalize_text("text"), 256).alias("norm_text"))


@query(r"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, sha256(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}_]+') AS t FROM documents)")
def strip_accents_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.folded_tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("tokens"))


@query(f"SELECT doc_id, n AS words, CASE WHEN n <= 20 THEN 'short_0_20' WHEN n <= 60 THEN 'medium_21_60' ELSE 'long_61_plus' END AS bucket FROM (SELECT doc_id, CAST(CASE WHEN {_CLEAN.format(c='text')} = '' THEN 0 ELSE len(string_split({_CLEAN.format(c='text')}, ' ')) END AS BIGINT) AS n FROM documents)")
def word_count_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.word_count("text").alias("words"))
    return d.withColumn("bucket", text.length_bucket(F.col("words")))


@query(f"SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(left(t, 79)) || '…' END AS short FROM (SELECT doc_id, {_CLEAN.format(c='text')} AS t FROM documents)")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate("text", 80).alias("short"))


_MARKERS = " OR ".join(f"contains({_LOW.format(c='text')}, '{m}')" for m in text.GENERIC_MARKERS)


@query(f"SELECT conv_id, turn, trim(coalesce(text, '')) = '' AS auto_empty, CASE WHEN {_CLEAN.format(c='text')} = '' THEN 0 ELSE len(string_split({_CLEAN.format(c='text')}, ' ')) END < 8 AS auto_short, ({_MARKERS}) AS auto_generic FROM conversations")
def generic_marker_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = text.quality_flags("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[c.alias(k) for k, c in flags.items()])


@query("""SELECT doc_id, sha256('{"lang": ' || CAST(to_json(coalesce(lang, '')) AS VARCHAR) || ', "source": ' || CAST(to_json(coalesce(source, '')) AS VARCHAR) || '}') AS hash FROM documents""")
def source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.source_hash({"source": "source", "lang": "lang"}).alias("hash"))


@query(r"""SELECT doc_id, trim(regexp_replace(concat_ws(' ', source, text), '\s+', ' ', 'g')) AS spaced, length(concat_ws(chr(10), nullif(trim(source, ' '), ''), nullif(trim(text, ' '), ''))) AS lines FROM documents""")
def question_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.question_text("source", "text").alias("spaced"), F.length(text.question_text("source", "text", "\n")).cast("long").alias("lines"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN value IS NULL THEN '' ELSE format('{:.3f}', value) END AS value_text, replace(replace(replace(event_type || '/a-b.c', '/', '_'), '-', '_'), '.', '_') AS token FROM events")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"), text.three_decimals(F.col("value")).alias("value_text"), text.method_token(F.concat("event_type", F.lit("/a-b.c"))).alias("token"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'dataset_longest_answer' WHEN 1 THEN 'dataset_enriched' WHEN 2 THEN 'other' ELSE 'dataset_enriched' END AS variant,
CASE event_id % 3 WHEN 0 THEN 'TF-IDF' WHEN 1 THEN 'VLM LoRA' ELSE 'unknown' END AS label, CASE event_id % 2 WHEN 0 THEN 'valid' ELSE 'train' END AS split FROM events""")
def label_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("event_id") % n + 1).cast("int"))
    raw = e.select("event_id", pick(4, "longest_answer", "enriched", "other", "").alias("v"), pick(3, "retrieval_tfidf", "vlm_lora", "unknown").alias("m"), pick(2, "valid_ht", "train").alias("s"))
    return raw.select("event_id", text.dataset_variant("v", F.lit("outputs/dataset_enriched/x.csv")).alias("variant"), text.method_label("m").alias("label"), text.split_label("s").alias("split"))


@query("""SELECT doc_id, CAST(doc_id % 4 AS BIGINT) AS images, CAST(doc_id % 3 AS BIGINT) AS listed, CASE WHEN starts_with(url, '/data/') THEN substr(url, 7) ELSE url END AS path, regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g') AS file
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '/data/' ELSE 'http://' END || source || '/' || doc_id AS url FROM documents)""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    url = F.concat(F.when(F.col("doc_id") % 2 == 0, "/data/").otherwise("http://"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    names = F.array_join(F.array_repeat(F.lit("a.jpg"), (F.col("doc_id") % 4).cast("int")), ";")
    listed = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("'a.jpg'"), (F.col("doc_id") % 3).cast("int")), ", "), F.lit("]"))
    return d.select("doc_id", text.image_count(names).cast("long").alias("images"), text.image_count(listed).cast("long").alias("listed"), text.relative_path(url, "/data").alias("path"), text.safe_file_name(url).alias("file"))


# --------------------------------------------------------------------------- corpus
@query(f"WITH {CASES_SQL} SELECT conv_id, split, answer FROM answered")
def longest_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered(spark, sf_dir).select("conv_id", "split", "answer")


@query(f"WITH {CASES_SQL}, v AS (SELECT conv_id FROM answers WHERE trim(a) <> '' GROUP BY conv_id) SELECT count(*) AS cases, count(v.conv_id) AS with_answer, count(*) - count(v.conv_id) AS skipped FROM cases LEFT JOIN v USING (conv_id)")
def answer_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.answer_counters(cases(spark, sf_dir))


@query(f"""WITH {CASES_SQL}, k AS (SELECT conv_id, a, p, {_NTEXT.format(c='a')} AS key FROM answers WHERE trim(a) <> ''),
g AS (SELECT conv_id, key, count(*) AS n, min(p) AS p FROM k GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, p) AS r FROM g)
SELECT conv_id, a AS majority_answer, round(CAST(n AS DOUBLE) / total, 6) AS agreement FROM r JOIN answers USING (conv_id, p) WHERE r = 1""")
def majority_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).select("conv_id", F.posexplode("responses").alias("p", "a"))
    out = corpus.majority_answer(rows, "conv_id", "p", "a")
    return out.select("conv_id", "majority_answer", F.round("agreement", 6).alias("agreement"))


@query(f"""WITH {CASES_SQL}, v AS (SELECT conv_id, a, p, {_LOW.format(c='a')} AS key FROM answers WHERE trim(a) <> ''), f AS (SELECT conv_id, min(p) AS p, key FROM v WHERE key <> '' GROUP BY conv_id, key)
SELECT cases.conv_id, (SELECT count(*) FROM v WHERE v.conv_id = cases.conv_id) AS source_count, (SELECT count(*) FROM f WHERE f.conv_id = cases.conv_id) AS distinct_count, sha256(coalesce((SELECT string_agg(a, '|' ORDER BY p) FROM f JOIN answers USING (conv_id, p) WHERE f.conv_id = cases.conv_id), '')) AS answers_sha FROM cases""")
def dedupe_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = corpus.with_distinct_answers(cases(spark, sf_dir))
    return out.select("conv_id", F.size("source_answers").cast("long").alias("source_count"), F.size("distinct_answers").cast("long").alias("distinct_count"), F.sha2(F.array_join("distinct_answers", "|"), 256).alias("answers_sha"))


@query(f"WITH {CASES_SQL} SELECT conv_id, split, p - 1 AS image_no, a AS image_id FROM answers")
def explode_by_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row expansion: a row for each element of a case, none for cases without."""
    rows = cases(spark, sf_dir).select("conv_id", "split", F.transform("responses", lambda a, i: F.struct(i.cast("long").alias("image_no"), a.alias("image_id"))).alias("image_ids"))
    return corpus.by_image(rows, "image_ids", "image").select("conv_id", "split", "image.*")


@query(f"WITH {CASES_SQL} SELECT coalesce(split, 'all') AS split, count(*) AS rows, count(DISTINCT conv_id) AS cases, CAST(sum(len(coalesce(responses, []))) AS BIGINT) AS images FROM cases GROUP BY ROLLUP (split)")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.split_counts(cases(spark, sf_dir), "conv_id", F.size("responses"))


@query("SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_keys, CAST(sum(e) AS BIGINT) AS empty_text FROM (SELECT count(*) AS n, count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS e FROM documents GROUP BY lang, source, n_chars)")
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.quality_counts(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"], ["text"])


@query(f"SELECT key, splits, found_in FROM (SELECT sha256(text) AS key, count(DISTINCT split) AS splits, string_agg(DISTINCT split, ',' ORDER BY split) AS found_in FROM (SELECT text, {SPLIT_SQL.format(k='doc_id')} AS split FROM documents) GROUP BY text) WHERE splits > 1")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are in more than one split."""
    rows = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key"), split_by("doc_id").alias("split"))
    return corpus.leakage(rows, "key").select("key", "splits", F.array_join("found_in", ",").alias("found_in"))


@query(f"SELECT CAST(sum(n) AS BIGINT) AS row_count, string_agg(split || '=' || n, ',' ORDER BY split) AS split_counts FROM (SELECT {SPLIT_SQL.format(k='doc_id')} AS split, count(*) AS n FROM documents GROUP BY 1)")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = writers.manifest(table(spark, sf_dir, "documents").select("doc_id", split_by("doc_id").alias("split")))
    return m.select("row_count", F.array_join(F.transform("split_counts", lambda s: F.concat(s["split"], F.lit("="), s["n"].cast("string"))), ",").alias("split_counts"))


@query("""SELECT o_orderkey, CASE WHEN n.k IS NOT NULL THEN 'new' ELSE 'old' END AS version FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') n ON k = o_orderkey
UNION ALL SELECT c_custkey + 100000000, 'new' FROM customer WHERE c_acctbal < 0""")
def summary_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the same key are replaced, others are added."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("old").alias("version"))
    new = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().unionByName(table(spark, sf_dir, "customer").filter("c_acctbal < 0").select((F.col("c_custkey") + 100000000).alias("o_orderkey"))).withColumn("version", F.lit("new"))
    return writers.upsert(old, new, ["o_orderkey"])


@query("SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders")
def merge_reruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed rows are replaced by their rerun."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    rerun = old.filter("status = 'F'").withColumn("price", F.col("price") * 2)
    return corpus.merge_reruns(old, rerun, ["o_orderkey"])


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'hit' END AS kind, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses of a result cache by key."""
    hits, missing = corpus.cached_and_missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"], ["quality"])
    one = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one(hits, "hit").unionByName(one(missing, "missing")).filter("n > 0")


@query("SELECT l_orderkey, max(l_quantity) FILTER (WHERE l_returnflag = 'A') AS A, max(l_quantity) FILTER (WHERE l_returnflag = 'N') AS N, max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS R FROM lineitem GROUP BY l_orderkey")
def method_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.max("l_quantity").alias("q"))
    return corpus.pivot_methods(best, "l_orderkey", "l_returnflag", "q", ["A", "N", "R"])


@query("SELECT r_regionkey AS key, r_name AS name, NULL::DOUBLE AS balance FROM region UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return corpus.union_all(t("region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name")), t("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


# --------------------------------------------------------------------------- payloads
@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_id END AS k FROM events""")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole, fenced, embedded and broken payloads."""
    body = F.format_string('{"k": %d}', "event_id")
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Sure: "), body, F.lit(" done"))).otherwise(F.lit("{broken"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(payloads.repair_json(raw), "$.k").cast("long").alias("k"))


@query(r"""SELECT event_id, CASE event_id % 3 WHEN 1 THEN 'una respuesta de cinco palabras ' || event_id WHEN 0 THEN 'otra respuesta con seis palabras ' || event_id END AS answer,
CASE event_id % 3 WHEN 1 THEN 'medium' WHEN 0 THEN 'high' END AS level FROM events""")
def synthesis_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped, defaulted and rejected syntheses."""
    n, kind = F.col("event_id"), F.col("event_id") % 3
    wrapped = F.format_string('{"final": {"synthesized_answer_es": " otra respuesta con seis palabras %d ", "has_conflict": false, "source_support_level": "high"}}', n)
    odd = F.format_string('{"synthesized_answer_es": "una respuesta de cinco palabras %d", "has_conflict": true, "conflict_note": null, "source_support_level": "strong"}', n)
    short = F.lit('{"synthesized_answer_es": "corta", "has_conflict": false, "source_support_level": "low"}')
    s = payloads.synthesis(F.when(kind == 0, wrapped).when(kind == 1, odd).otherwise(short))
    return table(spark, sf_dir, "events").select("event_id", s["synthesized_answer_es"].alias("answer"), s["source_support_level"].alias("level"))


@query(f"""WITH {CASES_SQL}, v AS (SELECT conv_id, list(a ORDER BY p) AS v FROM answers WHERE trim(a) <> '' GROUP BY conv_id), c AS (SELECT conv_id, coalesce(v, []) AS v FROM cases LEFT JOIN v USING (conv_id))
SELECT conv_id, trim(CASE len(v) WHEN 0 THEN 'No hay respuestas medicas disponibles para sintetizar.' WHEN 1 THEN 'El cuadro es compatible con ' || rtrim(v[1], '.') || '.' ELSE array_to_string(v[1:4], ' ') END) AS answer, CASE WHEN len(v) < 2 THEN 'low' WHEN len(v) < 5 THEN 'medium' ELSE 'high' END AS support FROM c""")
def mock_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = payloads.mock_synthesis(arrays.valid_answers("responses"))
    return cases(spark, sf_dir).select("conv_id", s["synthesized_answer_es"].alias("answer"), s["source_support_level"].alias("support"))


# --------------------------------------------------------------------------- review log: events stand for reviews
_LOG_SQL = """log AS (SELECT event_id AS id, ts AS timestamp, user_id AS job_id, CASE event_id % 3 WHEN 0 THEN 'aprobar' WHEN 1 THEN 'editar' ELSE 'rechazar' END AS accion,
  'borrador ' || event_type || ' ' || (event_id % 5) AS borrador_original, CASE WHEN event_id % 3 = 1 THEN 'borrador ' || event_type END AS edited, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'alto' ELSE 'bajo' END AS seguridad_nivel FROM events)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("id"), F.col("ts").alias("timestamp"), F.col("user_id").alias("job_id"), F.when(i % 3 == 0, "aprobar").when(i % 3 == 1, "editar").otherwise("rechazar").alias("accion"), F.concat(F.lit("borrador "), "event_type", F.lit(" "), (i % 5).cast("string")).alias("borrador_original"),
        F.when(i % 3 == 1, F.concat(F.lit("borrador "), "event_type")).alias("texto_final"), F.when(i % 4 == 1, "alto").when(i % 4 != 0, "bajo").alias("seguridad_nivel"), F.lit(None).cast("string").alias("revisor"), F.col("event_type").alias("consulta"),
    )


@query(f"""WITH {_LOG_SQL}, f AS (SELECT *, CASE accion WHEN 'aprobar' THEN borrador_original WHEN 'editar' THEN edited END AS final FROM log),
s AS (SELECT *, CASE WHEN final IS NULL THEN NULL WHEN final = borrador_original THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (2.0::DOUBLE / 2) * (2.0::DOUBLE / 3) / (2.0::DOUBLE / 2 + 2.0::DOUBLE / 3) END AS s FROM f)
SELECT count(*) AS total, count(*) FILTER (WHERE accion = 'aprobar') AS aprobar, count(*) FILTER (WHERE accion = 'editar') AS editar, count(*) FILTER (WHERE accion = 'rechazar') AS rechazar,
round(CAST(count(*) FILTER (WHERE accion <> 'rechazar') AS DOUBLE) / count(*), 4) AS tasa_aprobacion, round(avg(s), 4) AS similitud, round(1 - round(avg(s), 4), 4) AS edicion_media FROM s""")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviewlog.audit_summary(reviewlog.resolved(_log(spark, sf_dir)))


@query(f"WITH {_LOG_SQL} SELECT coalesce(seguridad_nivel, 'desconocido') AS seguridad_nivel, count(*) AS n FROM log GROUP BY 1")
def audit_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviewlog.counts(_log(spark, sf_dir), "seguridad_nivel")


@query(f"WITH {_LOG_SQL} SELECT job_id, id, accion FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY timestamp, id) AS r FROM log) WHERE r = 1")
def review_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first review of each job."""
    return reviewlog.first_reviews(_log(spark, sf_dir)).select("job_id", "id", "accion")


@query(f"WITH {_LOG_SQL} SELECT 'APR-' || left(sha256(job_id || '|' || id), 10) AS encounter_id, CASE accion WHEN 'aprobar' THEN borrador_original ELSE edited END AS respuesta FROM log WHERE accion <> 'rechazar'")
def approved_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviewlog.approved_cases(reviewlog.resolved(_log(spark, sf_dir))).select("encounter_id", "respuesta")


@query(f"WITH {CASES_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE len(coalesce(responses, [])) > 0) AS with_image, count(*) FILTER (WHERE len(coalesce(responses, [])) = 0) AS text_only FROM cases")
def export_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviewlog.export_stats(cases(spark, sf_dir), "responses")


@query("SELECT vec_id, score FROM (SELECT event_id AS vec_id, coalesce(CASE WHEN event_id % 2 = 0 THEN value END, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS score FROM events) WHERE score IS NOT NULL")
def first_present_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("similarity_score"), F.get_json_object("props", "$.k").alias("score"))
    return readers.read_scores(e, keep=("event_id",)).select(F.col("event_id").alias("vec_id"), "score")
