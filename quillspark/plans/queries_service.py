"""Queries over rows for training and scoring, service answers, encoders, generators and windows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import payloads, text, vectors
from quillspark.operators import corpus, generation, retrieval, reviewlog, rollup, safety
from quillspark.streaming import reviews

from .base import CASES_SQL, IMAGES_SQL, answered, cases, images, table
from .queries_corpus import _LOG_SQL, _log
from .queries_retrieval import _DOT, _tfidf_sql

FOUND: dict = {}


def query(sql: str | None = None):
    def keep(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return keep


# --------------------------------------------------------------------------- texts that are blank, folded, rounded
_ODD = ["\n", " \t ", "", "x", " \u00e9\u00a0", "\u2003", "a\nb", "\x1c"]
_ODD_SQL = "[" + ", ".join("''" if not t else " || ".join(f"chr({ord(c)})" for c in t) for t in _ODD) + "]"


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.element_at(F.lit(_ODD), (F.col("event_id") % len(_ODD) + 1).cast("int")).alias("t"))


@query(f"""WITH o AS (SELECT event_id, {_ODD_SQL}[CAST(event_id % {len(_ODD)} AS INTEGER) + 1] AS t FROM events)
SELECT event_id, event_id % 8 IN (0, 1, 2, 5, 7) AS blank, CASE event_id % 8 WHEN 3 THEN 'x' WHEN 4 THEN chr(233) WHEN 6 THEN 'a' || chr(10) || 'b' ELSE '' END AS stripped, event_id % 8 IN (0, 1, 2, 5, 7) AS empty_draft,
CAST(CASE WHEN event_id % 8 IN (3, 4, 6) THEN 1 ELSE 0 END AS BIGINT) AS answers FROM o""")
def blank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space of every kind counts as nothing: in answers, flags and drafts."""
    from quillspark.functions.arrays import valid_answers

    return _odd(spark, sf_dir).select("event_id", text.is_blank("t").alias("blank"), text.strip("t").alias("stripped"), F.array_contains(safety.draft_flags("t"), "vacio").alias("empty_draft"), F.size(valid_answers(F.array("t"))).cast("long").alias("answers"))


_FORMS = [("1º", "1o"), ("ﬁebre", "fiebre"), ("½", "1⁄2"), ("ＡＢＣ", "abc"), ("Ｑ1…", "q1..."), ("Ǆ", "dz"), ("ÀÉñ", "aen"), ("x\u0301y", "xy"), ("①", "1"), ("𝐀b", "Ab"), ("ß", "ß")]


@query("SELECT event_id, [" + ", ".join(f"'{b}'" for _, b in _FORMS) + f"][CAST(event_id % {len(_FORMS)} AS INTEGER) + 1] AS folded FROM events")
def folded_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility forms: ordinals, ligatures, fractions, wide letters, loose marks, letters beyond the first plane."""
    forms = F.element_at(F.lit([a for a, _ in _FORMS]), (F.col("event_id") % len(_FORMS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.fold(forms).alias("folded"))


@query("SELECT o_orderkey, round_even(o_orderkey / 8, 2) AS half, CASE o_orderkey % 3 WHEN 0 THEN 'LoRA + RAG' WHEN 1 THEN 'TF-IDF' ELSE 'other' END AS short FROM orders")
def rounded_and_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves to even, and labels for narrow tables."""
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, "vlm_lora_rag_e5_small_enriched").when(k % 3 == 1, "retrieval_tfidf").otherwise("other")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.round_half_even(k / 8, 2).alias("half"), text.short_name(raw).alias("short"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'B' WHEN o_orderkey % 4 = 1 THEN 'A ' || o_orderkey WHEN o_orderkey % 4 = 2 THEN 'B' ELSE '' END AS answer FROM orders")
def first_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first answer that isn't blank, cleaned."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 4 == 0, "\n").when(k % 4 == 1, F.concat(F.lit(" A  "), k.cast("string"))).alias("synthesized_answer_es"), F.when(k % 4 != 3, " B ").alias("answer_es"))
    return rows.select("o_orderkey", text.first_answer().alias("answer"))


# --------------------------------------------------------------------------- rows
@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 IN (0, 3)")
def trainable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an image and an answer."""
    k = F.col("o_orderkey") % 5
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 1, " \n").when(k != 2, "a.jpg").alias("image_path"), F.when(k == 4, "\t").otherwise("x").alias("answer"))
    return corpus.trainable(rows).select("o_orderkey")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, text AS p, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE trim(coalesce(p, '')) <> '' AND trim(coalesce(r, '')) <> ''")
def scorable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with text on both sides."""
    from .queries_metrics import _pairs

    return corpus.scorable(_pairs(spark, sf_dir), "p", "r").select("conv_id", "turn")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def failed_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose result failed."""
    o = table(spark, sf_dir, "orders")
    return corpus.failed_rows(o.select("o_orderkey", "o_totalprice"), o.select("o_orderkey", "o_orderstatus"), ["o_orderkey"], F.col("o_orderstatus") == "F")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus AS base_status, c_name AS customer FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey")
def attached_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of base and other tables under new names, null where the key is missing."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").withColumnRenamed("o_orderkey", "l_orderkey")
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "cust")
    both = corpus.attach(line, o, ["l_orderkey"], {"o_orderstatus": "base_status", "o_custkey": "cust"})
    return corpus.attach(both, c, ["cust"], {"c_name": "customer"}).select("l_orderkey", "l_linenumber", "base_status", "customer")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50")
def sorted_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows in a stated order: the limit is the operator."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").limit(50)


@query(f"WITH {CASES_SQL}, {_tfidf_sql('answered', 'answered', 'conv_id', 'question')}, r AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM scores WHERE q <> d), n AS (SELECT conv_id, count(rank) AS n FROM answered LEFT JOIN r ON q = conv_id AND rank <= 3 GROUP BY 1) SELECT n AS contexts, count(*) AS rows FROM n GROUP BY n")
def contexts_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many questions got how many contexts."""
    rows = answered(spark, sf_dir)
    q, d = rows.select(F.col("conv_id").alias("q"), "question"), rows.select(F.col("conv_id").alias("doc"), "question", "answer")
    hits = retrieval.tfidf_search(q, d.select("doc", "question"), "q", "doc", "question", 3, exclude_same=True)
    packed = retrieval.context_arrays(hits, d, "q", "doc", ["answer"])
    return corpus.context_histogram(q.join(packed, "q", "left"), "contexts")


# --------------------------------------------------------------------------- retrieval as a service
_SERVICE = _tfidf_sql("answered", "ask", "conv_id", "question", bigrams=False, sublinear=False, max_df=False)


@query(f"""WITH {CASES_SQL}, ask AS (SELECT conv_id, question FROM answered WHERE split = 'test'), {_SERVICE},
r AS (SELECT q, d, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM scores WHERE q <> d)
SELECT q, rank, d AS doc, round(score, 4) AS similitud, a.split, a.answer, CAST(len(responses) AS BIGINT) AS n_images FROM r JOIN answered a ON a.conv_id = d JOIN cases c ON c.conv_id = d WHERE rank <= 2""")
def enriched_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with fields of their cases and the number of images."""
    rows = answered(spark, sf_dir)
    found = rows.select(F.col("conv_id").alias("doc"), "split", "question", "answer").join(cases(spark, sf_dir).select(F.col("conv_id").alias("doc"), F.col("responses").alias("image_ids")), "doc")
    q = rows.filter("split = 'test'").select(F.col("conv_id").alias("q"), "question")
    hits = retrieval.tfidf_search(q, rows.select(F.col("conv_id").alias("doc"), "question"), "q", "doc", "question", 2, bigrams=False, sublinear=False, max_df=None, exclude_same=True)
    out = retrieval.enriched_hits(hits, found, "q", "doc", ["split", "answer"], "image_ids")
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("SELECT user_id AS id, event_id, event_type FROM events WHERE user_id = 7 ORDER BY event_id DESC LIMIT 1")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case of an id, the last one of several."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", "event_type")
    return retrieval.point_lookup(e, "id", 7, "event_id")


@query(f"""WITH {CASES_SQL}, ask AS (SELECT conv_id, question FROM answered WHERE split = 'test'), base AS (SELECT conv_id, split, CASE WHEN conv_id % 2 = 0 THEN question ELSE question || ' ' || answer END AS question, answer FROM answered WHERE split = 'train'),
{_tfidf_sql('base', 'ask', 'conv_id', 'question')},
r AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM scores) SELECT q, string_agg(CAST(d AS VARCHAR), ',' ORDER BY rank) AS docs FROM r WHERE rank <= 3 GROUP BY q""")
def cross_dataset_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of one data set, contexts of another."""
    rows = answered(spark, sf_dir)
    q = rows.filter("split = 'test'").select(F.col("conv_id").alias("q"), "question")
    other = rows.filter("split = 'train'").select(F.col("conv_id").alias("doc"), F.when(F.col("conv_id") % 2 == 0, F.col("question")).otherwise(F.concat_ws(" ", "question", "answer")).alias("question"), "answer")
    packed = retrieval.context_arrays(retrieval.tfidf_search(q, other.select("doc", "question"), "q", "doc", "question", 3), other, "q", "doc", ["answer"])
    return packed.select("q", F.array_join(F.transform("contexts", lambda c: c["doc"].cast("string")), ",").alias("docs"))


@query(f"""WITH {CASES_SQL}, train AS (SELECT conv_id, question FROM answered WHERE split = 'train'), ask AS (SELECT conv_id, question FROM answered WHERE split <> 'train'),
{_tfidf_sql('train', 'ask', 'conv_id', 'question')},
v AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 3 <> 0),
p AS (SELECT a.conv_id AS q, b.conv_id AS d, coalesce(score, 0.0::DOUBLE) AS t, qv.embedding IS NOT NULL AS seen, CASE WHEN qv.embedding IS NOT NULL AND dv.embedding IS NOT NULL THEN {_DOT.replace("q.embedding", "qv.embedding").replace("d.embedding", "dv.embedding")} END AS v
  FROM ask a CROSS JOIN train b LEFT JOIN scores s ON s.q = a.conv_id AND s.d = b.conv_id LEFT JOIN v qv ON qv.vec_id = a.conv_id LEFT JOIN v dv ON dv.vec_id = b.conv_id),
s AS (SELECT q, d, seen, CASE WHEN max(t) OVER w = min(t) OVER w THEN 0 ELSE (t - min(t) OVER w) / (max(t) OVER w - min(t) OVER w) END AS a, CASE WHEN v IS NULL OR max(v) OVER w = min(v) OVER w THEN 0 ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END AS b FROM p WINDOW w AS (PARTITION BY q)),
f AS (SELECT q, d, round(CASE WHEN seen THEN 0.6::DOUBLE * a + 0.4::DOUBLE * b ELSE a END, 6) AS score FROM s)
SELECT q, d AS doc, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS r FROM f) WHERE r = 1""")
def fused_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and image search fused over the whole matrix of questions and training cases, in blocks."""
    seen = table(spark, sf_dir, "embeddings").filter("vec_id % 3 <> 0").select(F.col("vec_id").alias("conv_id"), "embedding")
    rows = answered(spark, sf_dir).join(seen, "conv_id", "left")
    q, d = rows.filter("split <> 'train'").select(F.col("conv_id").alias("q"), "question", "embedding"), rows.filter("split = 'train'").select(F.col("conv_id").alias("doc"), "question", "embedding")
    return retrieval.fused_search(q, d, "q", "doc", "question", "embedding").select("q", "doc", "score")


_MEAN = ", ".join(f"round(coalesce(avg(CASE WHEN vec_id % 4 <> 3 AND vec_id // 5 % 6 <> 0 THEN CAST(embedding[{i + 1}] AS DOUBLE) END), 0), 6) AS v{i}" for i in (0, 9, 63))


@query(f"SELECT vec_id // 5 AS conv, count(CASE WHEN vec_id % 4 <> 3 AND vec_id // 5 % 6 <> 0 THEN 1 END) > 0 AS has_image, {_MEAN} FROM embeddings GROUP BY 1")
def case_mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of a case's images; zeros and a flag where none has one."""
    k = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").select(F.floor(k / 5).cast("long").alias("conv"), F.when((k % 4 != 3) & (F.floor(k / 5) % 6 != 0), F.col("embedding")).alias("embedding"))
    out = retrieval.case_mean_vectors(e, "conv", "embedding", 64)
    return out.select("conv", "has_image", *[F.round(F.get("embedding", F.lit(i)), 6).alias(f"v{i}") for i in (0, 9, 63)])


def _counting_encoder():
    """Stands for a model: length, vowels and spaces of a text."""
    return lambda batch: [[float(len(t)), float(sum(t.count(v) for v in "aeiou")), float(t.count(" "))] for t in batch]


@query("""WITH e AS (SELECT conv_id, turn, 'query: ' || coalesce(text, '') AS a, 'passage: ' || coalesce(text, '') AS b FROM conversations),
v AS (SELECT conv_id, turn, list_transform([a, b], lambda t: [CAST(length(t) AS DOUBLE), CAST(length(regexp_replace(t, '[^aeiou]', '', 'g')) AS DOUBLE), CAST(length(regexp_replace(t, '[^ ]', '', 'g')) AS DOUBLE)]) AS v FROM e)
SELECT conv_id, turn, round(list_inner_product(v[1], v[2]) / sqrt(list_inner_product(v[1], v[1])) / sqrt(list_inner_product(v[2], v[2])), 6) AS cosine FROM v""")
def encoded_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through an injected encoder under two prefixes, compared by the cosine of their vectors."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    both = generation.encoded(generation.encoded(c, _counting_encoder, "text", "a", "query: "), _counting_encoder, "text", "b", "passage: ")
    return both.select("conv_id", "turn", F.round(vectors.dot(vectors.l2_normalize("a"), vectors.l2_normalize("b")), 6).alias("cosine"))


# --------------------------------------------------------------------------- generators
@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'user:image:i.jpg|' ELSE '' END || 'user:text:' || coalesce(text, '') || '|assistant:text:ok' AS messages FROM conversations")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a training example, with an image or without."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    told = lambda m: F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["role"], x["type"], x["content"])), "|")
    return c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, told(generation.chat_messages("text", F.lit("i.jpg"), F.lit("ok")))).otherwise(told(generation.chat_messages("text", answer=F.lit("ok")))).alias("messages"))


def _flaky_client():
    """Stands for a service: by the number in the prompt it answers at once, late, never, or after errors."""
    errors: dict[str, int] = {}

    def call(prompt: str, form: str | None) -> str:
        n = int(prompt.split()[1])
        good = json.dumps({"synthesized_answer_es": f"una respuesta de cinco palabras {n}", "has_conflict": False, "source_support_level": "low"})
        if n % 5 == 0 or n % 5 == 1 and form == "json_object" or n % 5 == 2 and "ambiguo" in prompt:
            return good
        if n % 5 == 4:
            errors[prompt] = errors.get(prompt, 0) + 1
            if errors[prompt] % 3:
                raise generation.Transient
            return f"```json\n{good}\n```"
        return "" if n % 2 else "{broken"

    return call


@query("SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 4 THEN 1 END AS BIGINT) AS attempt, CAST(CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 3 ELSE 4 END AS BIGINT) AS calls, CASE WHEN event_id % 5 <> 3 THEN 'una respuesta de cinco palabras ' || event_id END AS answer FROM events")
def synthesis_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts until an answer is valid, calls repeated after transient errors."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("case "), F.col("event_id").cast("string"), F.lit(" ")).alias("prompt"))
    out = generation.synthesized(e, _flaky_client, "prompt")
    return out.select("event_id", "attempt", "calls", payloads.synthesis("payload")["synthesized_answer_es"].alias("answer"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '' ELSE 'si' END AS answer, CASE event_id % 3 WHEN 0 THEN 'a|b' WHEN 1 THEN 'solo' ELSE '' END AS evidence, event_id % 3 = 2 AS parse_error FROM events")
def explanation_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanations with a list or one text as evidence, and broken ones."""
    k = F.col("event_id") % 3
    raw = F.when(k == 0, '{"answer": " si ", "evidence": ["a", " ", "b"], "explanation": "x"}').when(k == 1, 'so: {"answer": "si", "evidence": "solo", "explanation": "x"}').otherwise("{oops")
    p = table(spark, sf_dir, "events").select("event_id", payloads.explanation_payload(raw).alias("p"))
    return p.select("event_id", F.coalesce("p.answer", F.lit("")).alias("answer"), F.array_join(F.coalesce("p.evidence", F.array().cast("array<string>")), "|").alias("evidence"), F.col("p.parse_error").alias("parse_error"))


# --------------------------------------------------------------------------- log and windows
@query(f"WITH {CASES_SQL}, {_LOG_SQL} SELECT (SELECT count(*) FROM cases) AS cases, count(*) AS reviews, count(*) FILTER (WHERE accion <> 'rechazar') AS approved FROM log")
def service_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviewlog.health(cases(spark, sf_dir), _log(spark, sf_dir))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: counts by hour, the batch form of the windowed stream."""
    return reviews.action_counts(table(spark, sf_dir, "events"), "ts", "event_type").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query(f"WITH {IMAGES_SQL} SELECT split, min(lora_chrf) AS low, round(quantile_cont(lora_chrf, 0.1), 9) AS p10, round(quantile_cont(lora_chrf, 0.9), 9) AS p90, max(lora_chrf) AS high FROM images GROUP BY split")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of repeated values, by counts of values."""
    q = rollup.quantiles(images(spark, sf_dir), ["split"], "lora_chrf", [0.0, 0.1, 0.9, 1.0])
    at = lambda i: F.get("q", F.lit(i))
    return q.select("split", at(0).alias("low"), F.round(at(1), 9).alias("p10"), F.round(at(2), 9).alias("p90"), at(3).alias("high"))
