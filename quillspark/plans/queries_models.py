"""Queries over images, token vectors, table functions and weights of fused scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import metrics, tables
from quillspark.operators import generation, retrieval, rollup
from quillspark.sources import readers, writers

from .base import CASES_SQL, IMAGES_SQL, METHODS, SPLIT_SQL, answered, cases, images, scratch, split_by, table
from .queries_retrieval import _DOT, _PAIRS_SQL, _pairs

FOUND: dict = {}


def query(sql: str | None = None):
    def keep(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return keep


# --------------------------------------------------------------------------- images
def _image_folder(spark: SparkSession, sf_dir: str) -> str:
    """Image files made from the vectors, three in four, in two folders and folders below them; the second has some of the first's
    names with other bytes."""
    folder, k = scratch(spark, "images"), F.col("vec_id")
    e = table(spark, sf_dir, "embeddings")
    name = F.concat(F.lit("img"), k.cast("string"), F.when(k % 3 == 0, ".png").otherwise(".JPG"))
    told = F.concat_ws(":", "label", "vec_id").cast("binary")
    first = e.filter(k % 4 != 0).select(F.concat(F.lit("a/"), (k % 5).cast("string"), F.lit("/"), name).alias("name"), told.alias("content"))
    second = e.filter(k % 4 == 1).select(F.concat(F.lit("b/"), name).alias("name"), F.lit(b"other").alias("content"))
    writers.write_files(first.unionByName(second), folder, "name", "content")
    return folder


def _byte_encoder():
    """Stands for a model: length, first and last byte of an image."""
    return lambda batch: [[float(len(x)), float(x[0]), float(x[-1])] for x in batch]


@query("""SELECT vec_id, vec_id % 4 <> 0 AS has_image, CASE WHEN vec_id % 4 <> 0 THEN 'img' || vec_id || CASE WHEN vec_id % 3 = 0 THEN '.png' ELSE '.JPG' END END AS file,
CASE WHEN vec_id % 4 <> 0 THEN CAST(length(t) AS DOUBLE) END AS v0, CASE WHEN vec_id % 4 <> 0 THEN CAST(ascii(t) AS DOUBLE) END AS v1, CASE WHEN vec_id % 4 <> 0 THEN CAST(ascii(right(t, 1)) AS DOUBLE) END AS v2
FROM (SELECT vec_id, label || ':' || vec_id AS t FROM embeddings)""")
def image_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images found by name below two folders, scanned and encoded in batches; rows without an image are flagged."""
    folder, k = _image_folder(spark, sf_dir), F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("img"), k.cast("string"), F.when(k % 3 == 0, ".png").otherwise(".JPG")).alias("image_id"))
    out = generation.image_vectors(rows, [f"{folder}/a", f"{folder}/b"], _byte_encoder)
    at = lambda i: F.get("vector", F.lit(i)).cast("double").alias(f"v{i}")
    return out.select("vec_id", "has_image", F.regexp_extract("image_path", r"([^/]+)$", 1).alias("file"), at(0), at(1), at(2))


@query("""SELECT 'img' || vec_id || CASE WHEN vec_id % 3 = 0 THEN '.png' ELSE '.JPG' END AS name, CASE WHEN vec_id % 4 = 1 THEN 'b' ELSE CAST(vec_id % 5 AS VARCHAR) END AS parent FROM embeddings WHERE vec_id % 4 <> 0""")
def image_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images below two folders; for equal names the last folder's."""
    folder = _image_folder(spark, sf_dir)
    found = readers.image_index(spark, [f"{folder}/a", f"{folder}/b"], last_wins=True)
    return found.select("name", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("parent"))


# --------------------------------------------------------------------------- token vectors
_TOKENS = r"list_filter(string_split(trim(regexp_replace(lower(coalesce({c}, '')), '\s+', ' ', 'g')), ' '), lambda x: x <> '')"


@query("""WITH p AS (SELECT conv_id, turn, text AS p, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
t AS (SELECT conv_id, turn, """ + _TOKENS.format(c="p") + " AS a, " + _TOKENS.format(c="r") + """ AS b FROM p WHERE r IS NOT NULL),
v AS (SELECT conv_id, turn, side, i, [CAST(length(x) AS DOUBLE), ascii(x) / 100.0::DOUBLE, ascii(right(x, 1)) / 100.0::DOUBLE] AS v, CAST(length(x) AS DOUBLE) AS w FROM (SELECT conv_id, turn, 0 AS side, unnest(a) AS x, unnest(range(len(a))) AS i FROM t UNION ALL SELECT conv_id, turn, 1, unnest(b), unnest(range(len(b))) FROM t)),
c AS (SELECT x.conv_id, x.turn, x.i, y.i AS j, x.w AS wa, y.w AS wb, list_cosine_similarity(x.v, y.v) AS c FROM v x JOIN v y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.side = 0 AND y.side = 1),
a AS (SELECT conv_id, turn, sum(m * wa) / sum(wa) AS p FROM (SELECT conv_id, turn, i, max(c) AS m, any_value(wa) AS wa FROM c GROUP BY conv_id, turn, i) GROUP BY conv_id, turn),
b AS (SELECT conv_id, turn, sum(m * wb) / sum(wb) AS r FROM (SELECT conv_id, turn, j, max(c) AS m, any_value(wb) AS wb FROM c GROUP BY conv_id, turn, j) GROUP BY conv_id, turn)
SELECT t.conv_id, t.turn, round(coalesce(p, 0), 6) AS precision, round(coalesce(r, 0), 6) AS recall, round(coalesce(2 * p * r / (p + r), 0), 6) AS f1 FROM t LEFT JOIN a USING (conv_id, turn) LEFT JOIN b USING (conv_id, turn)""")
def token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy matching of token vectors of a turn and the next one; lengths stand for weights."""
    from pyspark.sql import Window

    from quillspark.functions.text import normalize, words

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("p"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("r")).filter("r is not null")
    t = c.select("conv_id", "turn", words(normalize("p")).alias("a"), words(normalize("r")).alias("b"))
    vectors = lambda a: F.transform(a, lambda x: F.array(F.length(x).cast("double"), F.ascii(x) / 100, F.ascii(F.right(x, F.lit(1))) / 100))
    weights = lambda a: F.transform(a, lambda x: F.length(x).cast("double"))
    out = t.select("conv_id", "turn", metrics.token_match(vectors("a"), vectors("b"), weights("a"), weights("b")).alias("m"))
    return out.select("conv_id", "turn", *[F.round(F.col("m")[k], 6).alias(k) for k in ("precision", "recall", "f1")])


# --------------------------------------------------------------------------- table functions
@query(f"WITH {CASES_SQL} SELECT conv_id, split, CASE WHEN len(coalesce(responses, [])) > 0 THEN unnest(range(len(responses))) END AS place, CASE WHEN len(coalesce(responses, [])) > 0 THEN unnest(responses) END AS response FROM cases WHERE len(coalesce(responses, [])) > 0 UNION ALL SELECT conv_id, split, NULL, NULL FROM cases WHERE len(coalesce(responses, [])) = 0")
def sql_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an array column by SQL text over any table."""
    tables.register(spark)
    cases(spark, sf_dir).select("conv_id", "split", "responses").createOrReplaceTempView("quill_cases")
    return spark.sql("SELECT conv_id, split, place, response FROM quill_expand(TABLE(quill_cases), 'responses', 'response')")


@query(f"""SELECT q, doc, score, rank FROM (SELECT q.vec_id AS q, d.vec_id AS doc, round({_DOT}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT}, 6) DESC, d.vec_id) AS rank
FROM embeddings q, embeddings d WHERE {SPLIT_SQL.format(k='q.vec_id')} = 'test' AND {SPLIT_SQL.format(k='d.vec_id')} = 'train') WHERE rank <= 3""")
def sql_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense search by SQL text: blocks of the index, each with all queries, and the best of the blocks."""
    tables.register(spark)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(None).cast("string").alias("text"), F.col("embedding").alias("vector"), split_by("vec_id").alias("split"))
    e.createOrReplaceTempView("quill_vectors")
    found = spark.sql("""
        WITH found AS (
          SELECT * FROM quill_search(TABLE(
            SELECT pmod(xxhash64(id), 4) AS block, 'index' AS side, id, text, vector FROM quill_vectors WHERE split = 'train'
            UNION ALL SELECT block, 'query', id, text, vector FROM quill_vectors LATERAL VIEW explode(sequence(0L, 3L)) b AS block WHERE split = 'test'
          ) PARTITION BY (block) ORDER BY (side), 8, 'dense'))
        SELECT query AS q, doc, round(score, 6) AS score FROM found""")
    return retrieval.top_k(found, "q", "doc", 3).select("q", "doc", "score", F.col("rank").cast("long").alias("rank"))


# --------------------------------------------------------------------------- weights
_ALPHAS = [0.0, 0.2, 0.45, 0.7, 1.0]


@query(f"""WITH {_PAIRS_SQL}, a AS (SELECT unnest([0.0::DOUBLE, 0.2::DOUBLE, 0.45::DOUBLE, 0.7::DOUBLE, 1.0::DOUBLE]) AS alpha), s AS (SELECT q, doc, t, CASE WHEN has_image THEN v ELSE 0 END AS v FROM pairs)
SELECT q, alpha, doc, round(score, 6) AS score FROM (SELECT q, alpha, doc, alpha * t + (1 - alpha) * v AS score, row_number() OVER (PARTITION BY q, alpha ORDER BY alpha * t + (1 - alpha) * v DESC, doc) AS r FROM s, a) WHERE r = 1""")
def alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best document of each query at five weights of text and image, from one pass over the scores."""
    scored = _pairs(spark, sf_dir).withColumn("v", F.when(F.col("has_image"), F.col("v")).otherwise(0.0))
    return retrieval.alpha_sweep(scored, "q", "doc", "t", "v", _ALPHAS).withColumn("score", F.round("score", 6))


@query("""SELECT count(*) AS found, count(DISTINCT q) AS queries FROM (SELECT q.vec_id AS q, row_number() OVER (PARTITION BY q.vec_id ORDER BY d.vec_id) AS r FROM embeddings q, embeddings d WHERE q.vec_id % 10 = 9 AND d.vec_id % 10 < 8) WHERE r <= 4""")
def backend_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search chosen by name."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 10 = 9").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    d = e.filter("vec_id % 10 < 8").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    return retrieval.backend("dense")(q, d, 4).agg(F.count(F.lit(1)).alias("found"), F.count_distinct("query").alias("queries"))


# --------------------------------------------------------------------------- tables behind charts
@query(f"""WITH {IMAGES_SQL} SELECT split, method, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(corr(x, y), 6) AS correlation FROM (
{" UNION ALL ".join(f"SELECT split, '{m}' AS method, {m}_chrf AS x, {m}_rouge_l AS y FROM images" for m in METHODS)}) GROUP BY ALL""")
def trade_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of a scatter of two metrics: a row a split and method."""
    return rollup.trade_off(images(spark, sf_dir), "split", METHODS, "chrf", "rouge_l", 6)


@query(f"""WITH {CASES_SQL}, l AS (SELECT split, len(regexp_extract_all(coalesce(question, ''), '\\S+')) AS a, len(regexp_extract_all(coalesce(answer, ''), '\\S+')) AS b FROM answered)
SELECT split, count(*) AS n, round(avg(a), 6) AS mean_pred, round(avg(b), 6) AS mean_ref, round(avg(CASE WHEN b > 0 THEN a / CAST(b AS DOUBLE) END), 6) AS mean_ratio, count(*) FILTER (WHERE a < b) AS shorter, count(*) FILTER (WHERE a > b) AS longer FROM l GROUP BY split""")
def length_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long predicted texts are against their references; questions stand for predictions."""
    return rollup.length_alignment(answered(spark, sf_dir), "split", "question", "answer", 6)


@query("""WITH s AS (SELECT user_id % 4 AS run, event_id AS step, value AS loss FROM events WHERE value IS NOT NULL),
b AS (SELECT run, step // 500 AS bin, min(step) AS first_step, max(step) AS last_step, count(*) AS n, avg(loss) AS loss FROM s GROUP BY ALL)
SELECT run, bin, first_step, last_step, n, round(loss, 6) AS loss, round(min(loss) OVER (PARTITION BY run ORDER BY bin), 6) AS best FROM b""")
def training_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training log by bins of steps: mean loss, and the best so far."""
    s = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss")).filter("loss is not null")
    return rollup.training_curve(s, "run", "step", "loss", 500, 6)
