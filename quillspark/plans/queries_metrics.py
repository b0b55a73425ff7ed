"""Queries over text-pair metrics, roll-ups and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import metrics
from quillspark.operators import rollup, selection

from .base import CASES_SQL, IMAGES_SQL, METHODS, METRICS, images, table
from .queries_retrieval import _WORDS_SQL, F1_SQL, OVERLAP_SQL

FOUND: dict = {}


def query(sql: str | None = None):
    def keep(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return keep


# --------------------------------------------------------------------------- pairs: each turn against the next one
_PAIRS_SQL = "pairs AS (SELECT conv_id, turn, coalesce(text, '') AS p, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS r FROM conversations)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("p"), F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")).alias("r"))


def _f1_sql(tokens: str, common: str, empty: str) -> str:
    return f"WITH {_PAIRS_SQL}, s AS (SELECT conv_id, turn, {tokens.format(c='p')} AS a, {tokens.format(c='r')} AS b FROM pairs), o AS (SELECT *, CAST({common} AS DOUBLE) AS c FROM s) SELECT conv_id, turn, round({F1_SQL.format(e=empty)}, 6) AS f1 FROM o"


def _f1(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.token_f1("p", "r", variant), 6).alias("f1"))


@query(_f1_sql(_WORDS_SQL, OVERLAP_SQL, "0.0::DOUBLE"))
def token_f1_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _f1(spark, sf_dir, "multiset")


@query(_f1_sql(_WORDS_SQL, "len(list_intersect(a, b))", "0.0::DOUBLE"))
def token_f1_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _f1(spark, sf_dir, "set")


@query(_f1_sql(r"regexp_extract_all(strip_accents(lower({c})), '[\p{{L}}\p{{N}}_]+')", OVERLAP_SQL, "1.0::DOUBLE"))
def token_f1_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _f1(spark, sf_dir, "service")


@query(_f1_sql(_WORDS_SQL, OVERLAP_SQL, "1.0::DOUBLE"))
def token_f1_notebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _f1(spark, sf_dir, "notebook")


def _rouge_sql(tokens: str, empty: str) -> str:
    """The subsequence table row by row: with each word of a, a place of b holds the greatest of what the places up to it can reach."""
    return f"""WITH RECURSIVE {_PAIRS_SQL}, s AS MATERIALIZED (SELECT conv_id, turn, {tokens.format(c='p')} AS a, {tokens.format(c='r')} AS b FROM pairs),
l AS (SELECT conv_id, turn, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: 0) AS v FROM s WHERE len(a) > 0 AND len(b) > 0
  UNION ALL SELECT conv_id, turn, a, b, i + 1, list_concat([0], list_transform(range(1, len(b) + 1), lambda j: list_max(c[1:j]))) FROM
  (SELECT *, list_transform(range(1, len(b) + 1), lambda j: CASE WHEN b[j] = a[i + 1] THEN v[j] + 1 ELSE v[j + 1] END) AS c FROM l WHERE i < len(a))),
o AS (SELECT s.*, CAST(coalesce(v[len(s.b) + 1], 0) AS DOUBLE) AS c FROM s LEFT JOIN l ON l.conv_id = s.conv_id AND l.turn = s.turn AND l.i = len(s.a))
SELECT conv_id, turn, round({F1_SQL.format(e=empty)}, 6) AS rouge_l FROM o"""


def _rouge(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.rouge_l("p", "r", variant), 6).alias("rouge_l"))


@query(_rouge_sql(_WORDS_SQL, "0.0::DOUBLE"))
def rouge_l_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rouge(spark, sf_dir, "whitespace")


@query(_rouge_sql("regexp_extract_all(lower({c}), '[a-z0-9]+')", "0.0::DOUBLE"))
def rouge_l_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rouge(spark, sf_dir, "ascii")


@query(_rouge_sql(_WORDS_SQL, "1.0::DOUBLE"))
def rouge_l_notebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rouge(spark, sf_dir, "notebook")


_CHRF_STATS_SQL = rf"""{_PAIRS_SQL},
t AS (SELECT conv_id, turn, regexp_replace(p, '\s+', '', 'g') AS p, regexp_replace(r, '\s+', '', 'g') AS r FROM pairs), o AS (SELECT unnest(range(1, 7)) AS n),
pg AS (SELECT conv_id, turn, n, g, count(*) AS c FROM (SELECT conv_id, turn, n, substr(p, i, n) AS g FROM (SELECT conv_id, turn, n, p, unnest(range(1, length(p) - n + 2)) AS i FROM t, o WHERE length(p) >= n)) GROUP BY ALL),
rg AS (SELECT conv_id, turn, n, g, count(*) AS c FROM (SELECT conv_id, turn, n, substr(r, i, n) AS g FROM (SELECT conv_id, turn, n, r, unnest(range(1, length(r) - n + 2)) AS i FROM t, o WHERE length(r) >= n)) GROUP BY ALL),
m AS (SELECT conv_id, turn, n, CAST(sum(least(pg.c, rg.c)) AS DOUBLE) AS m FROM pg JOIN rg USING (conv_id, turn, n, g) GROUP BY ALL),
st AS (SELECT conv_id, turn, n, CAST(greatest(length(p) - n + 1, 0) AS DOUBLE) AS a, CAST(greatest(length(r) - n + 1, 0) AS DOUBLE) AS b, coalesce(m, 0) AS m FROM t CROSS JOIN o LEFT JOIN m USING (conv_id, turn, n))"""
_CHRF_SQL = "CASE WHEN count(*) FILTER (WHERE a > 0 AND b > 0) = 0 OR sum(m / a) FILTER (WHERE a > 0 AND b > 0) + sum(m / b) FILTER (WHERE a > 0 AND b > 0) = 0 THEN 0.0::DOUBLE ELSE 100 * 5 * (avg(m / a) FILTER (WHERE a > 0 AND b > 0)) * (avg(m / b) FILTER (WHERE a > 0 AND b > 0)) / (4 * (avg(m / a) FILTER (WHERE a > 0 AND b > 0)) + avg(m / b) FILTER (WHERE a > 0 AND b > 0)) END"


@query(f"WITH {_CHRF_STATS_SQL} SELECT conv_id, turn, round({_CHRF_SQL}, 4) AS chrf FROM st GROUP BY conv_id, turn")
def chrf_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", metrics.chrf_stats("p", "r").alias("s")).select("conv_id", "turn", F.round(metrics.chrf_score("s"), 4).alias("chrf"))


@query(f"WITH {_CHRF_STATS_SQL}, c AS (SELECT conv_id % 2 AS part, n, sum(a) AS a, sum(b) AS b, sum(m) AS m FROM st GROUP BY ALL) SELECT part, round({_CHRF_SQL}, 4) AS chrf FROM c GROUP BY part")
def chrf_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus score: statistics are summed, then scored."""
    stats = _pairs(spark, sf_dir).select((F.col("conv_id") % 2).alias("part"), metrics.chrf_stats("p", "r").alias("s"))
    return stats.groupBy("part").agg(metrics.sum_arrays("s", 18).alias("s")).select("part", F.round(metrics.chrf_score("s"), 4).alias("chrf"))


def _13a_sql(c: str) -> str:
    for k, (pattern, to) in enumerate(metrics.TOKENS_13A):
        of = f"(' ' || {c} || ' ')" if k == 7 else c
        c = f"regexp_replace({of}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"


_BLEU_SQL = f"""WITH {_PAIRS_SQL}, s AS MATERIALIZED (SELECT conv_id, turn, {_13a_sql('p')} AS a, {_13a_sql('r')} AS b FROM pairs), k AS (SELECT unnest(range(1, 5)) AS n),
pg AS (SELECT conv_id, turn, n, g, count(*) AS c FROM (SELECT conv_id, turn, n, a[i:i+n-1] AS g FROM (SELECT conv_id, turn, n, a, unnest(range(1, len(a) - n + 2)) AS i FROM s, k WHERE len(a) >= n)) GROUP BY ALL),
rg AS (SELECT conv_id, turn, n, g, count(*) AS c FROM (SELECT conv_id, turn, n, b[i:i+n-1] AS g FROM (SELECT conv_id, turn, n, b, unnest(range(1, len(b) - n + 2)) AS i FROM s, k WHERE len(b) >= n)) GROUP BY ALL),
m AS (SELECT conv_id % 2 AS part, n, sum(least(pg.c, rg.c)) AS m FROM pg JOIN rg USING (conv_id, turn, n, g) GROUP BY ALL),
t AS (SELECT conv_id % 2 AS part, n, sum(greatest(len(a) - n + 1, 0)) AS t FROM s, k GROUP BY ALL),
o AS (SELECT part, n, CAST(coalesce(m, 0) AS DOUBLE) AS m, CAST(t AS DOUBLE) AS t, sum(CASE WHEN coalesce(m, 0) = 0 AND t > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY part ORDER BY n) AS zeros FROM t LEFT JOIN m USING (part, n)),
e AS (SELECT part, sum(ln(CASE WHEN m > 0 THEN 100 * m / t ELSE 100 / (pow(2, zeros) * t) END)) / 4 AS p, min(t) AS least FROM o WHERE t > 0 GROUP BY part),
z AS (SELECT conv_id % 2 AS part, CAST(sum(len(a)) AS DOUBLE) AS a, CAST(sum(len(b)) AS DOUBLE) AS b, min(CASE WHEN len(a) >= 4 THEN 1 END) AS whole FROM s GROUP BY 1)
SELECT part, round(CASE WHEN whole IS NULL OR a = 0 THEN 0 ELSE CASE WHEN a >= b THEN 1 ELSE exp(1 - b / a) END * exp(p) END, 4) AS bleu FROM z JOIN e USING (part)"""


@query(_BLEU_SQL)
def bleu_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _pairs(spark, sf_dir).select((F.col("conv_id") % 2).alias("part"), metrics.bleu_stats("p", "r").alias("s"))
    return stats.groupBy("part").agg(metrics.sum_arrays("s", 10).alias("s")).select("part", F.round(metrics.bleu_score("s"), 4).alias("bleu"))


# --------------------------------------------------------------------------- roll-ups
def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {IMAGES_SQL} SELECT coalesce(split, 'all') AS split, count(*) AS n, {', '.join(f'round(avg(lora_{m}), 9) AS lora_{m}' for m in METRICS)} FROM images GROUP BY GROUPING SETS ((split), ())")
def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [f"lora_{m}" for m in METRICS]
    return rounded(rollup.means(images(spark, sf_dir), ["split"], cols, total="split"), cols, 9)


@query(f"WITH {IMAGES_SQL}, p AS (SELECT split, encounter_id, avg(lora_chrf) AS lora_chrf, avg(lora_token_f1) AS lora_token_f1 FROM images GROUP BY 1, 2) SELECT split, count(*) AS cases, round(avg(lora_chrf), 9) AS lora_chrf, round(avg(lora_token_f1), 9) AS lora_token_f1 FROM p GROUP BY split")
def case_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["lora_chrf", "lora_token_f1"]
    return rounded(rollup.case_average(images(spark, sf_dir), ["split"], "encounter_id", cols), cols, 9)


_NT = r"trim(regexp_replace(regexp_replace(lower(p), '[.,;:]', '', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS p, text AS reference FROM conversations),
f AS (SELECT conv_id, turn, p FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, {_NT} ORDER BY turn) AS r FROM c WHERE p <> '') WHERE r = 1)
SELECT x.conv_id, coalesce(g.t, '') AS text, x.reference FROM (SELECT conv_id, arg_min(reference, turn) AS reference FROM c GROUP BY conv_id) x LEFT JOIN (SELECT conv_id, string_agg(p, ' ' ORDER BY turn) AS t FROM f GROUP BY conv_id) g USING (conv_id)""")
def case_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct predictions of a case joined in order, with its first reference."""
    c = table(spark, sf_dir, "conversations").withColumn("reference", F.col("text"))
    return rollup.case_text(c, "conv_id", "turn", "text", "reference")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items are unique by their ordinal, so the methods' frames are projections of one scan."""
    base = images(spark, sf_dir)
    wide = base.withColumns({f"{m}_mean_score": rollup.row_mean([f"{m}_{x}" for x in METRICS]) for m in METHODS})
    wide = rollup.deltas(wide, {"delta_lora_vs_zero_shot": ("lora", "zero_shot"), "delta_rag_on_zero_shot": ("zero_shot_rag", "zero_shot"), "delta_rag_on_lora": ("lora_rag", "lora")})
    return rollup.image_windows(wide, "encounter_id", "lora_mean_score")


def _strata() -> dict:
    return {"reference_length": rollup.length_stratum(F.col("reference_words")), "image_count": rollup.image_count_stratum(F.col("images_in_encounter"))}


@query(f"WITH {IMAGES_SQL} SELECT a.encounter_id, a.image_id, round(a.lora_mean_score - b.zero_shot_mean_score, 9) AS gain FROM wide a JOIN wide b USING (encounter_id, image_id)")
def wide_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one join of per-method frames on case and image."""
    base = images(spark, sf_dir)
    frames = {m: base.select("encounter_id", "image_id", *[F.col(f"{m}_{x}").alias(x) for x in METRICS]) for m in ("lora", "zero_shot")}
    wide = rollup.wide_methods(frames, ["encounter_id", "image_id"], METRICS)
    return wide.select("encounter_id", "image_id", F.round(F.col("lora_mean_score") - F.col("zero_shot_mean_score"), 9).alias("gain"))


@query(f"WITH {IMAGES_SQL} SELECT encounter_id, image_id, images_in_encounter, round(image_spread, 10) AS image_spread FROM effects")
def image_spread_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_wide(spark, sf_dir).select("encounter_id", "image_id", "images_in_encounter", "image_spread"), ["image_spread"], 10)


@query(f"""WITH {IMAGES_SQL}, x AS (SELECT encounter_id, image_id, (lora_chrf + lora_rouge_l + lora_token_f1) / 3 AS l, lora_bertscore_f1 AS s FROM images), m AS (SELECT avg(l) AS ml, stddev_pop(l) AS sl, avg(s) AS ms, stddev_pop(s) AS ss FROM x)
SELECT encounter_id, image_id, round((s - ms) / CASE WHEN ss = 0 THEN 1 ELSE ss END - (l - ml) / CASE WHEN sl = 0 THEN 1 ELSE sl END, 5) AS gap_z FROM x, m""")
def zscore_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = images(spark, sf_dir).withColumn("lexical", rollup.row_mean(["lora_chrf", "lora_rouge_l", "lora_token_f1"]))
    return rounded(rollup.z_gap(x, "lora_bertscore_f1", "lexical").select("encounter_id", "image_id", "gap_z"), ["gap_z"], 5)


_STRATA_SQL = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS stratum, '{m}' AS method, count(*) AS n, {', '.join(f'round(avg({m}_{x}), 9) AS {x}' for x in [*METRICS, 'mean_score'])} FROM effects GROUP BY {d}" for d in ("reference_length", "image_count") for m in METHODS)


@query(f"WITH {IMAGES_SQL} {_STRATA_SQL}")
def strata_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollup.strata_means(_wide(spark, sf_dir), _strata(), METHODS, METRICS), [*METRICS, "mean_score"], 9)


_EFFECTS = {"lora_vs_zero_shot": "delta_lora_vs_zero_shot", "rag_on_zero_shot": "delta_rag_on_zero_shot", "rag_on_lora": "delta_rag_on_lora"}
_EFFECT_SQL = " UNION ALL ".join(f"SELECT '{k}' AS effect, '{d}' AS dimension, {s} AS stratum, count(*) AS n, round(avg({c}), 9) AS mean_delta, round(median({c}), 10) AS median_delta, round(avg(CASE WHEN {c} > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive_rate FROM effects GROUP BY ALL" for k, c in _EFFECTS.items() for d, s in (("overall", "'all'"), ("reference_length", "reference_length"), ("image_count", "image_count")))


@query(f"WITH {IMAGES_SQL} {_EFFECT_SQL}")
def effect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollup.effects(_wide(spark, sf_dir), _EFFECTS, _strata()), ["mean_delta"], 9).withColumns({"median_delta": F.round("median_delta", 10), "positive_rate": F.round("positive_rate", 6)})


@query("SELECT event_type, min(value) AS minimum, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS maximum FROM events GROUP BY event_type")
def quantile_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollup.five_numbers(table(spark, sf_dir, "events"), ["event_type"], "value"), ["q1", "median", "q3"])


@query("SELECT count(value) AS n, round(avg(value), 5) AS mean, round(median(value), 5) AS median, round(stddev_pop(value), 5) AS pstdev, min(value) AS minimum, max(value) AS maximum FROM events")
def score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollup.score_stats(table(spark, sf_dir, "events"), "value"), ["mean", "median", "pstdev"], 5)


@query("""WITH s AS (SELECT least(30, greatest(5, floor(sqrt(count(value))))) AS k, min(value) AS lo, max(value) AS hi FROM events)
SELECT CAST(least(k - 1, floor((value - lo) / (hi - lo) * k)) AS BIGINT) AS bin, count(*) AS count FROM events, s WHERE value IS NOT NULL GROUP BY 1""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.histogram(table(spark, sf_dir, "events"), "value")


@query("SELECT event_type, round(avg(value), 5) AS mean_s, round(sum(value), 3) AS total_s, round(quantile_cont(value, 0.5), 6) AS p50_s, round(quantile_cont(value, 0.95), 6) AS p95_s FROM events GROUP BY event_type")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollup.latency(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", F.round("mean_s", 5).alias("mean_s"), F.round("total_s", 3).alias("total_s"), F.round("p50_s", 6).alias("p50_s"), F.round("p95_s", 6).alias("p95_s"))


@query("""WITH d AS (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d)
SELECT 'quality' AS field, CAST(quality AS VARCHAR) AS label, count(*) AS count, round(count(*) / any_value(n), 6) AS rate FROM d, n WHERE quality IS NOT NULL GROUP BY quality
UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*), round(count(*) / any_value(n), 6) FROM d, n WHERE toxic IS NOT NULL GROUP BY toxic""")
def label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rounded(rollup.label_rates(d, ["quality", "toxic"]), ["rate"])


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'quality' || CASE WHEN toxic IS NULL THEN ',toxic' ELSE '' END ELSE 'toxic' END AS missing FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR toxic IS NULL")
def missing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rollup.missing_metrics(d, F.col("doc_id"), ["quality", "toxic"]).select(F.col("label").alias("doc_id"), F.array_join("missing", ",").alias("missing"))


@query("SELECT event_type AS method, count(*) AS n, round(avg(CASE WHEN user_id % 5 = 0 THEN 0.0::DOUBLE ELSE 1 END), 6) AS parse_success_rate, round(avg(CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS minimum_tokens_rate, round(avg(event_id % 40), 6) AS mean_explanation_tokens, round(avg(value), 5) AS mean_answer_stability_f1 FROM events GROUP BY event_type")
def explanation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), i.alias("image_id"), F.when(F.col("user_id") % 5 == 0, "bad").otherwise("").alias("parse_error"), F.when(i % 2 == 0, "True").otherwise("False").alias("meets_minimum_tokens"), (i % 40).alias("explanation_token_count"), F.col("value").alias("answer_f1"))
    return rounded(rounded(rollup.explanation_summary(e), ["parse_success_rate", "minimum_tokens_rate", "mean_explanation_tokens"]), ["mean_answer_stability_f1"], 5)


@query(f"WITH {IMAGES_SQL} SELECT encounter_id, image_id FROM effects WHERE split = 'valid' ORDER BY lora_mean_score DESC, encounter_id LIMIT 1")
def split_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.winner(_wide(spark, sf_dir).withColumn("lora_mean_score", F.col("lora_mean_score")), "valid", "lora_mean_score", "encounter_id").select("encounter_id", "image_id")


# --------------------------------------------------------------------------- selection
_SPECS = [("lora_gain", "g1", True), ("lora_harm", "g1", False), ("rag_gain_zero_shot", "g2", True), ("rag_harm_zero_shot", "g2", False), ("rag_gain_lora", "g3", True), ("rag_harm_lora", "g3", False), ("long_reference", "w", True), ("short_reference", "w", False)]


def _select_sql(n: int) -> str:
    parts = [f"SELECT encounter_id, image_id, {i} AS o, row_number() OVER (ORDER BY {s} {'DESC' if big else 'ASC'}, encounter_id, image_id) AS rank, '{b}' AS bucket, '{s}' AS score, {s} AS v FROM x QUALIFY rank <= {n}" for i, (b, s, big) in enumerate(_SPECS)]
    multi = f"""SELECT encounter_id, image_id, {len(_SPECS)} AS o, row_number() OVER (PARTITION BY encounter_id ORDER BY image_id) AS rank, 'multi_image_inconsistency' AS bucket, 'sp' AS score, sp AS v
      FROM x JOIN (SELECT DISTINCT encounter_id, sp FROM x WHERE images_in_encounter > 1 ORDER BY sp DESC, encounter_id LIMIT {n}) USING (encounter_id, sp)"""
    return f"""WITH {IMAGES_SQL}, x AS (SELECT encounter_id, image_id, images_in_encounter, round(delta_lora_vs_zero_shot, 9) AS g1, round(delta_rag_on_zero_shot, 9) AS g2, round(delta_rag_on_lora, 9) AS g3, CAST(reference_words AS DOUBLE) AS w, round(image_spread, 9) AS sp FROM effects),
p AS ({' UNION ALL '.join(parts)} UNION ALL {multi})
SELECT encounter_id, image_id, string_agg(bucket, ';' ORDER BY o, rank) AS selection_buckets, string_agg(bucket || ': rank=' || rank || ', ' || score, ' | ' ORDER BY o, rank) AS selection_reasons FROM p GROUP BY 1, 2"""


@query(_select_sql(10))
def contrastive_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best and worst rows by each difference and length, and the cases whose images differ most."""
    w = _wide(spark, sf_dir)
    x = w.select("encounter_id", "image_id", "images_in_encounter", *[F.round(c, 9).alias(k) for k, c in (("g1", "delta_lora_vs_zero_shot"), ("g2", "delta_rag_on_zero_shot"), ("g3", "delta_rag_on_lora"))], F.col("reference_words").cast("double").alias("w"), F.round("image_spread", 9).alias("sp"))
    out = selection.contrastive(x, _SPECS, ["encounter_id", "image_id"], 10, "encounter_id", "sp", "images_in_encounter")
    # the engines print the fourth decimal of halves differently, so the reasons go without their scores here
    return out.withColumn("selection_reasons", F.regexp_replace("selection_reasons", r"=-?\d+\.\d+", ""))


@query(f"WITH {IMAGES_SQL}, f AS (SELECT encounter_id, image_id, abs(lora_token_f1 - avg(lora_token_f1) OVER (PARTITION BY encounter_id)) AS d FROM images) SELECT encounter_id, image_id FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY round(d, 9), image_id) AS r FROM f) WHERE r = 1")
def representative_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _representative(spark, sf_dir).select("encounter_id", "image_id")


def _representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images(spark, sf_dir).select("encounter_id", "image_id", "lora_token_f1")
    mean = F.avg("lora_token_f1").over(Window.partitionBy("encounter_id"))
    near = rows.withColumn("far", F.round(F.abs(F.col("lora_token_f1") - mean), 9))
    return selection.first_rows(near, ["encounter_id"], ["far", "image_id"])


@query("SELECT 'low' AS bucket, * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5) UNION ALL SELECT 'high', * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 5)")
def low_high_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.low_and_high(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 5)


@query("""WITH c AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS up, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS down, count(*) OVER () AS n FROM orders),
m AS (SELECT o_totalprice AS m FROM c WHERE up = n // 2 + 1),
b AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey IN (3, 1, 2) THEN 0 WHEN up <= 7 THEN 1 WHEN down <= 7 THEN 2 ELSE 3 END AS b, up, down, abs(o_totalprice - m) AS d FROM c, m),
r AS (SELECT *, row_number() OVER (ORDER BY b, CASE b WHEN 0 THEN list_position([3, 1, 2], o_orderkey) WHEN 1 THEN up WHEN 2 THEN down ELSE d END, o_totalprice, o_orderkey) AS r FROM b)
SELECT o_orderkey, CASE b WHEN 0 THEN 'survey_named_case' WHEN 1 THEN 'low_metric_case' WHEN 2 THEN 'high_metric_case' ELSE 'middle_metric_case' END AS case_bucket FROM r WHERE r <= 20""")
def median_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty cases: named, low, high and middle ones."""
    return selection.review_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", [3, 1, 2]).select("o_orderkey", "case_bucket")


@query(f"WITH {CASES_SQL} SELECT conv_id, text FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r = 1")
def first_row_per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.first_rows(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "text")


@query("SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 20")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling operator: 20 documents by a seeded hash."""
    return selection.seeded_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 20)


@query("""WITH s AS (SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'dataset_enriched' ELSE 'dataset_longest_answer' END AS dataset_variant, CASE event_id % 5 WHEN 0 THEN 'retrieval_tfidf_train_only' WHEN 1 THEN 'retrieval_sbert' WHEN 2 THEN 'vlm_lora' WHEN 3 THEN 'vlm_zero_shot' ELSE 'retrieval_multimodal' END AS method, CASE event_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'all' ELSE 'valid' END AS split FROM events),
h AS (SELECT DISTINCT dataset_variant FROM s WHERE split = 'test' AND method = 'retrieval_tfidf_train_only')
SELECT event_id, dataset_variant, method, split FROM s WHERE (split = 'test' AND NOT (dataset_variant = 'dataset_enriched' AND method = 'vlm_lora') AND NOT (dataset_variant IN (SELECT * FROM h) AND starts_with(method, 'retrieval_') AND method <> 'retrieval_tfidf_train_only'))
OR (split = 'all' AND dataset_variant = 'dataset_longest_answer' AND dataset_variant NOT IN (SELECT * FROM h) AND method IN ('retrieval_sbert', 'retrieval_multimodal'))""")
def main_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (i % n + 1).cast("int"))
    s = table(spark, sf_dir, "events").select("event_id", pick(2, "dataset_enriched", "dataset_longest_answer").alias("dataset_variant"), pick(5, "retrieval_tfidf_train_only", "retrieval_sbert", "vlm_lora", "vlm_zero_shot", "retrieval_multimodal").alias("method"), pick(3, "test", "all", "valid").alias("split"))
    return selection.main_rows(s).select("event_id", "dataset_variant", "method", "split")
