"""Roll-ups of per-case metrics: summaries, case averages, paired effects, strata, quantiles, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import clean_text, length_bucket, let, normalize_text, word_count
from quillspark.storage import stored


def means(rows: DataFrame, by: list[str], metrics: list[str], total: str | None = None) -> DataFrame:
    """n and mean of each metric by group; with `total`, a row "all" over that column besides."""
    aggregates = [F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics]]
    if total is None:
        return rows.groupBy(*by).agg(*aggregates)
    rest = [c for c in by if c != total]
    marked = rows.withColumn(total, F.coalesce(total, F.lit("")))
    sets = [F.col(c) for c in rest]
    return marked.groupingSets([[*sets, F.col(total)], sets], *sets, F.col(total)).agg(*aggregates).withColumn(total, F.coalesce(total, F.lit("all"))).select(*by, "n", *metrics)


def summary(rows: DataFrame, by: list[str], metrics: list[str], text: str | None = None) -> DataFrame:
    """As means, 0 where there are no values, with the number of empty texts."""
    out = [F.count(F.lit(1)).alias("n"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"{m}_mean") for m in metrics]]
    if text:
        out.append(F.count_if(clean_text(text) == "").alias("empty"))
    return rows.groupBy(*by).agg(*out)


def case_average(rows: DataFrame, by: list[str], case: str, metrics: list[str]) -> DataFrame:
    """Mean by case, then mean of means."""
    per = rows.groupBy(*by, case).agg(*[F.avg(m).alias(m) for m in metrics])
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), *[F.avg(m).alias(m) for m in metrics])


def case_text(rows: DataFrame, case: str, order: str, prediction: str, reference: str) -> DataFrame:
    """A row a case: distinct predictions (by normalised text) joined in order, and the first reference."""
    clean = rows.select(case, order, clean_text(prediction).alias("p"), reference)
    first = clean.groupBy(case).agg(F.min(F.struct(order, reference)).alias("f")).select(case, F.col(f"f.{reference}").alias(reference))
    kept = clean.filter("p <> ''").withColumn("key", normalize_text("p")).withColumn("r", F.row_number().over(Window.partitionBy(case, "key").orderBy(order))).filter("r = 1")
    joined = kept.groupBy(case).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "p"))), lambda x: x["p"]), " ").alias(prediction))
    return first.join(joined, case, "left").select(case, F.coalesce(prediction, F.lit("")).alias(prediction), reference)


def row_mean(columns: list[str]) -> Column:
    """Mean of the values that are there."""
    there = F.array_compact(F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]))
    return let(there, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / F.size(v)))


def wide_methods(frames: dict[str, DataFrame], keys: list[str], metrics: list[str]) -> DataFrame:
    """Per-method metric rows joined one to one on the keys, with a mean score for each method; a key that a method has twice raises
    when the row is computed."""

    def once(name: str, df: DataFrame) -> DataFrame:
        # the groups are dealt as the join needs them, so counting them costs no shuffle of its own
        rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(m).alias(m) for m in metrics])
        one = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{name} isn't unique by {keys}")).cast("double"))
        mean = F.when(F.col("_n") > 1, one).otherwise(row_mean(metrics))
        return rows.select(*keys, *[F.col(m).alias(f"{name}_{m}") for m in metrics], mean.alias(f"{name}_mean_score"))

    return reduce(lambda a, b: a.join(b, keys), [once(name, df) for name, df in frames.items()])


def deltas(wide: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    return wide.withColumns({k: F.col(f"{a}_mean_score") - F.col(f"{b}_mean_score") for k, (a, b) in pairs.items()})


def image_windows(wide: DataFrame, case: str, score: str) -> DataFrame:
    """Rows of each case and the spread of a score over them."""
    w = Window.partitionBy(case)
    return wide.withColumn("images_in_encounter", F.count(F.lit(1)).over(w)).withColumn("image_spread", F.max(score).over(w) - F.min(score).over(w))


def z_gap(rows: DataFrame, a: str, b: str, out: str = "gap_z") -> DataFrame:
    """z(a) - z(b) with population deviations, 1 where they are 0. Moments come from one aggregate row, not from a window over all."""
    moments = rows.agg(F.avg(a).alias("_ma"), F.stddev_pop(a).alias("_sa"), F.avg(b).alias("_mb"), F.stddev_pop(b).alias("_sb"))
    one = lambda s: F.when(F.coalesce(F.col(s), F.lit(0.0)) == 0, 1.0).otherwise(F.col(s))
    return rows.crossJoin(F.broadcast(moments)).withColumn(out, (F.col(a) - F.col("_ma")) / one("_sa") - (F.col(b) - F.col("_mb")) / one("_sb")).drop("_ma", "_sa", "_mb", "_sb")  # one row


def stratified(rows: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """dimension, stratum and the row, once for each dimension."""
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("stratum")) for k, c in dimensions.items()])
    return rows.withColumn("_d", F.explode(pairs)).select("_d.*", *rows.columns)


def by_dimension(rows: DataFrame, dimensions: dict[str, Column], aggregates: list[Column], overall: bool = False) -> DataFrame:
    """dimension, stratum and aggregates for every stratum of every dimension (and over all rows), by grouping sets: the rows are
    computed and read once."""
    named = {f"_{k}": c.cast("string") for k, c in dimensions.items()}
    sets = [[F.col(k)] for k in named] + ([[]] if overall else [])
    grouped = rows.withColumns(named).groupingSets(sets, *[F.col(k) for k in named]).agg(*aggregates, *[F.grouping(k).alias(f"{k}_off") for k in named])
    dimension = F.coalesce(*[F.when(F.col(f"_{k}_off") == 0, F.lit(k)) for k in dimensions], F.lit("overall"))
    stratum = F.when(F.lit(False), F.lit(""))
    for k in dimensions:
        stratum = stratum.when(F.col(f"_{k}_off") == 0, F.col(f"_{k}"))
    return grouped.withColumns({"dimension": dimension, "stratum": stratum.otherwise(F.lit("all"))}).drop(*named, *[f"{k}_off" for k in named])


def strata_means(wide: DataFrame, dimensions: dict[str, Column], methods: list[str], metrics: list[str]) -> DataFrame:
    """dimension, stratum, method, n, mean of each metric and of the mean score."""
    names = [*metrics, "mean_score"]
    # a column for each method and metric, turned into rows after the aggregate
    per = by_dimension(wide, dimensions, [F.count(F.lit(1)).alias("n"), *[F.avg(f"{m}_{x}").alias(f"{m}_{x}") for m in methods for x in names]])
    rows = F.array(*[F.struct(F.lit(m).alias("method"), *[F.col(f"{m}_{x}").alias(x) for x in names]) for m in methods])
    return per.select("dimension", "stratum", "n", F.explode(rows).alias("_m")).select("dimension", "stratum", "_m.method", "n", *[f"_m.{x}" for x in names])


def effects(wide: DataFrame, columns: dict[str, str], dimensions: dict[str, Column]) -> DataFrame:
    """effect, dimension, stratum, n, mean, median and positive rate of each paired difference; overall rows besides."""
    base = stored(wide.select(*[c.cast("string").alias(f"s_{k}") for k, c in dimensions.items()], *[F.col(c).cast("double").alias(f"e_{k}") for k, c in columns.items()]), "effects")
    told = [x for k in columns for x in (F.avg(f"e_{k}").alias(f"{k}_a"), F.avg((F.col(f"e_{k}") > 0).cast("double")).alias(f"{k}_r"))]
    per = by_dimension(base, {k: F.col(f"s_{k}") for k in dimensions}, [F.count(F.lit(1)).alias("n"), *told], overall=True)
    rows = F.array(*[F.struct(F.lit(k).alias("effect"), F.col(f"{k}_a").alias("mean_delta"), F.col(f"{k}_r").alias("positive_rate")) for k in columns])
    sums = per.select("dimension", "stratum", "n", F.explode(rows).alias("_e")).select("_e.effect", "dimension", "stratum", "n", "_e.mean_delta", "_e.positive_rate")
    parts = F.array(*[F.struct(F.lit(k).alias("effect"), F.col(f"e_{k}").alias("d")) for k in columns])
    long = stratified(base, {"overall": F.lit("all")} | {k: F.col(f"s_{k}") for k in dimensions}).select("dimension", "stratum", F.explode(parts).alias("_e")).select("_e.effect", "dimension", "stratum", "_e.d")
    by = ["effect", "dimension", "stratum"]
    middle = quantiles(long, by, "d", [0.5]).select(*[F.col(c).alias(f"_{c}") for c in by], F.get("q", F.lit(0)).alias("median_delta"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return sums.join(middle, same, "left").select(*by, "n", "mean_delta", "median_delta", "positive_rate")


def image_count_stratum(n: Column) -> Column:
    return F.when(n > 1, "multiple_images").otherwise("single_image")


def length_stratum(n: Column) -> Column:
    return length_bucket(n)


#: How closely ranks are told at first (as a share of a group's rows), and groups whose bounds may be broadcast.
RANK_ACCURACY, BROADCAST_GROUPS = 10_000, 50_000


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], how: str = "linear") -> DataFrame:
    """by, q: exact quantiles of a group's values (nulls and not-a-numbers left out; a group without values has no row), interpolated
    ("linear") or the value of the upper rank ("higher").

    No task holds a group's values. Sketches give bounds on either side of each rank asked for; then values between two bounds are
    counted one by one, and what lies outside only as so many values with a least and a greatest. The ranks asked for are
    between the bounds, or next to them.
    """
    number = F.col(value).cast("double")
    there = rows.filter(number.isNotNull() & ~F.isnan(number)).select(*by, number.alias("_v"))
    near = 2 / RANK_ACCURACY
    ends = [x for s in shares for x in (max(0.0, s - near), min(1.0, s + near))]
    bounds = there.groupBy(*by).agg(F.percentile_approx("_v", ends, RANK_ACCURACY).alias("_ends"))
    bounds = stored(bounds.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_ends"), "bounds")
    if by:
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
        placed = there.join(F.broadcast(bounds) if bounds.count() <= BROADCAST_GROUPS else bounds, same)
    else:
        placed = there.crossJoin(F.broadcast(bounds))  # one row
    end = lambda i: F.get("_ends", F.lit(i))
    inside = reduce(lambda a, b: a | b, [F.col("_v").between(end(2 * i), end(2 * i + 1)) for i in range(len(shares))])
    below = sum((F.when(end(i) < F.col("_v"), 1).otherwise(0) for i in range(len(ends))), F.lit(0))
    cells = placed.groupBy(*by, F.when(~inside, below).alias("_gap"), F.when(inside, F.col("_v")).alias("_at")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    order = Window.partitionBy(*by).orderBy("_lo")
    ranked = cells.withColumn("_last", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by))).withColumn("_first", F.col("_last") - F.col("_c") + 1)
    place = (lambda s: F.lit(s) * (F.col("_n") - 1)) if how == "linear" else (lambda s: F.floor(F.lit(s) * F.col("_n")).cast("double"))
    lost = F.raise_error(F.lit("a sketch of ranks was further off than it says")).cast("double")
    at = lambda rank: F.when(rank == F.col("_first"), F.col("_lo")).when((F.col("_first") < rank) & (rank <= F.col("_last")), F.when((rank == F.col("_last")) | (F.col("_lo") == F.col("_hi")), F.col("_hi")).otherwise(lost))
    picked = []
    for i, s in enumerate(shares):
        picked += [F.max(at(F.floor(place(s)))).alias(f"_l{i}"), F.max(at(F.ceil(place(s)))).alias(f"_h{i}"), F.max(place(s) - F.floor(place(s))).alias(f"_f{i}")]
    q = F.array(*[F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}") for i in range(len(shares))])
    return ranked.groupBy(*by).agg(*picked).select(*by, q.alias("q"))


def five_numbers(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """min, q1, median, q3, max with linear interpolation."""
    return quantiles(rows, by, value, [0.0, 0.25, 0.5, 0.75, 1.0]).select(*by, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("minimum", "q1", "median", "q3", "maximum"))])


def score_stats(rows: DataFrame, value: str) -> DataFrame:
    """One row: n, mean, median, pstdev, minimum, maximum."""
    middle = quantiles(rows, [], value, [0.5]).select(F.get("q", F.lit(0)).alias("median"))  # one row
    sums = rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("pstdev"), F.min(value).alias("minimum"), F.max(value).alias("maximum"))
    return sums.crossJoin(F.broadcast(middle)).select("n", "mean", "median", "pstdev", "minimum", "maximum")


def histogram(rows: DataFrame, value: str) -> DataFrame:
    """bin and count over min(30, max(5, floor(sqrt n))) equal bins; the last bin is closed."""
    stats = rows.agg(F.count(value).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi")).withColumn("_bins", F.least(F.lit(30), F.greatest(F.lit(5), F.floor(F.sqrt("_n")))))
    placed = rows.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(stats))  # one row
    at = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.col("_bins") - 1, F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_bins"))))
    return placed.select(at.cast("long").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))


def label_rates(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, label, count, rate; blank labels make no row, but count in the denominator."""
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("label")) for f in fields])).alias("x")).select("x.*")
    return long.groupBy("field", "label").agg(F.count(F.lit(1)).alias("count")).filter("label <> ''").crossJoin(F.broadcast(total)).select("field", "label", "count", (F.col("count") / F.col("_n")).alias("rate"))  # one row


def missing_metrics(rows: DataFrame, label: Column, required: list[str]) -> DataFrame:
    """label and the names of the metrics that a row lacks."""
    lacks = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in required]))
    return rows.select(label.alias("label"), lacks.alias("missing")).filter(F.size("missing") > 0)


def explanation_summary(rows: DataFrame) -> DataFrame:
    """Per method: n, parse and minimum-length rates, mean tokens and stability."""
    ok = (F.coalesce(F.col("parse_error").cast("string"), F.lit("")) == "").cast("double")
    enough = F.lower(F.col("meets_minimum_tokens").cast("string")).isin("true", "1").cast("double")
    return rows.groupBy("method").agg(F.count("image_id").alias("n"), F.avg(ok).alias("parse_success_rate"), F.avg(F.coalesce(enough, F.lit(0.0))).alias("minimum_tokens_rate"), F.avg("explanation_token_count").alias("mean_explanation_tokens"), F.avg("answer_f1").alias("mean_answer_stability_f1")).orderBy("method")


def winner(rows: DataFrame, split: str, metric: str, tie: str) -> DataFrame:
    """The row of the greatest metric in the split."""
    return rows.filter(F.col("split") == split).orderBy(F.desc(metric), tie).limit(1)


def latency(rows: DataFrame, by: list[str], seconds: str) -> DataFrame:
    q = quantiles(rows, by, seconds, [0.5, 0.95])
    return rows.groupBy(*by).agg(F.avg(seconds).alias("mean_s"), F.sum(seconds).alias("total_s")).join(q, by, "left").select(*by, "mean_s", "total_s", F.get("q", F.lit(0)).alias("p50_s"), F.get("q", F.lit(1)).alias("p95_s"))


# --------------------------------------------------------------------------- tables behind charts
def trade_off(wide: DataFrame, by: str, methods: list[str], x: str, y: str, digits: int) -> DataFrame:
    """by, method, n, x, y, correlation: mean of two metrics a method, and how they go together over its rows."""
    points = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"{m}_{x}").cast("double").alias("x"), F.col(f"{m}_{y}").cast("double").alias("y")) for m in methods])
    long = wide.select(by, F.explode(points).alias("p")).select(by, "p.*")
    return long.groupBy(by, "method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), digits).alias("x"), F.round(F.avg("y"), digits).alias("y"), F.round(F.corr("x", "y"), digits).alias("correlation"))


def length_alignment(rows: DataFrame, by: str, predicted: str, reference: str, digits: int) -> DataFrame:
    """by, n, mean lengths in words, mean ratio (references without words left out), and how many are shorter and longer."""
    a, b = word_count(predicted), word_count(reference)
    long = rows.select(by, a.alias("a"), b.alias("b"))
    return long.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), digits).alias("mean_pred"), F.round(F.avg("b"), digits).alias("mean_ref"), F.round(F.avg(F.when(F.col("b") > 0, F.col("a") / F.col("b"))), digits).alias("mean_ratio"), F.count_if(F.col("a") < F.col("b")).alias("shorter"), F.count_if(F.col("a") > F.col("b")).alias("longer"))


def training_curve(log: DataFrame, run: str, step: str, value: str, width: int, digits: int) -> DataFrame:
    """run, bin, first_step, last_step, n, value, best: means over bins of `width` steps, and the least mean so far. The window goes over
    bins, which a run has few of."""
    bins = log.groupBy(run, F.floor(F.col(step) / width).cast("long").alias("bin")).agg(F.min(step).alias("first_step"), F.max(step).alias("last_step"), F.count(F.lit(1)).alias("n"), F.avg(value).alias(value))
    best = F.min(value).over(Window.partitionBy(run).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return bins.withColumn("best", F.round(best, digits)).withColumn(value, F.round(value, digits))
