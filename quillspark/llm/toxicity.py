"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learnt from labelled rows by a grouped count of words; the features of a text are lexicon densities, lexicon
words near second-person words, capitals, punctuation and obfuscation rates, all rates of the whole text. A booster of
histogram trees is fitted on the driver on a bounded sample of TRAIN_ROWS labelled rows (the rows of least hash, so the
sample is the same at every run), and isotonic regression on a held-back part of that sample, which neither the lexicon nor
the booster has seen, turns margins into probabilities. Scoring is row-local over all documents.

Rows whose crc32(doc_id) mod 4 is 2 are never learnt from. Null and empty texts are scored by their all-zero features;
without labels of both kinds the score is the share of toxic labels (0 without labels); repeated labels count as rows, and
so do labelled rows of a repeated doc_id; a very long text is scored whole. Only doc_id, text and toxic are read, so extra
columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, raw_texts, text_blocks

HELD_OUT = 2
THRESHOLD = 0.3
#: Bound of the sample that the driver learns from.
TRAIN_ROWS = 12_000
LEXICON_WORDS = 256
#: One in so many sampled rows, by a hash, calibrates; the others teach the lexicon and the booster.
CALIBRATION = 8
#: Inflected and compounded insults share a stem: the first STEM bytes of longer words.
STEM = 5
MIN_LEXICON_DOCS = 3
PROXIMITY = 5

#: Second-person words of the corpus languages.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú tu ti tuyo usted ustedes vosotros vuestro su".encode().split())
FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
LEET = str.maketrans("013457@$!", "oieastasi")
OBFUSCATED = re.compile(r"(?<![^\W_])[a-z]+(?:[0-9@$!*._+-]+[a-z]+)+(?![^\W_])")
FEATURES = ["hits", "hit_rate", "distinct", "weight", "weight_rate", "strongest", "stem_hits", "stem_rate", "stem_distinct", "stem_weight_rate", "near_you", "near_you_rate", "capitals", "shouted", "exclaims", "questions", "punctuation", "obfuscated", "obfuscated_hits", "log_words"]


def features_of(raw: bytes, lexicon: dict[bytes, float], stems: dict[bytes, float]) -> tuple[float, ...]:
    text = raw.decode()
    low = text.lower()
    folded = low.encode()
    words = folded.translate(FOLD).split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    hits = [i for i, w in enumerate(words) if w in lexicon]
    weights = [lexicon[words[i]] for i in hits]
    stemmed = [(i, w[:STEM]) for i, w in enumerate(words) if w[:STEM] in stems and len(w) > STEM]
    near = sum(1 for i in {*hits, *(i for i, _ in stemmed)} if not YOU.isdisjoint(words[max(0, i - PROXIMITY) : i + PROXIMITY + 1]))
    size = len(raw)
    capitals = size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    odd = OBFUSCATED.findall(low)
    odd_hits = sum(1 for w in odd if re.sub(r"[^a-z]", "", w.translate(LEET)).encode() in lexicon)
    return (
        len(hits), 100 * len(hits) / n, len({words[i] for i in hits}), sum(weights), 100 * sum(weights) / n, max(weights, default=0.0),
        len(stemmed), 100 * len(stemmed) / n, len({words[i] for i, _ in stemmed}), 100 * sum(stems[t] for _, t in stemmed) / n, near, 100 * near / n,
        capitals / size, float(low != text and text.upper() == text), 100 * raw.count(b"!") / n, 100 * raw.count(b"?") / n,
        (size - len(raw.translate(None, b".,;:!?\"'()-"))) / size, 100 * len(odd) / n, odd_hits, math.log1p(n),
    )


# --------------------------------------------------------------------------- boosting
@dataclass
class Booster:
    """Histogram trees with logistic loss: (feature, cut, left, right, value) by node."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                f = np.maximum(feature[at], 0)
                at = np.where(inner, np.where(x[np.arange(len(x)), f] <= cut[at], left[at], right[at]), at)
            out += value[at]
        return out


def fit_booster(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, penalty: float = 1.0, least: int = 5) -> Booster:
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Booster(float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        nodes: list[list] = [[-1, 0.0, -1, -1, 0.0]]
        todo = [(0, np.arange(len(y)), 0)]
        while todo:
            at, rows, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            nodes[at][4] = -rate * gs / (hs + penalty)
            best = (1e-6, -1, -1)
            if level < depth and len(rows) >= 2 * least:
                for f, c in enumerate(cuts):
                    b, size = binned[rows, f], len(c) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                    gain = np.where((nl >= least) & (len(rows) - nl >= least), gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs**2 / (hs + penalty), 0)
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), f, int(gain.argmax()))
            if best[1] >= 0:
                _, f, k = best
                go = binned[rows, f] <= k
                nodes[at][:4] = [f, float(cuts[f][k]), len(nodes), len(nodes) + 1]
                nodes += [[-1, 0.0, -1, -1, 0.0], [-1, 0.0, -1, -1, 0.0]]
                todo += [(len(nodes) - 2, rows[go], level + 1), (len(nodes) - 1, rows[~go], level + 1)]
            else:
                margin[rows] += nodes[at][4]
        model.trees.append(tuple(np.array(c) for c in zip(*nodes)))
    return model


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(margins, probabilities) of the pooled-adjacent-violators fit, for linear interpolation."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # sum, weight, first, last
    for m, v in zip(margin[order].tolist(), y[order].tolist()):
        pools.append([v, 1.0, m, m])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
            s, w, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += w
            pools[-1][3] = last
    xs = [v for p in pools for v in (p[2], p[3])]
    ys = [p[0] / p[1] for p in pools for _ in (0, 1)]
    return np.array(xs), np.array(ys)


@dataclass
class Model:
    lexicon: dict[bytes, float]
    stems: dict[bytes, float]
    booster: Booster
    calibration: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([features_of(t, self.lexicon, self.stems) for t in texts], np.float64)
        margin = self.booster.margin(x)
        xs, ys = self.calibration
        p = np.interp(margin, xs, ys) if len(xs) else 1 / (1 + np.exp(-margin))
        # the margin breaks the steps' ties, so that the ranking stays the booster's
        return np.clip(0.999 * p + 0.001 / (1 + np.exp(-margin)), 0.0, 1.0)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == HELD_OUT


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text and toxic of the labelled rows to learn from: at most `rows`, those of least hash; `calibrates` holds some back."""
    picked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    apart = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(CALIBRATION)) == 0
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic", apart.alias("calibrates"))  # `rows` rows at most


def learn_lexicon(train: DataFrame, positive: int, negative: int, by_stem: bool = False) -> dict[bytes, float]:
    """Words (or stems of longer words) that toxic texts hold far more often, with the log ratio of their document shares."""
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")
    words = train.select("doc_id", "toxic", word).filter(F.length("word").between(3, 40)).withColumn("word", F.col("word").cast("binary"))
    if by_stem:
        words = words.filter(F.octet_length("word") > STEM).withColumn("word", F.substring("word", 1, STEM)).distinct()
    counts = words.groupBy("word").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q")).filter(F.col("p") >= MIN_LEXICON_DOCS)
    weight = F.log((F.col("p") + 0.5) / (positive + 1)) - F.log((F.col("q") + 0.5) / (negative + 1))
    # one that stands out by more than chance: weight against its standard error
    error = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5))
    best = counts.select("word", weight.alias("weight"), (weight / error).alias("z"), "p").filter("z > 2.5 and weight > 1").withColumn("rank", F.col("z") * F.sqrt("p")).orderBy(F.desc("rank"), "word").limit(LEXICON_WORDS)
    return {bytes(r.word): float(r.weight) for r in best.collect()}


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    every = sample(docs, labels, rows)
    kinds = {(r.calibrates, r.toxic): r.n for r in every.groupBy("calibrates", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    total, positive = sum(kinds.values()), sum(n for (_, t), n in kinds.items() if t)
    if not total or not positive or positive == total:
        p = float(positive or 0) / total if total else 0.0
        return Model({}, {}, Booster(0.0), (np.array([0.0]), np.array([p])))
    # with too few of a kind on either side nothing is held back, and margins stay uncalibrated
    apart = min(kinds.get((c, t), 0) for c in (False, True) for t in (0, 1)) >= 3
    train = every.filter("not calibrates") if apart else every
    lexicon, stems = (learn_lexicon(train, *(sum(n for (c, t), n in kinds.items() if t == k and not (apart and c)) for k in (1, 0)), by_stem) for by_stem in (False, True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [list(map(float, features_of(t, lexicon, stems))) for t in raw_texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("calibrates"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "calibrates", "x"])

    found = map_arrow(every, run, "doc_id long, toxic int, calibrates boolean, x array<double>").toPandas()  # `rows` rows of numbers
    found = found.sort_values("doc_id", kind="stable")
    x, y = np.array(found.x.tolist()), found.toxic.to_numpy(float)
    part = found.calibrates.to_numpy(bool) & apart
    model = Model(lexicon, stems, fit_booster(x[~part], y[~part]), (np.zeros(0), np.zeros(0)))
    if part.any():
        model.calibration = fit_isotonic(model.booster.margin(x[part]), y[part])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_blocks(b):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(texts), pa.float64())], names=["doc_id", "score"])

    out = map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
