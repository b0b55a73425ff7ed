"""Text-pair metrics. Multiset overlaps are folds in the JVM; n-gram statistics are Arrow UDFs that count a whole batch in arrays;
subsequences are bit-parallel. All statistics sum, so corpus scores are partial aggregates and a last formula."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import folded_tokens, let, normalize, words

CHRF_ORDER, CHRF_BETA = 6, 2
BLEU_ORDER = 4


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays (null: empty): one pass over both, sorted together, that pairs each element of the
    second with one of the first that is still free."""
    row = lambda free: lambda t: F.struct(t.alias("t"), F.lit(free).alias("second"))
    none = F.array().cast("array<string>")
    both = F.sort_array(F.concat(F.transform(F.coalesce(a, none), row(False)), F.transform(F.coalesce(b, none), row(True))))
    state = lambda t, free, n: F.struct(t.alias("t"), free.cast("int").alias("free"), n.cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        free = F.when(s["t"] == x["t"], s["free"]).otherwise(0)
        met = x["second"] & (free > 0)
        return state(x["t"], F.when(met, free - 1).when(x["second"], free).otherwise(free + 1), s["n"] + met.cast("long"))

    return F.aggregate(both, state(F.lit(""), F.lit(0), F.lit(0)), step, lambda s: s["n"])


def f1(common: Column, n: Column, m: Column, both_empty: float = 0.0) -> Column:
    return F.when((n == 0) & (m == 0), both_empty).when((n == 0) | (m == 0) | (common == 0), 0.0).otherwise(2.0 * (common / n) * (common / m) / (common / n + common / m))


def token_f1(pred: Column | str, ref: Column | str, variant: str = "multiset") -> Column:
    """Variants: multiset; set (distinct overlap over list lengths); service (accent-free word runs, both empty 1); notebook (multiset,
    both empty 1)."""
    tokens = folded_tokens if variant == "service" else lambda c: words(normalize(c))
    common = (lambda a, b: F.size(F.array_intersect(a, b))) if variant == "set" else overlap
    counted = lambda x: F.struct(common(x["a"], x["b"]).cast("double").alias("c"), F.size(x["a"]).alias("n"), F.size(x["b"]).alias("m"))
    found = let(F.struct(tokens(pred).alias("a"), tokens(ref).alias("b")), counted)
    return let(found, lambda x: f1(x["c"], x["n"], x["m"], 1.0 if variant in ("service", "notebook") else 0.0))


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        v = (v + u | v - u) & full
    return len(a) - bin(v).count("1")


@F.pandas_udf(T.LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_lcs(list(x), list(y)) if x is not None and y is not None else 0 for x, y in zip(a, b)])


def rouge_l(pred: Column | str, ref: Column | str, variant: str = "whitespace") -> Column:
    """Variants: whitespace; ascii (tokens [a-z0-9]+); notebook (whitespace, both empty 1)."""
    if variant == "ascii":
        tokens = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    else:
        tokens = lambda c: words(normalize(c))
    a, b = tokens(pred), tokens(ref)
    return let(F.struct(lcs_length(a, b).cast("double").alias("c"), F.size(a).alias("n"), F.size(b).alias("m")), lambda x: f1(x["c"], x["n"], x["m"], 1.0 if variant == "notebook" else 0.0))


# --------------------------------------------------------------------------- n-grams of a batch
#: Pairs of texts, and symbols of both sides, that are counted at once. A key holds the pair's number above the n-gram.
BATCH_PAIRS, BATCH_SYMBOLS, GRAM_BITS = 1 << 12, 1 << 20, 52
#: White characters that a text is split at.
_WHITE = np.array([chr(c).isspace() for c in range(0x3001)])


def _gram_keys(symbols: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """Sorted keys of the n-grams of order 1, 2, ... of texts laid end to end. One or two symbols (below 2**26 each) are the key as they
    are, longer n-grams a hash of GRAM_BITS bits."""
    ends, row = np.cumsum(sizes), np.repeat(np.arange(len(sizes)), sizes)
    left = ends[row] - np.arange(len(symbols))
    high, h = row.astype(np.uint64) << np.uint64(GRAM_BITS), symbols.astype(np.uint64)
    for n in range(1, order + 1):
        if n > 1:
            h = h[:-1] * np.uint64(1 << 26 if n == 2 else 0x9E3779B97F4A7C15) + symbols[n - 1 :].astype(np.uint64) if len(h) else h
        there = left[: len(h)] >= n
        key = h[there]
        if n > 2:
            key = (key ^ key >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            key = (key ^ key >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            key >>= np.uint64(64 - GRAM_BITS)
        yield np.sort(high[: len(h)][there] | key)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _in_both(a: np.ndarray, b: np.ndarray, pairs: int) -> np.ndarray:
    """Size of the multiset intersection of each pair's n-grams."""
    (ka, na), (kb, nb) = _counted(a), _counted(b)
    if not len(kb):
        return np.zeros(pairs, np.int64)
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    hit = kb[at] == ka
    return np.bincount((ka[hit] >> np.uint64(GRAM_BITS)).astype(np.int64), np.minimum(na[hit], nb[at[hit]]), pairs).astype(np.int64)


def _gram_table(p: tuple[np.ndarray, np.ndarray], r: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """A row a pair; for each order its n-grams of the prediction, of the reference, and of both."""
    sizes = [np.asarray(x[1], np.int64) for x in (p, r)]
    out = np.zeros((len(sizes[0]), 3 * order), np.int64)
    for n, (a, b) in enumerate(zip(_gram_keys(p[0], sizes[0], order), _gram_keys(r[0], sizes[1], order))):
        out[:, 3 * n], out[:, 3 * n + 1] = (np.maximum(s - n, 0) for s in sizes)
        out[:, 3 * n + 2] = _in_both(a, b, len(out))
    return out


def _in_blocks(p: pa.Array, r: pa.Array, sizes: np.ndarray, told: Callable[[pa.Array, pa.Array], np.ndarray]) -> pa.Array:
    """An array<long> for each pair, counted in blocks of bounded size."""
    begin, out = 0, []
    upto = np.cumsum(sizes)
    while begin < len(p):
        done = upto[begin - 1] if begin else 0
        end = min(len(p), begin + BATCH_PAIRS, max(begin + 1, int(np.searchsorted(upto, done + BATCH_SYMBOLS, side="right"))))
        out.append(told(p.slice(begin, end - begin), r.slice(begin, end - begin)))
        begin = end
    rows = np.concatenate(out) if out else np.zeros((0, 1), np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts laid end to end without their white space, and how many each has."""
    every = [t or "" for t in texts.to_pylist()]
    points = np.frombuffer("".join(every).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(every)), [len(t) for t in every])
    kept = ~_WHITE[np.minimum(points, len(_WHITE) - 1)] | (points >= len(_WHITE))
    return points[kept], np.bincount(row[kept], minlength=len(every))


def _lengths(a: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(a) if pa.types.is_string(a.type) or pa.types.is_large_string(a.type) else pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)


@F.arrow_udf(T.ArrayType(T.LongType()))
def chrf_stats(pred: pa.Array, ref: pa.Array) -> pa.Array:
    """For each order: n-grams of the prediction, of the reference, and in both; white space left out."""
    return _in_blocks(pred, ref, _lengths(pred) + _lengths(ref), lambda p, r: _gram_table(_points(p), _points(r), CHRF_ORDER))


def sum_arrays(c: Column | str, size: int) -> Column:
    """Element-wise sum as an aggregate."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(size)])


def chrf_score(stats: Column | str) -> Column:
    """0 to 100 from statistics of a pair or of a corpus; orders that neither side has don't count."""
    s = F.col(stats) if isinstance(stats, str) else stats
    get = lambda i: F.get(s, F.lit(i)).cast("double")
    p_sum = r_sum = used = F.lit(0.0)
    for n in range(CHRF_ORDER):
        a, b, m = get(3 * n), get(3 * n + 1), get(3 * n + 2)
        both = (a > 0) & (b > 0)
        p_sum = p_sum + F.when(both, m / F.when(a > 0, a)).otherwise(0.0)
        r_sum = r_sum + F.when(both, m / F.when(b > 0, b)).otherwise(0.0)
        used = used + F.when(both, 1.0).otherwise(0.0)
    p, r, beta = p_sum / F.when(used > 0, used), r_sum / F.when(used > 0, used), float(CHRF_BETA**2)
    return F.when((used == 0) | (p + r == 0), 0.0).otherwise(100 * (1 + beta) * p * r / (beta * p + r))


# The mteval 13a rules, as pattern and replacement.
TOKENS_13A = [
    (r"<skipped>", ""),
    (r"-\n", ""),
    (r"\n", " "),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"([{-~\[-` -&(-+:-@/])", r" $1 "),
    (r"([^0-9])([.,])", r"$1 $2 "),
    (r"([.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
]


def tokens_13a(c: Column | str) -> Column:
    """Tokens of a text by the mteval 13a rules."""
    t = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    for k, (pattern, to) in enumerate(TOKENS_13A):
        t = F.regexp_replace(F.concat(F.lit(" "), t, F.lit(" ")) if k == 7 else t, pattern, to)
    return words(t)


def bleu_stats(pred: Column | str, ref: Column | str) -> Column:
    """Lengths of prediction and reference, then for each order matches and n-grams of the prediction."""
    return _bleu_stats(tokens_13a(pred), tokens_13a(ref))


def _words(p: pa.Array, r: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the words of both sides, laid end to end, and how many each text has."""
    flat = [x.flatten() for x in (p, r)]
    number = pa.concat_arrays([x.cast(pa.string()) for x in flat]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return [(number[: len(flat[0])], _lengths(p)), (number[len(flat[0]) :], _lengths(r))]


@F.arrow_udf(T.ArrayType(T.LongType()))
def _bleu_stats(pred: pa.Array, ref: pa.Array) -> pa.Array:
    def told(p: pa.Array, r: pa.Array) -> np.ndarray:
        (a, n), (b, m) = _words(p, r)
        found = _gram_table((a, n), (b, m), BLEU_ORDER)
        return np.column_stack([n, m, *(x for k in range(BLEU_ORDER) for x in (found[:, 3 * k + 2], found[:, 3 * k]))])

    return _in_blocks(pred, ref, _lengths(pred) + _lengths(ref), told)


def bleu_score(stats: Column | str) -> Column:
    """0 to 100 with brevity penalty and exponential smoothing of empty orders."""
    s = F.col(stats) if isinstance(stats, str) else stats
    get = lambda i: F.get(s, F.lit(i)).cast("double")
    log_sum, smooth, dead = F.lit(0.0), F.lit(1.0), F.lit(False)
    for n in range(BLEU_ORDER):
        m, t = get(2 + 2 * n), get(3 + 2 * n)
        smooth = F.when((m == 0) & (t > 0), smooth * 2).otherwise(smooth)
        precision = F.when(m > 0, 100.0 * m / F.when(t > 0, t)).when(t > 0, 100.0 / (smooth * t))
        log_sum = log_sum + F.coalesce(F.log(precision), F.lit(0.0))
        dead = dead | (t == 0)
    brevity = F.when(get(0) >= get(1), 1.0).when(get(0) == 0, 0.0).otherwise(F.exp(1 - get(1) / F.when(get(0) > 0, get(0))))
    return F.when(dead | (get(0) == 0), 0.0).otherwise(brevity * F.exp(log_sum / BLEU_ORDER))


# --------------------------------------------------------------------------- vectors of tokens
MATCH = T.StructType([T.StructField(k, T.DoubleType()) for k in ("precision", "recall", "f1")])


def _greedy(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> tuple[float, float]:
    """Weighted means of each row's best cosine on the other side, in blocks of rows."""
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
    a, b = unit(a), unit(b)
    best_a, best_b = np.empty(len(a)), np.full(len(b), -np.inf)
    for k in range(0, len(a), 1024):
        cosine = a[k : k + 1024] @ b.T
        best_a[k : k + 1024] = cosine.max(1)
        np.maximum(best_b, cosine.max(0), out=best_b)
    mean = lambda x, w: float((x * w).sum() / w.sum()) if w.sum() > 0 else 0.0
    return mean(best_a, wa), mean(best_b, wb)


def _vectors_of(lists: pa.Array, k: int) -> np.ndarray:
    rows = lists[k].values
    if rows is None or not len(rows):
        return np.zeros((0, 0))
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


@F.arrow_udf(MATCH)
def _token_match(a: pa.Array, b: pa.Array, wa: pa.Array, wb: pa.Array) -> pa.Array:
    out = []
    for k in range(len(a)):
        x, y = _vectors_of(a, k), _vectors_of(b, k)
        if not len(x) or not len(y):
            out.append((0.0, 0.0, 0.0))
            continue
        weight = lambda w, n: np.ones(n) if w[k].values is None else w[k].values.to_numpy(zero_copy_only=False).astype(np.float64)  # noqa: B023, E731
        p, r = _greedy(x, y, weight(wa, len(x)), weight(wb, len(y)))
        out.append((p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0))
    p, r, f = zip(*out) if out else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in (p, r, f)], names=["precision", "recall", "f1"])


def token_match(pred: Column | str, ref: Column | str, pred_weights: Column | str | None = None, ref_weights: Column | str | None = None, baseline: float = 0.0) -> Column:
    """precision, recall, f1 by greedy matching of token vectors (array<array>), as models score texts: each token counts with its best
    cosine on the other side, weighted (by idf, say; none: alike). baseline: scores are scaled so that it becomes 0. A side without
    tokens scores 0."""
    none = F.lit(None).cast("array<double>")
    col = lambda c: none if c is None else F.col(c) if isinstance(c, str) else c
    found = _token_match(col(pred), col(ref), col(pred_weights), col(ref_weights))
    if not baseline:
        return found
    return F.struct(*[((found[k] - baseline) / (1 - baseline)).alias(k) for k in ("precision", "recall", "f1")])


def idf_weights(tokens: DataFrame, key: str, token: str) -> DataFrame:
    """token, idf over a corpus of references: log((n + 1) / (df + 1))."""
    n = tokens.agg(F.count_distinct(key).alias("_n"))
    return tokens.select(key, token).distinct().groupBy(token).agg(F.count(F.lit(1)).alias("_df")).crossJoin(F.broadcast(n)).select(token, F.log((F.col("_n") + 1) / (F.col("_df") + 1)).alias("idf"))  # one row
