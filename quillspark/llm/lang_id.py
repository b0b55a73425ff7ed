"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence are added as logarithms: the likelihood of the page's words, of the language its markup declares, of
its address suffix, and a prior of its host. Word likelihoods come from a bounded sample of labelled documents (frequent
words, and three-letter endings for the others). The tables of declared languages and suffixes and the host priors are
grouped sums of the pages' text posteriors: a host's prior is smoothed towards its domain's, the domain's towards that of
all pages, and a page's own share is taken out of its host's counts.

Null and empty pages have no words and are told by the other evidence; an unknown declaration or suffix is a value of its
own; repeated pages are rows of their own; null addresses share an empty host; without labelled documents the result is
null. Extra columns aren't read; a very long page is read whole. An empty table gives no rows. Pages of a host that many
pages have are dealt to several tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_hot, map_arrow, release, write_table

#: Bounds of the sample learnt from and of the features kept.
TRAIN_ROWS, FEATURES = 4_000, 40_000
MIN_COUNT = 5
#: Words are no independent witnesses: a page's text counts as this many at most.
EFFECTIVE_WORDS = 40
#: Pages of a host from which on they are dealt to several tasks, and the share of all pages that says the same.
HOT_PAGES, HOT_HOSTS, HOT_SHARE = 2_000, 2_000, 5_000
SMOOTH, HOST_WEIGHT, DOMAIN_WEIGHT = 0.5, 5.0, 20.0

_CUT = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|$)|<[^>]*>", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?\s*([A-Za-z]{2,3})(?![A-Za-z])", re.I)
_META = re.compile(r"<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?\s*([A-Za-z]{2,3})(?![A-Za-z])", re.I)
_WORD = re.compile(r"[^\W\d_]+")


def learn(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], dict[str, int], np.ndarray]:
    """(languages, feature numbers, log-likelihoods by feature and language) from at most `rows` labelled documents of least hash."""
    picked = docs.filter("lang is not null and text is not null and doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    train = docs.filter("lang is not null").select("doc_id", "lang", "text").join(F.broadcast(picked), "doc_id", "left_semi")  # `rows` ids
    words = train.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).filter("w <> ''")
    both = words.select("lang", F.explode(F.array("w", F.concat(F.lit("~"), F.substring("w", -3, 3)))).alias("f"))
    counts = both.groupBy("f", "lang").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("f").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by")).filter(F.col("total") >= MIN_COUNT).orderBy(F.desc("total"), "f").limit(FEATURES).collect()
    langs = sorted({x.lang for r in top for x in r.by})
    table = np.full((len(top) + 1, len(langs)), SMOOTH)
    number = {}
    for k, r in enumerate(top, 1):
        number[r.f] = k
        for x in r.by:
            table[k, langs.index(x.lang)] += x.n
    ends = np.array([False, *(r.f.startswith("~") for r in top)])
    table[0] = 1.0  # neither word nor ending known: no evidence
    for kind in (ends, ~ends):
        kind[0] = False
        if kind.any():
            table[kind] /= table[kind].sum(0)
    return langs, number, np.log(table)


def evidence(pages: DataFrame, langs: list[str], number: dict[str, int], table: np.ndarray) -> DataFrame:
    """page_id, url, declared, host, domain, suffix, n_words, ll (log-likelihood by language)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        for b in batches:
            declared, n_words, rows = [], [], []
            for html in b.column("html").to_pylist():
                html = html or ""
                m = _DECLARED.search(html) or _META.search(html)
                declared.append(m[1].lower() if m else "")
                words = _WORD.findall(unescape(_CUT.sub(" ", html)).lower())
                ids = [get(w) or get("~" + w[-3:], 0) for w in words]
                total = table[ids].sum(0) if ids else np.zeros(len(langs))
                rows.append((total * min(1.0, EFFECTIVE_WORDS / max(1, len(ids)))).tolist())
                n_words.append(len(words))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(declared, pa.string()), pa.array(n_words, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["page_id", "url", "declared", "n_words", "ll"])

    found = map_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, declared string, n_words long, ll array<double>")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]*)", 1))
    suffix = F.regexp_extract("host", r"\.([^.]+)$", 1)
    return found.withColumn("host", host).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).withColumn("suffix", suffix)


def _softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, url, lang, confidence, text_lang, declared, host."""
    spark = pages.sparkSession
    langs, number, table = learn(docs)
    if not langs:
        return pages.select("page_id", "url", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), F.lit("").alias("declared"), F.lit("").alias("host"))
    k = range(len(langs))
    rows = write_table(spark, evidence(pages, langs, number, table).withColumn("p", _softmax(F.col("ll"))), "page-evidence")
    sums = lambda c: [F.sum(F.get(c, F.lit(i))).alias(f"s{i}") for i in k]
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in k]
    hosts = write_table(spark, rows.groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).alias("n"), *sums("p")), "hosts")
    total = hosts.agg(F.sum("n").alias("gn"), *[F.sum(f"s{i}").alias(f"g{i}") for i in k])  # one row
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("dn"), *[F.sum(f"s{i}").alias(f"d{i}") for i in k])
    smooth = lambda c, n, up, weight: (c + weight * up) / (n + weight)
    share = lambda i: (F.col(f"g{i}") + SMOOTH) / (F.col("gn") + SMOOTH * len(langs))
    # shares of a value among the pages of each language; declarations are at most 18,279 values
    suffixes = hosts.groupBy("suffix").agg(*again)

    def likely(values: DataFrame, to: str) -> DataFrame:
        totals = values.agg(F.count(F.lit(1)).alias("vn"), *[F.sum(f"s{i}").alias(f"t{i}") for i in k])  # one row
        logs = [F.log((F.col(f"s{i}") + SMOOTH) / (F.col(f"t{i}") + SMOOTH * F.col("vn"))) for i in k]
        return values.crossJoin(F.broadcast(totals)).select(values.columns[0], F.array(*logs).alias(to))

    by_suffix = likely(suffixes, "by_suffix")
    by_declared = likely(rows.groupBy("declared").agg(*sums("p")), "by_declared")
    # a domain or a suffix may have a large share of all hosts
    n_hosts = hosts.count()
    often = lambda c: hosts.groupBy(c).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > max(HOT_HOSTS, n_hosts // HOT_SHARE)).select(c, F.ceil(F.col("c") / max(HOT_HOSTS, n_hosts // HOT_SHARE)).cast("int").alias("parts"))
    prior = join_hot(hosts, domains, ["domain"], often("domain"), ["host"]).crossJoin(F.broadcast(total)).select("host", "n", F.array(*[f"s{i}" for i in k]).alias("hs"), F.array(*[smooth(F.col(f"d{i}"), F.col("dn"), share(i), DOMAIN_WEIGHT) for i in k]).alias("up"), "suffix")
    prior = write_table(spark, join_hot(prior, by_suffix, ["suffix"], often("suffix"), ["host"]).drop("suffix"), "host-priors")
    per = max(HOT_PAGES, (total.first().gn or 0) // HOT_SHARE)
    hot = hosts.filter(F.col("n") > per).select("host", F.ceil(F.col("n") / per).cast("int").alias("parts"))
    joined = join_hot(rows, prior, ["host"], hot, ["page_id", "url"]).join(F.broadcast(by_declared), "declared")
    at = lambda c, i: F.get(c, F.lit(i))
    scores = F.array(*[at("ll", i) + at("by_declared", i) + at("by_suffix", i) + F.log(F.greatest(smooth(at("hs", i) - at("p", i), F.col("n") - 1, at("up", i), HOST_WEIGHT), F.lit(1e-9))) for i in k])
    named = F.array(*[F.lit(x) for x in langs])
    best = lambda c: F.element_at(named, F.array_position(c, F.array_max(c)).cast("int"))
    out = joined.withColumn("scores", scores).withColumn("post", _softmax(F.col("scores")))
    release(spark)
    return out.select("page_id", "url", best(F.col("post")).alias("lang"), F.array_max("post").alias("confidence"), F.when(F.col("n_words") > 0, best(F.col("p"))).alias("text_lang"), "declared", "host")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), documents(spark, sf_dir))
