"""Ranked search against plain loops, with ties, repeated rows, small ranges; how much of the tree is opened."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lexical_search as ls

from . import brute
from .conftest import ITEMS, ROWS


def plain(rows, items, k=50):
    """(item_id, rank, doc_id, score) by brute force."""
    docs = [(d, Counter(w), len(w)) for d, t in rows if (w := brute.item_words(t))]
    n_docs, n_words = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        terms = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(brute.item_words(text)) if df[t]}
        scores = []
        for d, c, n in docs:
            m = 100 - 50 + 50 * n * n_docs // n_words
            s = sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, w in terms.items())
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out


def told(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(tuple(r) for r in df.collect())


def test_against_plain_loops(docs, no_docs, benchmark, spark):
    more = [(7, ROWS[25][1]), (8, ROWS[40][1]), (8, ROWS[40][1]), (None, "one WORD"), (9, ROWS[6][1][:3000])]
    items = benchmark.unionByName(spark.createDataFrame(more, benchmark.schema)).withColumn("Rank", F.lit("x"))
    want = Counter(plain(ROWS, ITEMS + more))
    assert told(ls.search(docs, items)) == want
    assert told(ls.search(docs, items, k=3)) == Counter(plain(ROWS, ITEMS + more, 3))
    assert ls.search(no_docs, items).count() == ls.search(docs, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("change", [{"RANGE_DOCS": 5, "LEAF": 2, "FANOUT": 2, "RANGE_ROWS": 1, "FIRST_RANGES": 1}, {"BLOCK_TERMS": 20}, {"RANGE_POSTINGS": 40}])
def test_small_ranges_and_blocks_give_the_same(docs, benchmark, monkeypatch, change):
    for name, to in change.items():
        monkeypatch.setattr(ls, name, to)
    assert told(ls.search(docs, benchmark, k=4)) == Counter(plain(ROWS, ITEMS, 4))


def test_many_equal_scores(spark, monkeypatch):
    """Copies in every range: the smallest doc_ids win, whatever the order of the rows."""
    monkeypatch.setattr(ls, "RANGE_DOCS", 16)
    monkeypatch.setattr(ls, "LEAF", 4)
    rng = random.Random(4)
    rows = [(k, rng.choice(["red green blue", "red green blue", "blue sky", "nothing"])) for k in range(400)]
    rng.shuffle(rows)
    items = [(1, "green red"), (2, "sky blue sea"), (3, "absent")]
    got = ls.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), k=10)
    assert told(got) == Counter(plain(rows, items, 10))


def test_descent_opens_few_nodes():
    """Of 4,096 documents with 6 of 100 terms each, a query's descent opens the leaves that can hold its best alone."""
    rng = np.random.default_rng(1)
    sizes = np.full(4096, 6)
    terms = np.sort(np.argsort(rng.random((4096, 100)), axis=1)[:, :6], axis=1).ravel()
    tree = ls.Tree(list(range(4096)), rng.integers(20, 400, 4096), sizes, terms, rng.geometric(0.5, len(terms)), 100, 4096, 4096 * 200)
    weight = np.zeros(100, np.int64)
    asked = np.array([3, 17, 29])
    weight[asked] = [900, 2500, 4000]
    best: list = []
    tree.search(asked, weight, best, 10, 1)
    scores = np.add.reduceat(weight[terms] * tree.impact, np.arange(0, len(terms), 6))
    want = sorted(((int(s), -d) for d, s in enumerate(scores)), reverse=True)[:10]
    assert sorted(best, reverse=True) == want
    every = sum(len(first) - 1 for first, _, _ in tree.levels)
    assert tree.opened < every / 2
    again: list = []
    tree.opened = 0
    tree.search(asked, weight, again, 10, want[-1][0] + 1)  # a floor above the last of them
    assert len(again) < 10 and tree.opened <= every / 2


def test_long_documents_dont_overflow():
    length = np.array([10, 2**40])
    assert ls.impacts(np.array([1, 5]), length, 10**9, 10**13).tolist() == [10**9 // (1000 + 20 * (50 + 50 * 10 * 10**9 // 10**13)), 5 * 10**9 // (5000 + 20 * (50 + 50 * 2**40 * 10**9 // 10**13))]
