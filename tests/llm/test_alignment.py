"""Alignment of two tokenizers against plain loops over whole texts encoded by the libraries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import alignment, quality, token_store
from quillspark.llm.bpe import byte_characters, load_tokenizer

from .conftest import ROWS

ODD = ["a  b   c", " lead", "tail ", "  ", "\n", "\n\n x\n y", "a▁b", "▁", "<|endoftext|> x<|endoftext|>", "<s> </s> <unk> <0x41>", "é́ ß ẞ", "日本語 テキスト", "a\x00b\x1f", "    x", "tab\t\tx \r\n", "x" * 5000, "😀😀 👩‍👩‍👧", "don't we'll 1234567", "▁a ▁", "a \n b", "Ω≈ç√∫ ֐א", "퟿"]


def plain(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) by row."""
    import sentencepiece

    tok = load_tokenizer(token_store.default_path())
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=quality.default_path())
    back = {c: b for b, c in byte_characters().items()}
    aligned, count = [], Counter()
    for k, t in rows:
        a, b = tok.encode(" " + (t or ""), add_special_tokens=False).ids, sp.encode(t or "")
        wa = [bytes(back[c] for c in tok.id_to_token(i)) for i in a]
        wb = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = (" " + (t or "")).encode()
        if not t or b"".join(wa) != raw or b"".join(wb) != raw:
            aligned.append((k, [], [], "", []))
            continue
        ea, eb = np.cumsum([len(x) for x in wa]).tolist(), np.cumsum([len(x) for x in wb]).tolist()
        links, i, j, sets, ga, gb = [], 0, 0, [], [], []
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            x, y = ea[i], eb[j]
            if x <= y:
                ga.append(a[i])
                i += 1
            if y <= x:
                gb.append(b[j])
                j += 1
            if x == y:
                sets.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        count.update(links)
        aligned.append((k, a, b, hashlib.sha256(";".join(sets).encode()).hexdigest(), links, len(sets)))
    best: dict = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(r[0], len(r[1]), len(r[2]), r[5] if r[4] else 0, len(r[4]), sum(count[x] == best[x[1]] for x in r[4]), sum(count[x] for x in r[4]), r[3]) for r in aligned]


def told(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


@pytest.fixture(scope="module")
def rows():
    return ROWS + list(enumerate(ODD, 1000)) + [(1000, ODD[0])] * 3


@pytest.fixture(scope="module")
def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("N_A", F.lit("x")).repartition(3)


def test_against_plain_loops(texts, rows, no_docs, monkeypatch):
    want = Counter(plain(rows))
    assert told(alignment.alignment(texts)) == want
    monkeypatch.setattr(alignment, "MAX_PAIRS", 1)  # the join instead of the lookup
    monkeypatch.setattr(alignment, "HOT_SHARE", 20)
    assert told(alignment.alignment(texts)) == want
    assert alignment.alignment(no_docs).count() == 0


def test_small_blocks_give_the_same(texts, rows, monkeypatch):
    for name, to in (("BLOCK_TOKENS", 7), ("FLUSH_TOKENS", 5), ("MERGE_PAIRS", 50)):
        monkeypatch.setattr(alignment, name, to)
    assert told(alignment.alignment(texts)) == Counter(plain(rows))


def test_events_of_two_tables(texts, rows):
    """Blocks dealt by document from two tables give what blocks made in one place give; links and groups of the parts agree."""
    events = alignment.token_events(texts).cache()
    sizes = tuple(v.width for v in alignment.vocabularies(token_store.default_path(), quality.default_path()))
    here = alignment.alignments(events, sizes, dealt=False)
    there = alignment.align(events.filter("side = 0"), events.filter("side = 1").repartition(5), sizes)
    total = lambda df: Counter(tuple(r) for r in df.groupBy("doc_id", "tkey", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").agg(F.sum("copies")).collect())
    assert total(here) == total(there)
    n = sum(r.copies * r.n_links for r in here.collect())
    every = alignment.links(events, sizes)
    assert every.count() == n and every.filter("begin >= end").count() == 0
    own = alignment.groups(events, sizes).filter("doc_id = 1006").orderBy("number").collect()
    assert len(own) == 0
    own = alignment.groups(events, sizes).filter("doc_id = 1001").orderBy("number").collect()
    text = ";".join(",".join(map(str, g.a_ids)) + "|" + ",".join(map(str, g.b_ids)) for g in own)
    assert {hashlib.sha256(text.encode()).hexdigest()} == {r.groups_sha256 for r in here.filter("doc_id = 1001").collect()}
    assert [g.begin for g in own[1:]] == [g.end for g in own[:-1]]


def test_sides_that_end_apart_have_no_tokens(spark):
    widths = np.array([1, 1, 1, 2, 2, 1, 1, 3, 4, 1]), np.array([1, 1, 1, 1, 1, 1, 1, 3, 4, 1])
    for extra in (0, 1 << 16):  # ids of two bytes, and of four
        both = tuple(np.append(w, np.ones(extra, np.int64)) for w in widths)
        pack = lambda *x: np.array(x, alignment.id_type(both)).tobytes()  # noqa: B023, E731
        a = spark.createDataFrame([(1, 5, 0, pack(3, 4)), (2, 5, 0, pack(3, 4))], "doc_id long, tkey long, begin long, ids binary")
        b = spark.createDataFrame([(1, 5, 0, pack(7)), (2, 5, 0, pack(8))], a.schema)
        got = {r.doc_id: (r.n_a, r.n_links, r.groups_sha256 != "", r.copies) for r in alignment.align(a, b, both).collect()}
        assert got == {1: (0, 0, False, 1), 2: (2, 2, True, 1)}


def test_machine_against_overlaps():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 60)
        ends = [sorted({*rng.sample(range(1, n + 1), rng.randint(0, n - 1)), n}) for _ in range(2)]
        machine = alignment.Machine()
        for side, e in enumerate(ends):
            machine.add(side, np.arange(len(e), dtype=np.int32), np.diff(e, prepend=0).astype(np.int32))
        g = machine.closed()
        spans = [list(zip([0, *e[:-1]], e)) for e in ends]
        want = [(i, j) for i, (p, q) in enumerate(spans[0]) for j, (r, s) in enumerate(spans[1]) if p < s and r < q]
        i, j, _ = g.links()
        assert sorted(zip(i.tolist(), j.tolist())) == want and g.shared.tolist() == sorted({*ends[0]} & {*ends[1]})
