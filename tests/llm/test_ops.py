"""Each operator against a plain version, on awkward rows and on an empty table."""

from __future__ import annotations

import hashlib
import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import benchmark_filter, bpe, common, html_text, near_dedup, quality, sharding, substring_dedup, token_store, toxicity
from quillspark.llm.common import new_path
from quillspark.llm.fm_index import NOWHERE, FMIndex

from . import brute
from .conftest import ITEMS, ROWS


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    return Counter(tuple(r) for r in rows)


def test_bpe(docs, no_docs):
    tok = bpe.load_tokenizer(bpe.default_path())
    want = []
    for k, t in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert plain(bpe.digests(docs).collect()) == plain(want)
    assert bpe.digests(no_docs).count() == 0
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text").filter("doc_id between 10 and 12"))).collect()
    assert back and all(r.decoded == tok.decode(r.ids, skip_special_tokens=False) for r in back)


def test_special_strings_and_odd_spaces(spark):
    texts = ["a<|endoftext|>b", "it's  we'll x y\u0085z", "é ẞ Σς", "1234 5,6", "\x1c\x1d a\x00b"]
    tok = bpe.load_tokenizer(bpe.default_path())
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.ids for r in got] == [tok.encode(r.text, add_special_tokens=False).ids for r in got]
    byte = token_store.load_tokenizer(token_store.default_path())
    ids, at = token_store.Encoder(token_store.default_path()).encode([t.encode() for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [byte.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_store(spark, docs, no_docs):
    root = new_path(spark, "store")
    manifest = [tuple(r) for r in token_store.write_store(docs, root).collect()]
    got = token_store.read_store(spark, root, manifest).collect()
    tok = token_store.load_tokenizer(token_store.default_path())
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for k, t in order:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert plain(got) == plain(want)
    store = token_store.Store(root, manifest)
    found = store.get(7)
    assert len(found) == 1 and found[0].tolist()[:-1] == tok.encode(ROWS[6][1], add_special_tokens=False).ids
    assert not store.get(99999) and len(store.get(None)) == 2 and len(store.get(71)) == 2
    empty = new_path(spark, "store")
    assert token_store.read_store(spark, empty, [tuple(r) for r in token_store.write_store(no_docs, empty).collect()]).count() == 0


def test_keyed_reads_dont_grow_with_the_shard(tmp_path):
    taken = []
    for shard, n in enumerate((10, 50_000)):
        counts = np.full(n, 5)
        token_store.write_shard(str(tmp_path), shard, np.arange(n) * 3, counts, [np.arange(5 * n) % 1000], 0, 1000, 1)
        reader = token_store.Shard(str(tmp_path), shard)
        assert reader.get(9)[0].tolist() == [15, 16, 17, 18, 19] and reader.get(10) == []
        taken.append(reader.read)
    assert taken[0] == taken[1] < 200


def test_rows_of_one_doc_id_go_over_several_shards(spark):
    rows = spark.range(300).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    root = new_path(spark, "store")
    manifest = [tuple(r) for r in token_store.write_store(rows.repartition(4), root).collect()]
    assert len(manifest) > 1 and len(token_store.Store(root, manifest).get(5)) == 300


ODD = ["a", "Bc", "é", "ñz", "×", "÷", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u0085", "\u2003", "\u3000", "\x1c", ".", ",", "!!", "#", "'s", "'ll", "'", "<|endoftext|>", "<|startoftext|>", "|>", "12", "٣", "привет", "你好", "Σ", "ς", "ẞ", "\u0301", "ª", "½", "ﬁ", ";", "_", "-", "&", "?", "$", "İ", "😀", "\x00", "\u200b"]


def test_pieces_of_odd_texts_give_the_librarys_ids():
    rng = np.random.default_rng(4)
    byte, word = token_store.Encoder(token_store.default_path()), bpe.Codec(bpe.default_path(), told=True)
    plain_byte, plain_word = bpe.load_tokenizer(token_store.default_path()), bpe.load_tokenizer(bpe.default_path())
    for _ in range(400):
        texts = ["".join(rng.choice(ODD, rng.integers(0, 14))) for _ in range(rng.integers(1, 6))]
        raw = [t.encode() for t in texts]
        ids, at = byte.encode(raw)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [plain_byte.encode(t, add_special_tokens=False).ids for t in texts]
        ids, at, told = word.encode(raw)
        want = [plain_word.encode(t, add_special_tokens=False).ids for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
        assert told == [(" ".join(map(str, w)), plain_word.decode(w, skip_special_tokens=False)) for w in want]


def test_table_keeps_its_bound_and_its_ids():
    rng = np.random.default_rng(8)
    table = common.TokenTable(lambda words: [list(w) for w in words], limit=50, describe=lambda lists: [len(x) for x in lists])
    for _ in range(30):
        texts = [" ".join("".join(rng.choice(list("abc"), rng.integers(1, 5))) for _ in range(rng.integers(0, 40))).encode() for _ in range(3)]
        block = common.Block(texts)
        ids, n, notes = table(block.raw, block.begin, block.end)
        assert bytes(ids.tolist()) == b"".join(b"".join(texts[k].split()) for k in range(3)) and n.tolist() == notes == [len(w) for t in texts for w in t.split()]
        assert np.diff(block.first).tolist() == [len(t.split()) for t in texts]
    assert table.size <= 50


@pytest.mark.parametrize("n", [1, 2, 3, 17, 2000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(10**9, n, replace=False).astype(np.int64)
    seeds, slot = token_store.build_mph(keys)
    at, _ = token_store.find_slots(keys, seeds, n)
    assert (at == slot).all() and sorted(slot) == list(range(n))


def test_near_duplicates(docs, no_docs):
    got = near_dedup.near_duplicates(docs).drop("tkey").collect()
    assert plain(got) == plain(brute.near(ROWS))
    assert near_dedup.near_duplicates(no_docs).count() == 0


def cut(prefix, **limits):
    begins, parted = near_dedup.cut_regions(np.array(prefix), np.ones(len(prefix), np.int64), **limits)
    return np.flatnonzero(begins).tolist(), parted.tolist()


def test_depth_of_a_region_follows_how_crowded_it_is():
    # few rows: three shared values do; more: four; more still: as many as part them, and by count at last
    assert cut([0, 3, 3, 0, 4]) == ([0, 3], [False] * 5)
    assert cut([0, 3, 4, 4], sparse=3) == ([0, 1], [False] * 4)
    assert cut([0, 4, 5, 4, 6], sparse=2, members=2) == ([0, 1, 3], [True] * 5)
    begins, parted = cut([0, *[7] * 8], sparse=2, members=4)
    assert begins == [0, 4, 8] and all(parted)


def test_substring_dedup(docs, no_docs):
    gone = brute.repeated(ROWS)
    want = [(k, len(g), sum(g), sha(" ".join(w for w, x in zip(brute.words(t), g) if not x))) for (k, t), g in zip(ROWS, gone)]
    assert plain(substring_dedup.digests(docs).collect()) == plain(want)
    assert substring_dedup.digests(no_docs).count() == 0
    out = substring_dedup.remove(docs)
    assert out.columns == docs.columns
    kept = Counter((r.doc_id, tuple(brute.words(r.text))) for r in out.select("doc_id", "text").collect())
    assert kept == Counter((k, tuple(w for w, x in zip(brute.words(t), g) if not x)) for (k, t), g in zip(ROWS, gone))


@pytest.mark.parametrize("name", ["HEAVY_RUNS", "HEAVY_WORDS", "LONG_RUN"])
def test_heavy_anchors_give_the_same(docs, monkeypatch, name):
    monkeypatch.setattr(substring_dedup, name, 1)
    want = [(k, sum(g)) for (k, _), g in zip(ROWS, brute.repeated(ROWS))]
    assert plain(substring_dedup.digests(docs).select("doc_id", "n_removed").collect()) == plain(want)


@pytest.mark.parametrize("change", [{"HOT_RUNS": 2, "BROADCAST_ANCHORS": 0}, {"HOT_RUNS": 2, "BROADCAST_ANCHORS": 0, "BROADCAST_ROWS": 0}])
def test_hot_runs_are_dealt_out(docs, monkeypatch, change):
    for name, to in change.items():
        monkeypatch.setattr(substring_dedup, name, to)
    want = [(k, sum(g)) for (k, _), g in zip(ROWS, brute.repeated(ROWS))]
    assert plain(substring_dedup.digests(docs).select("doc_id", "n_removed").collect()) == plain(want)


def test_passage_edited_in_many_ways(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HEAVY_RUNS", 4)
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 1 << 30, 60)]
    rows = []
    for k in range(40):
        w = [f"a{x}" for x in rng.integers(0, 1 << 30, 30)] + base + [f"b{x}" for x in rng.integers(0, 1 << 30, 30)]
        if k % 2:
            w[30 + int(rng.integers(0, 60))] = "edited"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, "word " * (200 + k)) for k in range(9)]
    want = [(k, sum(g)) for (k, _), g in zip(rows, brute.repeated(rows))]
    assert plain(substring_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_removed").collect()) == plain(want)


def test_runs_are_searched_in_indexes_without_them(monkeypatch):
    """Edited copies of passages under several anchors: least documents by brute force; no index holds a run that is streamed through it,
    matches end short of a window, and are shortened on the way."""
    rng = np.random.default_rng(8)
    runs = []
    for anchor in range(6):
        base = rng.integers(0, 1 << 60, 130).astype(np.uint64)
        for k in range(int(rng.integers(1, 12))):
            own = base.copy()
            own[rng.integers(0, 130, k % 4)] += np.uint64(1 + k)
            cut = int(rng.integers(0, 40))
            runs.append((anchor, int(rng.integers(0, 30)), own[cut : cut + int(rng.integers(50, 91))]))
    rng.shuffle(runs)
    streams = [np.asarray(r[2], np.uint64) for r in runs]
    searched, statistics, shortened = [], [], []
    least, parents = FMIndex.least_values, FMIndex._parents

    def spy(index, queries):
        searched.append(({q.tobytes() for q in index.held}, [q.tobytes() for q in queries]))
        statistics.extend(np.concatenate(index.match_lengths(queries)).tolist())
        return least(index, queries)

    build = FMIndex.__init__
    monkeypatch.setattr(FMIndex, "__init__", lambda self, sequences, *a: (setattr(self, "held", sequences), build(self, sequences, *a))[1])
    monkeypatch.setattr(FMIndex, "least_values", spy)
    monkeypatch.setattr(FMIndex, "_parents", lambda *a: (shortened.append(1), parents(*a))[1])
    got = substring_dedup.least_documents([int(r[0]) for r in runs], [int(r[1]) for r in runs], streams)
    first: dict = {}
    for (a, d, _), w in zip(runs, streams):
        for i in range(len(w) - 49):
            g = (a, w[i : i + 50].tobytes())
            first[g] = min(int(d), first.get(g, 99))
    for (a, d, _), w, m in zip(runs, streams, got):
        want = [first[a, w[i : i + 50].tobytes()] for i in range(len(w) - 49)]
        assert [min(x, int(d)) for x in m.tolist()] == [x if x < d else int(d) for x in want]
    assert searched and all(not held & set(queries) or len(queries) > len(set(queries)) for held, queries in searched)
    assert any(x < 50 for x in statistics) and any(x == 50 for x in statistics) and shortened


def test_fm_index_matches_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(40):
        w = int(rng.integers(2, 6))
        seqs = [rng.integers(0, 3, rng.integers(w, 14)).astype(np.uint64) for _ in range(rng.integers(1, 7))]
        values = rng.integers(0, 50, len(seqs))
        index = FMIndex(seqs, values, w)
        holds = lambda p: [v for s, v in zip(seqs, values) if any(s[k : k + len(p)].tolist() == p for k in range(len(s) - len(p) + 1))]  # noqa: B023, E731
        queries = seqs + [rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64) for _ in range(4)]
        for q, got in zip(queries, index.least_values(queries)):
            assert got.tolist() == [min(holds(q[i : i + w].tolist()), default=NOWHERE) for i in range(len(q) - w + 1)]
        for q, got in zip(queries, index.match_lengths(queries)):
            n = len(q)
            assert got.tolist() == [min(w, max([m for m in range(1, n + 1 - i) if holds(q[i : i + m].tolist())], default=0)) for i in range(n)]


def test_benchmark_filter(docs, no_docs, benchmark, spark):
    got = benchmark_filter.find_items(docs, benchmark).select("doc_id", "n_words", "n_hit", F.array_join("items", ",")).collect()
    assert plain(got) == plain((k, n, h, ",".join(i)) for k, n, h, i in brute.hits(ROWS, ITEMS))
    clean = benchmark_filter.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[4].strip() == "" and texts[1] is None and not brute.hits([(0, texts[11])], ITEMS[:1])[0][2]
    assert benchmark_filter.find_items(no_docs, benchmark).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert benchmark_filter.find_items(docs, none).agg(F.sum("n_hit")).first()[0] == 0


def test_item_parts_give_one_result(docs, benchmark, monkeypatch):
    whole = plain(benchmark_filter.find_items(docs, benchmark).select("doc_id", "n_hit", F.array_join("items", ",")).collect())
    texts = plain(benchmark_filter.decontaminate(docs, benchmark).select("doc_id", "text").collect())
    monkeypatch.setattr(benchmark_filter, "MAX_ITEM_BYTES", 60)
    assert len(benchmark_filter.write_automata(benchmark)[1]) > 1
    assert plain(benchmark_filter.find_items(docs, benchmark).select("doc_id", "n_hit", F.array_join("items", ",")).collect()) == whole
    assert plain(benchmark_filter.decontaminate(docs, benchmark).select("doc_id", "text").collect()) == texts


def test_many_item_parts_write_nothing_between(spark, docs, monkeypatch):
    """Twenty automata: one pass over the documents, held a few texts at a time, and no written table but the automata themselves."""
    items = [(k, " ".join(ROWS[10 + k % 20][1].split()[k : k + 12])) for k in range(25)] + list(ITEMS)
    table = spark.createDataFrame(items, "item_id long, text string")
    size = sum(len((t or "").encode()) for _, t in items)
    monkeypatch.setattr(benchmark_filter, "MAX_ITEM_BYTES", size // 19)
    monkeypatch.setattr(benchmark_filter, "HELD_BYTES", 20_000)
    before = list(common.written(spark))
    got = benchmark_filter.find_items(docs.select("doc_id", "text"), table).select("doc_id", "n_words", "n_hit", "items").collect()
    new = [t for t in common.written(spark) if t not in before]
    assert len(new) == 1 and "/automata-" in new[0]
    assert plain((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == plain((k, n, h, tuple(x)) for k, n, h, x in brute.hits(ROWS, items))


def test_coverage_limit(docs, benchmark):
    words = dict(ROWS)[20].split()
    rows = docs.filter("doc_id = 20").limit(1)
    item = lambda n: rows.sparkSession.createDataFrame([(1, " ".join(words[:n]))], "item_id long, text string")
    n = len(words)
    assert benchmark_filter.decontaminate(rows, item(int(0.9 * n))).first().text == ""
    assert benchmark_filter.decontaminate(rows, item(int(0.9 * n)), max_coverage=1.0).first().text.split() == words[int(0.9 * n) :]


def test_quality(docs, no_docs):
    got = quality.judged(quality.measures(docs)).collect()
    assert plain((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == plain((k, *brute.base_counts(t)) for k, t in ROWS)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=quality.default_path())
    by = {r.doc_id: r for r in got}
    for k in (10, 60):
        t = dict(ROWS)[k]
        ids = [i for w in brute.words(t) for i in sp.encode(w)]
        c = np.array(list(Counter(ids).values()))
        assert by[k].n_tokens == len(ids) and by[k].token_entropy == pytest.approx(-(c / c.sum() * np.log2(c / c.sum())).sum())
    assert by[1].base_failed and not by[1].kept and by[6].base_failed and not by[8].kept and by[7].kept
    assert quality.keep(docs).columns == docs.columns and quality.keep(no_docs).count() == 0


def test_scripts():
    for text, script in [("plain words", "latin"), ("привет мир как дела", "cyrillic"), ("これは日本語です", "cjk"), ("καλημέρα κόσμε", "greek"), ("", "none"), ("привет мир 12345678901234567890", "cyrillic"), ("12 34 !!", "none"), ("עברית", "other"), ("𠀀𠀁", "cjk")]:
        assert quality.letters(text)[0] == script
    assert quality.letters("éa\u0301ñ")[1] == 3


def test_word_numbers_dont_meet(spark):
    # many distinct words in one text, and three-word windows that only packed numbers would confuse
    text = " ".join(f"w{k}" for k in range(300_000)) + " x y z x y z"
    got = quality.measures(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_words == 300_006 and got.n_repeat_words == 6


def test_sharding(docs, no_docs):
    got = sharding.assign(docs, 4).collect()
    assert len(got) == len(ROWS)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == {0, 1, 2, 3}
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert plain((r.doc_id, r.size, r.text_crc32) for r in got) == plain((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in ROWS)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert len({r.shard for r in got if r.doc_id is not None and 200 <= r.doc_id < 212}) == 1
    assert sharding.assign(no_docs).count() == 0


def test_cut_edges_fall_and_quotas_hold(spark):
    rng = np.random.default_rng(3)
    text = [f"t{x}" for x in rng.zipf(1.6, 3000) % 400]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(text)], "doc_id long, text string")
    cells = rows.groupBy(F.col("text").alias("group"), F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("slice")).agg(F.count(F.lit(1)).alias("n"))
    cuts = []
    for rounds in (0, 1, None):
        state = sharding.propagate(cells, 4, 3000, rounds)
        by: dict = {}
        for r in state.collect():
            by.setdefault(r.group, Counter())[r.shard] += r.n
        links = sum(sum(c.values()) * (sum(c.values()) - 1) // 2 for c in by.values())
        cut = sum(a * b for c in by.values() for i, a in enumerate(c.values()) for b in list(c.values())[:i])
        told = sharding.cut_edges(state, "group", n="n").first()
        assert (told.links, told.cut) == (links, cut)
        cuts.append(cut)
        held = state.groupBy("shard").agg(F.sum("n").alias("n")).collect()
        if rounds == 0:
            most = max(750, *(r.n for r in held))
        assert all(r.n <= most for r in held)
    assert cuts[2] <= cuts[1] < cuts[0]


def test_cells_stay_below_a_lanes_share():
    """A group of a third of ever so many rows: its cells are far smaller than the rows a lane takes."""
    for total in (10_000, 246_000_000, 10**9, 10**12):
        lanes = max(1, total // (sharding.ROWS_PER_LANE * 16))
        assert total / 3 / sharding.slices_of(total) < max(total / 16 / lanes / 8, 2)


def test_group_larger_than_a_shard_is_split_evenly(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 150, "same").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = sharding.assign(rows, 4).collect()
    assert Counter(Counter(r.shard for r in got).values()) == Counter({100: 4})


PAGE = """<!doctype html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><a href=/>Home</a></nav><header><h2>Site</h2></header>
<div class="cookie-notice"><p>We use cookies, as everyone does, and ask you to accept them all, please.</p></div>
<div id="content"><h1>Head &amp; line</h1><p>First paragraph, with commas, and enough text to count as the main text of this page, surely.
<p>Second&nbsp;paragraph with <b>bold</b> and <a href=x>a link</a>, unclosed<div class=ad>Buy now</div><blockquote>Quoted words, kept</blockquote></div>
<aside>Side</aside><div id=comments><p>Reader says something long, really long, about all of this, and more.</p></div><form><p>Name</p></form><footer>Foot</footer></body>"""


def test_html_text(spark):
    want = "Head & line First paragraph, with commas, and enough text to count as the main text of this page, surely. Second paragraph with bold and a link, unclosed Quoted words, kept"
    deep = "<div>" * 3000 + "<p>" + "deep text, " * 20 + "</p>"
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, None, "", "x"), (4, "u", "<<<>>>&&", "x"), (5, "u", deep, "x"), (None, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    by = {r.page_id: r for r in got}
    assert by[1].text == want == by[None].text and by[1].n_chars == len(want)
    assert by[2].text == by[3].text == "" and by[5].text == " ".join(("deep text, " * 20).split())
    assert html_text.extract(pages.limit(0)).count() == 0


ARTICLE = "<p>First paragraph, with commas, and enough text to count as the main text of this page, surely.</p><p>Second one, also long enough, to be told, with more words in it.</p>"
TOLD = "Head First paragraph, with commas, and enough text to count as the main text of this page, surely. Second one, also long enough, to be told, with more words in it."


@pytest.mark.parametrize("page", [
    "<body><nav>Home</nav><div class='container has-sidebar'><div><h1>Head</h1>{}</div></div><div class=sidebar><p>Side</p></div></body>",
    "<body><div class='content-area'><div class='entry-header'><h1>Head</h1></div>{}</div></body>",
    "<body><svg class='i'/><nav>Home</nav><div id=c><h1>Head</h1>{}</div></body>",
    "<body><div id=c title=Bob's><h1>Head</h1>{}</div><div class='ad'>Buy</div></body>",
    "<body><script>var a=1;<div id=c><h1>Head</h1>{}</div></body>",
    "<body><div class='sidebar-layout sidebar'><div><h1>Head</h1>{}</div></div><div class='sidebar'>Side</div></body>",
    "<body><div id=c title=\"a>b\"><h1>Head</h1>{}</div><div id=comments><p>" + "Reader comment, long. " * 60 + "</p></div></body>",
    "<div a = 'x' b= \"y\" c =z/ ><h1>Head</h1>{}",
    "<div id=c data-x='><h1>Head</h1>{}</div>",
])
def test_html_of_many_kinds(page):
    assert html_text.main_text(page.format(ARTICLE)) == TOLD


LAYOUTS = [  # what stands around the article; every page also has a menu, a footer and reader comments
    "{}", "<article>{}</article>", "<main>{}</main>", "<form action=/x method=post>{}</form>", "<form><div id=wrapper><div class=row>{}</div></div></form>",
    "<div class='post comments-open'>{}</div>", "<div class='layout ad-free'>{}</div>", "<div class='col related-enabled'>{}</div>", "<div id=promo-wrapper>{}</div>",
    "<div aria-hidden=true>{}</div>", "<div hidden>{}</div>", "<div style='display: none'>{}</div>", "<aside>{}</aside>", "<dialog open>{}</dialog>",
    "<div class='subscribe-closed has-sidebar'><section>{}</section></div>", "<div class='sidebar'><div>{}</div></div>", "<table><tr><td>{}</td></tr></table>",
    "<div class='widget'><form><div class='promo'>{}</div></form></div>", "<section class=content><header><p>By an author</p></header>{}</section>", "<div class='newsletter-disabled'>{}<div class='ad'>Buy this</div></div>",
]


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("heading", ["<h1>Head</h1>", ""])
def test_article_of_many_layouts(layout, heading):
    comments = "<div id=comments><h2>3 comments</h2>" + "<div class=comment><p>A reader writes at length, and then some more, about this.</p></div>" * 12 + "</div>"
    page = "<!doctype html><html><head><title>T</title></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>" + layout.format(heading + ARTICLE) + f"{comments}<div class='cookie-bar'><p>We use cookies, as you may know, to make this site better for all of you.</p></div><footer>Copyright of this site, all rights reserved</footer></body></html>"
    got = html_text.main_text(page)
    want = TOLD if heading else TOLD.removeprefix("Head ")
    assert got == want or "By an author" in layout and got == f"By an author {want}"


def test_pages_without_an_article_stay_empty():
    for page in ("<form><label>Name of the user</label><input><p>Password</p><button>Go</button></form>", "<nav>Menu text that goes on and on, with commas, for far more than sixty characters of it.</nav>", "<div class=cookie-notice><p>We use cookies, and so on, on this site, for far more than sixty characters.</p></div>", "<div id=comments><p>A reader writes at length, and then some more, about all of this, and that.</p></div>"):
        assert html_text.main_text(f"<body>{page}</body>") == ""


@pytest.mark.parametrize("part", ["<ul><li>a, b", "<div><p>", "</section><div>", "<b><i>x", "<h1><b>x", "<script", "<form><div class=ad>t", "<table><tr><td>x, y", "<dl><dd>a", "<p><span>x</b>", "<title>", "<!--", "<a href='", "</p>", "<p><b>"])
def test_time_grows_with_length_however_deep(part):
    took = []
    for n in (4_000, 16_000):
        page = "<div>" + part * n
        began = time.process_time()
        html_text.main_text(page)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.3 and took[1] < 3


def test_repeated_pages_and_clashing_columns(spark):
    rows = [(1, "u", PAGE, "x", "y"), (1, "u", PAGE, "x", "y"), (1, "v", "<p>other</p>", "x", "y")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, Text string, N_Chars string")).collect()
    assert len(got) == 3 and got[0] == got[1] and got[2].text == "other"


def test_long_flat_html(spark):
    text = "long text, " * 60_000
    assert html_text.main_text(f"<body><div><p>{text}</p></div></body>") == " ".join(text.split())
    for odd in ("<p title='", "<p", "<a / b>x", "<div =x>a", "</", "<svg", "<script"):
        html_text.main_text(odd * 500)


def stump(x, y):
    """Best single split of logistic loss from the mean, by trying all."""
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = (0.0, -1, 0.0)
    for f in range(x.shape[1]):
        for c in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= c
            if min(left.sum(), (~left).sum()) >= 5:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1.0) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1.0)
                if gain > best[0] + 1e-9:
                    best = (gain, f, c)
    return best


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(9)
    for _ in range(10):
        x = rng.integers(0, 6, (80, 4)).astype(float)
        y = (rng.random(80) < 1 / (1 + np.exp(-(x[:, 1] - 2.5)))).astype(float)
        feature, cut_at, *_, value = toxicity.fit_booster(x, y, trees=1, depth=1).trees[0]
        _, f, c = stump(x, y)
        assert feature[0] == f and ((x[:, f] <= cut_at[0]) == (x[:, f] <= c)).all()
        left = x[:, f] <= c
        p = y.mean()
        for at, rows in ((1, left), (2, ~left)):
            assert value[at] == pytest.approx(0.15 * (y[rows] - p).sum() / (rows.sum() * p * (1 - p) + 1.0))


def plain_booster(x, y, trees, depth, rate=0.15, bins=32, penalty=1.0, least=5):
    """Margins of gradient-boosted trees by plain loops: every cut of every feature is tried by summing over the rows."""
    n, width = len(y), len(x[0])
    base = math.log(sum(y) / n / (1 - sum(y) / n))
    margin = [base] * n
    cuts = [sorted({float(v) for v in np.quantile([r[f] for r in x], np.linspace(0, 1, bins + 1)[1:-1])}) for f in range(width)]
    for _ in range(trees):
        q = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(q, y)], [a * (1 - a) for a in q]

        def grow(rows, level):
            gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
            best = (1e-6, None, None)
            for f in range(width) if level < depth and len(rows) >= 2 * least else ():
                for c in cuts[f]:
                    left = [i for i in rows if x[i][f] <= c]
                    if min(len(left), len(rows) - len(left)) < least:
                        continue
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    gain = gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs**2 / (hs + penalty)
                    if gain > best[0] + 1e-12:
                        best = (gain, f, c)
            if best[1] is None:
                for i in rows:
                    margin[i] -= rate * gs / (hs + penalty)
                return
            _, f, c = best
            grow([i for i in rows if x[i][f] <= c], level + 1)
            grow([i for i in rows if x[i][f] > c], level + 1)

        grow(list(range(n)), 0)
    return margin


def test_whole_ensemble_against_plain_loops():
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(150, 4)), 2)
    y = (rng.random(150) < 1 / (1 + np.exp(-(2 * x[:, 0] * (x[:, 1] > 0) + x[:, 2])))).astype(float)
    model = toxicity.fit_booster(x, y, trees=20, depth=3)
    assert len(model.trees) == 20
    assert model.margin(x).tolist() == pytest.approx(plain_booster(x.tolist(), y.tolist(), 20, 3), abs=1e-9)


def test_toxicity_of_long_and_repeated_texts(spark):
    long = "calm words " * 60_000
    docs = spark.createDataFrame([(1, long), (1, long), (2, "vile rat you"), (2, "vile rat you"), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, t) for k in (1, 3) for t in (0, 0)] + [(4, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 5 and len({(r.doc_id, r.score) for r in got}) == 3
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 5 == 0
        w = list(rng.choice(vocab, 60))
        if toxic:
            for bad in rng.choice(["vilefool", "dirtscum", "nastyrat", "meanclown"], 3):
                w.insert(int(rng.integers(0, 60)), bad)
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    rows += [(10_000, None), (10_001, ""), (None, "vilefool you dirtscum")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    gold = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, gold)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[k].predicted, t) for k, _, t in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, _, _ in labels)
    assert sum(p == t for p, t in held) / len(held) > 0.97
    # the lexicon doesn't see what calibrates
    apart = gold.withColumn("toxic", F.when(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(toxicity.CALIBRATION)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, apart).lexicon == model.lexicon
    # labels of held-out rows change nothing
    flipped = gold.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, flipped).lexicon == model.lexicon
    none = toxicity.fit(docs, gold.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} <= {0.0, 0.0005}


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    m = rng.normal(size=300)
    xs, ys = toxicity.fit_isotonic(m, (rng.random(300) < 1 / (1 + np.exp(-m))).astype(float))
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as pipeline

    # items inside a document that every stage before keeps
    item = " ".join(brute.words(dict(ROWS)[20])[12:30])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    # plain versions in a row
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=quality.default_path())
    rows = []
    for k, t in ROWS:
        n, chars, _, _, rep = brute.base_counts(t)
        ids = [i for w in brute.words(t) for i in sp.encode(w)]
        if n < 50 or 100 * rep > 50 * n:
            continue
        c = np.array(list(Counter(ids).values()))
        marked = 100 * sum(c in "éßñÉÑ" for c in t) / chars
        band = quality.BANDS["latin_plain" if marked <= 10 else "latin_marked" if marked <= 25 else "latin"]
        ok = band.min_chars_per_token <= chars / len(ids) <= band.max_chars_per_token and -(c / c.sum() * np.log2(c / c.sum())).sum() >= band.min_entropy_bits
        if ok and sum(map(sp.is_byte, ids)) / len(ids) <= band.max_byte_share:
            rows.append((k, t))
    rows = [r for r, f in zip(rows, brute.near(rows)) if f[3]]
    rows = [(k, " ".join(w for w, x in zip(brute.words(t), g) if not x)) for (k, t), g in zip(rows, brute.repeated(rows))]
    tok = bpe.load_tokenizer(bpe.default_path())
    want = []
    for k, t in rows:
        w, grams = brute.words(t), {tuple(brute.item_words(item)[i : i + 10]) for i in range(9)}
        hit = {p for i in range(len(w) - 9) if tuple(w[i : i + 10]) in grams for p in range(i, i + 10)}
        ids = tok.encode(" ".join(x for i, x in enumerate(w) if i not in hit), add_special_tokens=False).ids
        want.append((k, len(ids), sha(" ".join(map(str, ids)))))
    assert want and plain((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == plain(want)


def test_pipeline_of_an_empty_table(spark, no_docs, benchmark, tmp_path):
    import corpus_pipeline as pipeline

    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_large_run_gives_bounded_regions(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION_MEMBERS", 50)
    monkeypatch.setattr(near_dedup, "SPARSE_MEMBERS", 20)
    rows = spark.range(400).select(F.lit(7).cast("long").alias("key"), (F.col("id") % 20 + (F.lit(9) * (1 << 32))).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2"), F.col("id").alias("nid"), F.lit(3).cast("long").alias("n_shingles"))
    every = near_dedup.regions(rows.coalesce(1).sortWithinPartitions("key", "s1", "s2", "nid")).collect()
    assert sorted(r.nid for r in every) == list(range(400)) and len({r.run for r in every}) == 1 and sum(r.prev is None for r in every) == 1
    assert max(Counter(r.region for r in every).values()) <= 50


def test_language_identification(spark):
    from quillspark.llm import lang_id

    words = {"en": "the of and to in is that for", "de": "der die und das nicht mit ist von"}
    docs = spark.createDataFrame([(i, " ".join(np.random.default_rng(i).permutation(words[k].split())), k) for i, k in enumerate(["en", "de"] * 30)] + [(99, None, "en"), (None, "x", None)], "doc_id long, text string, lang string")
    page = lambda t, d: f'<html lang="{d}"><script>der die das</script><body><p>{t}</p></body></html>'
    rows = [(k, f"http://a{k % 3}.example.de/x", page("der und die von das ist nicht mit", "de"), "x") for k in range(12)]
    rows += [(k, f"http://b{k % 3}.example.org/x", page("the and that is of for in to", "en"), "x") for k in range(20, 32)]
    rows += [(40, "http://b1.example.org/y", page("der die und das ist nicht von mit", "en"), "x"), (41, "http://a0.example.de/", None, "x"), (42, None, "", "x"), (43, "http://a1.example.de/", "<p>zzz qqq</p>", "x"), (None, "u", page("the of", "en"), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, lang string")
    got = lang_id.identify(pages, docs).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[k].lang == "de" for k in (*range(12), 40, 41, 43)) and all(by[k].lang == "en" for k in range(20, 32)) and by[None].lang == "en"
    assert by[41].text_lang is None and by[42].lang in ("en", "de") and all(0 <= r.confidence <= 1 for r in got)
    assert lang_id.identify(pages.limit(0), docs).count() == 0
    assert {r.lang for r in lang_id.identify(pages, docs.limit(0)).collect()} == {None}


def plain_languages(rows, learnt):
    """Languages of pages(page_id, url, html) by plain loops."""
    from quillspark.llm import lang_id as L

    langs, number, table = learnt
    found = []
    for key, url, html in rows:
        html = html or ""
        m = L._DECLARED.search(html) or L._META.search(html)
        words = L._WORD.findall(L.unescape(L._CUT.sub(" ", html)).lower())
        ids = [number.get(w) or number.get("~" + w[-3:], 0) for w in words]
        ll = sum((table[i] for i in ids), np.zeros(len(langs))) * min(1.0, L.EFFECTIVE_WORDS / max(1, len(ids)))
        p = np.exp(ll - ll.max())
        host = (url or "").split("//")[-1].split("/")[0].lower()
        parts = host.split(".")
        found.append((key, host, ".".join(parts[-2:]) if len(parts) > 1 else "", parts[-1] if len(parts) > 1 else "", m[1].lower() if m else "", ll, p / p.sum()))

    def shares(at):
        sums: dict = {}
        for f in found:
            sums[f[at]] = sums.get(f[at], 0) + f[6]
        total = sum(sums.values())
        return {k: np.log((v + L.SMOOTH) / (total + L.SMOOTH * len(sums))) for k, v in sums.items()}

    suffix, declared, out = shares(3), shares(4), {}
    g, n = sum(f[6] for f in found), len(found)
    top = (g + L.SMOOTH) / (n + L.SMOOTH * len(langs))
    for f in found:
        domain, host = ([x for x in found if x[k] == f[k]] for k in (2, 1))
        up = (sum(x[6] for x in domain) + L.DOMAIN_WEIGHT * top) / (len(domain) + L.DOMAIN_WEIGHT)
        prior = (sum(x[6] for x in host) - f[6] + L.HOST_WEIGHT * up) / (len(host) - 1 + L.HOST_WEIGHT)
        score = f[5] + declared[f[4]] + suffix[f[3]] + np.log(np.maximum(prior, 1e-9))
        post = np.exp(score - score.max())
        out[f[0]] = (langs[int(post.argmax())], float((post / post.sum()).max()))
    return out


@pytest.mark.parametrize("hot", [2000, 2])
def test_evidence_against_plain_loops(spark, monkeypatch, hot):
    from quillspark.llm import lang_id

    monkeypatch.setattr(lang_id, "HOT_PAGES", hot)
    monkeypatch.setattr(lang_id, "HOT_HOSTS", hot)
    rng = np.random.default_rng(1)
    words = {"en": "the of and to in is that for", "de": "der die und das nicht mit ist von"}
    docs = spark.createDataFrame([(i, words[k], k) for i, k in enumerate(["en", "de"] * 20)], "doc_id long, text string, lang string")
    rows = []
    for k in range(60):
        lang = "de" if rng.random() < 0.5 else "en"
        text = " ".join(rng.choice(words[lang].split(), rng.integers(0, 6)))
        host = f"a{rng.integers(3)}.{rng.choice(['x.de', 'y.info', 'z.museum', 'localhost'])}"
        rows.append((k, f"http://{host}/p", f'<html lang="{rng.choice(["de", "en", "fr"])}"><p>{text}</p></html>' if k % 7 else f"<p>{text}</p>"))
    rows.append((99, "http://a0.x.de/", "<p>" + "der die das " * 40_000 + "</p>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = plain_languages(rows, lang_id.learn(docs))
    got = lang_id.identify(pages.unionByName(pages.filter("page_id < 0")), docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.lang == want[r.page_id][0] and r.confidence == pytest.approx(want[r.page_id][1], abs=1e-9)


def brute_kept(rows):
    return plain((r[0], r[2], r[3]) for r in brute.near(rows))


def near_kept(spark, rows):
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    return plain((r.doc_id, r.component_id, r.kept) for r in got)


def templated(n, seed, own=18):
    """Texts of one template with own words (similarity 0.745), every third one with a copy of similarity 0.757."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(1 << 40)}"
    shared, rows = [word() for _ in range(109)], []
    for k in range(n):
        mine = [word() for _ in range(own)]
        rows.append((k, " ".join(shared + mine)))
        if k % 3 == 0:
            rows.append((n + k, " ".join(shared + mine[:1] + [word() for _ in range(own - 1)])))
    return rows


@pytest.mark.parametrize("owners", [512, 0])
def test_pairs_parted_by_cuts_are_found(spark, monkeypatch, owners):
    rows = templated(300, 3)
    monkeypatch.setattr(near_dedup, "REGION_MEMBERS", 2)
    monkeypatch.setattr(near_dedup, "HOT_OWNERS", owners)
    assert near_kept(spark, rows) == brute_kept(rows)


def test_links_of_very_large_sets_are_exact():
    """Intersections times 100 that single precision can't tell apart."""
    a, b = np.arange(816_672, dtype=np.uint64), np.arange(116_667, 933_340, dtype=np.uint64)
    ids = np.array([1, 2])
    assert near_dedup.links_in(ids, ids, [a, b]) == [(1, 2)]
    assert near_dedup.links_in(ids, ids, [a, b[1:]]) == []


def test_long_near_copies_stay_together(spark):
    # three sets of 800,000 shingles are more than a region may hold
    rng = np.random.default_rng(5)
    text = rng.integers(0, 1 << 30, 800_000)
    rows = []
    for k in range(3):
        text[rng.integers(0, len(text), 3)] = rng.integers(0, 1 << 30, 3)
        rows.append((k, " ".join(map(str, text.tolist()))))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(0, 0, True), (1, 0, False), (2, 0, False)}


def test_cuts_keep_every_member_and_the_link_before(spark):
    rows = spark.range(3).select(F.lit(7).cast("long").alias("key"), F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2"), F.col("id").alias("nid"), F.lit(800_000).cast("long").alias("n_shingles"))
    got = near_dedup.regions(rows.coalesce(1)).collect()
    assert sorted(r.nid for r in got) == [0, 1, 2] and len({r.run for r in got}) == 1 and len({r.region for r in got}) == 2
    assert sorted(r.prev for r in got if r.prev is not None) == [0, 1]


@pytest.mark.parametrize("name, to", [("RUN_ROWS", 3), ("SPARSE_MEMBERS", 2), ("REGION_MEMBERS", 3)])
def test_runs_and_borders_part_no_link(spark, monkeypatch, name, to):
    monkeypatch.setattr(near_dedup, name, to)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rows = templated(60, 4)
        assert near_kept(spark, rows) == brute_kept(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_signatures_agree_as_often_as_sets(spark):
    rng = np.random.default_rng(12)
    same = []
    for _ in range(60):
        shared, a, b = (rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) for n in (300, 50, 50))
        sig = near_dedup.signatures([np.unique(np.concatenate([shared, x])) for x in (a, b)])
        same.append(sig[0] == sig[1])
    same = np.array(same)
    assert abs(same.mean() - 0.75) < 0.02
    assert abs(same.reshape(60, -1, 4).all(2).mean() - 0.75**4) < 0.04


def test_text_that_is_no_prose_is_rejected(spark):
    import base64
    import string

    rng = np.random.default_rng(1)
    soup = lambda letters, low=2, high=9: " ".join("".join(rng.choice(list(letters), rng.integers(low, high + 1))) for _ in range(300))
    rows = [(1, soup(string.ascii_lowercase)), (2, soup(string.ascii_lowercase + string.digits)), (3, soup(string.punctuation)), (4, "\n".join(base64.b64encode(rng.bytes(57)).decode() for _ in range(80)))]
    prose = """The committee met on Thursday to discuss the annual budget, and most of the members agreed that spending on roads should rise while
    other costs are held level for another year. A smaller group wanted new schools first, because the old ones near the river have been too
    small since the mill was turned into flats. They will vote again in spring, once the figures for winter are known."""
    german = """Der Ausschuss trat am Donnerstag zusammen, um den jährlichen Haushalt zu besprechen, und die meisten Mitglieder waren sich einig, dass
    die Ausgaben für Straßen steigen sollten, während andere Kosten gleich bleiben. Eine kleinere Gruppe wollte zuerst neue Schulen bauen, weil
    die alten am Fluss zu klein sind, seit in der Mühle Wohnungen entstanden. Im Frühjahr wird noch einmal abgestimmt."""
    rows += [(5, prose), (6, german)]
    rows += [(10 + k, p) for k, p in enumerate((RUSSIAN, POLISH, TURKISH, VIETNAMESE, CHINESE, GREEK))]
    rows += [(20 + k, soup(sorted({c for c in p.lower() if c.isalpha()}))) for k, p in enumerate((RUSSIAN, POLISH, TURKISH, VIETNAMESE))]
    got = {r.doc_id: r for r in quality.judged(quality.measures(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {k for k, r in got.items() if r.kept} == {5, 6, *range(10, 16)}


RUSSIAN = "Комитет собрался в четверг, чтобы обсудить годовой бюджет, и большинство его членов согласилось, что расходы на дороги должны вырасти, а остальные останутся на прежнем уровне ещё на год. Небольшая группа хотела сначала построить новые школы, потому что старые у реки стали тесными с тех пор, как на мельнице сделали квартиры. Весной они проголосуют снова, когда будут известны данные за зиму."
POLISH = "Komisja zebrała się w czwartek, aby omówić roczny budżet, a większość jej członków zgodziła się, że wydatki na drogi powinny wzrosnąć, podczas gdy inne koszty pozostaną na tym samym poziomie przez kolejny rok. Mniejsza grupa chciała najpierw nowych szkół, ponieważ stare nad rzeką są za małe, odkąd młyn zamieniono na mieszkania."
TURKISH = "Komite yıllık bütçeyi görüşmek için perşembe günü toplandı ve üyelerin çoğu yol harcamalarının artması, diğer giderlerin ise bir yıl daha aynı düzeyde kalması gerektiği konusunda anlaştı. Daha küçük bir grup önce yeni okullar istedi, çünkü nehir kıyısındaki eski okullar değirmen dairelere dönüştürüldüğünden beri çok küçük kaldı. İlkbaharda kış rakamları belli olunca yeniden oylama yapacaklar."
VIETNAMESE = "Ủy ban họp vào thứ năm để thảo luận ngân sách hằng năm, và hầu hết các thành viên đồng ý rằng chi tiêu cho đường sá nên tăng trong khi các chi phí khác giữ nguyên thêm một năm nữa. Một nhóm nhỏ hơn muốn xây trường học mới trước, vì những trường cũ gần sông đã quá nhỏ kể từ khi nhà máy xay được chuyển thành căn hộ."
CHINESE = "委员会 星期四 开会 讨论 年度 预算 大多数 成员 同意 道路 支出 应该 增加 而 其他 费用 再 保持 一年 不变 一个 较小 的 小组 希望 先 建 新 学校 因为 河边 的 旧 学校 自从 磨坊 改成 公寓 以来 已经 太小 了 他们 将 在 春天 再次 投票 那时 冬天 的 数字 就 知道 了"
GREEK = "Η επιτροπή συνεδρίασε την Πέμπτη για να συζητήσει τον ετήσιο προϋπολογισμό, και τα περισσότερα μέλη συμφώνησαν ότι οι δαπάνες για τους δρόμους πρέπει να αυξηθούν, ενώ τα άλλα έξοδα θα μείνουν στο ίδιο επίπεδο για έναν ακόμη χρόνο. Μια μικρότερη ομάδα ήθελε πρώτα νέα σχολεία, επειδή τα παλιά κοντά στο ποτάμι είναι πολύ μικρά από τότε που ο μύλος έγινε διαμερίσματα."
