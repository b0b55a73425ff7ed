"""Removal of passages that repeat across documents, found with compressed FM-indexes.

A window is WINDOW consecutive words; every word of a window that also starts in a document of smaller doc_id goes. Text is
dealt to index shards by content: the least hash among the grams of a window (of GRAMS[0] words) is its anchor, and a run is a
maximal row of windows of one anchor. Equal windows have equal anchors, so they meet in one shard, and anchors of one
document alone (most of all text) leave before anything is indexed, and so do runs that no other run shares an anchor with: their
copies have one least document. Each shard indexes runs of earlier documents (see fm_index) and streams the runs of later
ones through by backward search: the matching statistics say where a match reaches WINDOW words, and its interval of rows gives
the least doc_id that holds the window. No run is searched in an index that holds it: the runs of an anchor are numbered
in order of their least documents, and for each binary digit of the numbers those with a 1 are streamed through an index of
those with a 0, so each run meets every earlier one. Copies of a run, thousands of them or a third of the corpus, are one run.

An index takes a bounded number of words. Where an anchor has more (a passage edited in ever so many ways, one word
repeated for ever), its windows are dealt anew by longer grams, at last by themselves: then an anchor is one window.

Null and empty texts have no words; documents with a null doc_id have no order among others, so nothing is removed from
or because of them; rows of equal doc_id don't remove from each other; repeated rows are treated alike. Extra columns are
carried through by remove(), those with names that are used here too. A very long text is many runs, and is hashed in
segments; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Block, bounds, documents, drop_tables, fanout, join_hot, map_arrow, mix64, powers, release, set_aside, text_blocks, text_key, write_table
from .fm_index import FMIndex

WINDOW = 50
#: Words of the grams that anchors are chosen from: each length but the last for the anchors of too many words at the one before.
GRAMS = (8, 24, WINDOW)
#: Words of the runs in one index; distinct runs, their words and the windows of one run that an anchor may have.
SHARD_WORDS = 300_000
HEAVY_RUNS, HEAVY_WORDS, LONG_RUN = 5_000, SHARD_WORDS, 2_000
#: Copies of a run from which on they are dealt to several tasks, and the share of all runs that says the same.
HOT_RUNS, HOT_SHARE = 2_000, 5_000
#: Windows of a run that are dealt anew at once.
PIECE = 100_000
#: Ids of documents, and anchors, that may be broadcast, 8 bytes each; beyond that a shuffled join is used.
BROADCAST_ROWS, BROADCAST_ANCHORS = 250_000, 1_000_000



class Sums:
    """Hash of any range of a word array, the same wherever the range lies."""

    def __init__(self, words: np.ndarray) -> None:
        power, self.back = powers(len(words))
        self.total = np.zeros(len(words) + 1, U64)
        np.cumsum(mix64(words) * power[: len(words)], out=self.total[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.total[end] - self.total[begin]) * self.back[begin] + (end - begin).astype(U64) * U64(0xD1B54A32D192ED03))


def runs_of(words: np.ndarray, sizes: np.ndarray, gram: int = GRAMS[0], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(text, first word within it, number of windows, anchor, content) of every run of the texts laid end to end. With grams as
    long as a window, every window is a run."""
    n = len(words)
    at = bounds(sizes)
    left = np.repeat(at[1:], sizes) - np.arange(n)
    valid = np.flatnonzero(left >= window)
    if not len(valid):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
    sums = Sums(words)
    g = sums(np.arange(n - gram + 1), np.arange(gram, n + 1))
    span, size = window - gram + 1, 1
    low = g
    while size * 2 <= span:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    low = low[valid]
    owner = np.repeat(np.arange(len(sizes)), sizes)[valid]
    new = np.ones(len(valid), bool)
    if gram < window:
        new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(valid)))
    begin = valid[first]
    return owner[first], begin - at[owner[first]], count, low[first], sums(begin, begin + count + window - 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x, pa.int64())


RUN = "doc_id long, tkey long, start int, n int, anchor long, content long"


def _run_batch(doc_id: np.ndarray, tkey: np.ndarray, start: np.ndarray, n: np.ndarray, anchor: np.ndarray, content: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_signed(doc_id), _signed(tkey), pa.array(start, pa.int32()), pa.array(n, pa.int32()), _signed(anchor), _signed(content)], names=["doc_id", "tkey", "start", "n", "anchor", "content"])


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, start, n, anchor, content of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_blocks(b):
                words = Block(texts)
                owner, start, n, anchor, content = runs_of(words.hashes, np.diff(words.first))
                if len(owner):
                    keys = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                    yield _run_batch(keys[owner], np.array([text_key(t) for t in texts], np.int64)[owner], start, n, anchor, content)

    return map_arrow(docs.filter("doc_id is not null").select("doc_id", "text"), run, RUN)


def run_words(docs: DataFrame) -> DataFrame:
    """docs(text, wanted array<struct<anchor, content, least, start, n>>) -> anchor, content, least, words of each wanted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_blocks(b):
                block = Block(texts)
                hashes, found, size = block.hashes, [], 0
                for first, wanted in zip(block.first.tolist(), part.column("wanted").to_pylist()):
                    for w in wanted:
                        words = hashes[first + w["start"] : first + w["start"] + w["n"] + WINDOW - 1]
                        found.append((w["anchor"], w["content"], w["least"], words.tobytes()))
                        size += len(words)
                        if size > 200_000:
                            yield batch(found)
                            found, size = [], 0
                if found:
                    yield batch(found)

    def batch(found: list[tuple]) -> pa.RecordBatch:
        a, c, v, w = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(v, pa.int64()), pa.array(w, pa.binary())], names=["anchor", "content", "least", "words"])

    return map_arrow(docs, run, "anchor long, content long, least long, words binary")


def least_documents(anchors: list[int], least: list[int], streams: list[np.ndarray]) -> list[np.ndarray]:
    """The least document that holds each window of each run, among the runs of the same anchor. A digit of the runs' numbers at a time,
    runs are streamed through an index of earlier ones."""
    order = sorted(range(len(streams)), key=lambda k: (anchors[k], least[k]))
    mins = [np.full(len(s) - WINDOW + 1, v, np.int64) for s, v in zip(streams, least)]
    number, size, first = {}, {}, 0
    for i, k in enumerate(order):
        if anchors[k] != anchors[order[first]]:
            first = i
        number[k] = i - first
        size[anchors[k]] = i - first + 1
    for digit in range((max(size.values()) - 1).bit_length()):
        several = [k for k in order if size[anchors[k]] > 1 << digit]
        held = [k for k in several if not number[k] >> digit & 1]
        asked = [k for k in several if number[k] >> digit & 1]
        index = FMIndex([streams[k] for k in held], np.array([least[k] for k in held], np.int64), WINDOW)
        for k, found in zip(asked, index.least_values([streams[k] for k in asked])):
            np.minimum(mins[k], found, out=mins[k])
    return mins


def search(contents: DataFrame) -> DataFrame:
    """contents(anchor, content, least, words), sorted by anchor in each partition -> anchor, content, mins: least doc_id of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def close() -> pa.RecordBatch:
            mins = least_documents([h[0] for h in held], [h[2] for h in held], [h[3] for h in held])
            lists = pa.ListArray.from_arrays(pa.array(bounds([len(m) for m in mins]), pa.int32()), pa.array(np.concatenate(mins), pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), lists], names=["anchor", "content", "mins"])

        for b in batches:
            for anchor, content, least, words in zip(*(b.column(c).to_pylist() for c in ("anchor", "content", "least", "words"))):
                if anchor != last and size >= SHARD_WORDS:
                    yield close()
                    held, size = [], 0
                last = anchor
                held.append((anchor, content, least, np.frombuffer(words, U64)))
                size += len(words) // 8
        if held:
            yield close()

    return map_arrow(contents, run, "anchor long, content long, mins array<long>")


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, spans array<struct<start, n>>: the windows to remove, for the documents that have some."""
    spark = docs.sparkSession
    every = write_table(spark, runs(docs), "runs")
    anchors = write_table(spark, every.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("copies")).filter("lo < hi").select("anchor", "copies"), "anchors")
    # few enough anchors go to the runs; else both are dealt by anchor
    met = every.join(F.broadcast(anchors.select("anchor")), "anchor", "left_semi") if anchors.count() <= BROADCAST_ANCHORS else join_hot(every, anchors.select("anchor"), ["anchor"], hot_keys(anchors, ["anchor"]), ["doc_id", "start"])
    shared = write_table(spark, met, "shared-runs")
    drop_tables(spark, every, anchors)
    release(spark)
    # one row for each distinct run, of its least document
    distinct = write_table(spark, shared.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "tkey", "start", "n")).alias("f"), F.count(F.lit(1)).alias("copies")), "distinct-runs")
    parts = fanout(spark, shared)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tkey"))

    def words_of(runs: DataFrame, few: bool) -> DataFrame:
        wanted = runs.groupBy(F.col("f.doc_id").alias("doc_id"), F.col("f.tkey").alias("tkey")).agg(F.collect_list(F.struct("anchor", "content", F.col("f.doc_id").alias("least"), F.col("f.start").alias("start"), F.col("f.n").alias("n"))).alias("wanted"))
        rows = keyed
        if few:  # texts of few documents: the others stay where they are
            ids = write_table(spark, wanted.select("doc_id").distinct(), "holders")
            tables.append(ids)
            rows = keyed.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi")
        return run_words(rows.join(wanted, ["doc_id", "tkey"]).select("text", "wanted"))

    tables: list[DataFrame] = []
    several = write_table(spark, sizes_of(distinct, "anchor", "f.n"), "anchor-sizes")
    heavy = several.filter("heavy").select("anchor")
    heavy = None if heavy.isEmpty() else heavy
    # the only run of an anchor: all its windows have one least document, told once
    alone = distinct.join(several, "anchor", "left_anti").select("anchor", "content", F.array("f.doc_id").alias("mins"))
    found = [searched(words_of(distinct.join(several.filter("not heavy"), "anchor", "left_semi"), True), parts)]
    release(spark)
    if heavy is not None:
        # repeated rows give a run twice
        contents = write_table(spark, words_of(distinct.join(heavy, "anchor", "left_semi"), True).dropDuplicates(["anchor", "content"]), "heavy-runs")
        found.append(finer(contents, GRAMS[1:], parts))
        drop_tables(spark, contents)
        release(spark)
    told = reduce(DataFrame.unionByName, found).select("anchor", "content", F.when(F.array_min("mins") == F.array_max("mins"), F.array(F.array_min("mins"))).otherwise(F.col("mins")).alias("mins"))
    least = told.unionByName(alone).dropDuplicates(["anchor", "content"])  # repeated rows give a run twice
    met = join_hot(shared, least, ["anchor", "content"], hot_keys(distinct, ["anchor", "content"]), ["doc_id", "start"]).filter(F.array_min("mins") < F.col("doc_id"))
    part = F.transform(F.filter(F.sequence(F.lit(0), F.size("mins") - 1), lambda k: F.get("mins", k) < F.col("doc_id")), lambda k: F.struct((F.col("start") + k).alias("start"), F.lit(1).alias("n")))
    whole = F.array(F.struct(F.col("start").alias("start"), F.col("n").alias("n")))
    spans = met.select("doc_id", "tkey", F.when(F.array_max("mins") < F.col("doc_id"), whole).otherwise(part).alias("s"))
    out = write_table(spark, spans.groupBy("doc_id", "tkey").agg(F.flatten(F.collect_list("s")).alias("spans")), "removals")
    drop_tables(spark, shared, distinct, several, *found, *tables)
    release(spark)
    return out


def sizes_of(distinct: DataFrame, anchor: str, n: str) -> DataFrame:
    """Anchors of distinct(anchor, n) with more than one run, and whether they have more than one index takes (heavy)."""
    per = distinct.groupBy(anchor).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col(n).cast("long") + WINDOW - 1).alias("w"), F.max(n).alias("longest"))
    return per.filter("c > 1").select(anchor, ((F.col("c") > HEAVY_RUNS) | (F.col("w") > HEAVY_WORDS) | (F.col("longest") > LONG_RUN)).alias("heavy"))


def heavy_anchors(distinct: DataFrame, anchor: str, n: str) -> DataFrame | None:
    """The heavy anchors of distinct(anchor, n); None if there are none."""
    spark = distinct.sparkSession
    out = write_table(spark, sizes_of(distinct, anchor, n).filter("heavy").select(anchor), "heavy-anchors")
    if out.isEmpty():
        drop_tables(spark, out)
        return None
    return out


def searched(words: DataFrame, parts: int) -> DataFrame:
    """anchor, content, mins of words(anchor, content, least, words), a written table; a run that is there twice is told twice."""
    dealt = words.repartition(parts, "anchor").sortWithinPartitions("anchor", "content")
    return write_table(words.sparkSession, search(dealt), "least-documents")


def finer(contents: DataFrame, grams: tuple[int, ...], parts: int) -> DataFrame:
    """anchor, content, mins of contents(anchor, content, least, words) whose anchors have too many words for an index: their windows are
    dealt by longer grams, and the least documents of the finer runs are put together again. Works on distinct runs alone,
    texts aren't read again. With grams as long as a window every anchor has one run."""
    spark, gram = contents.sparkSession, grams[0]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for anchor, content, least, raw in zip(*(b.column(c).to_pylist() for c in ("anchor", "content", "least", "words"))):
                words = np.frombuffer(raw, U64)
                for p in range(0, len(words) - WINDOW + 1, PIECE):
                    cut = words[p : p + PIECE + WINDOW - 1]
                    _, start, n, a, c = runs_of(cut, np.array([len(cut)]), gram)
                    same = lambda v: pa.array(np.full(len(n), v), pa.int64())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(anchor), same(content), same(least), pa.array(p + start, pa.int32()), pa.array(n, pa.int32()), _signed(a), _signed(c)], names=["anchor", "content", "least", "start", "n", "anchor2", "content2"])

    runs2 = write_table(spark, map_arrow(contents, split, "anchor long, content long, least long, start int, n int, anchor2 long, content2 long"), "finer-runs")
    distinct = write_table(spark, runs2.groupBy("anchor2", "content2").agg(F.min(F.struct("least", "anchor", "content", "start", "n")).alias("f"), F.count(F.lit(1)).alias("copies")), "distinct-runs")
    several = distinct.groupBy("anchor2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor2")
    meet = write_table(spark, distinct.join(several, "anchor2", "left_semi"), "meeting-runs")
    # the only run of an anchor holds its windows alone
    alone = distinct.join(several, "anchor2", "left_anti").select("anchor2", "content2", F.array_repeat("f.least", F.col("f.n")).alias("mins"))

    def words_of(rows: DataFrame) -> DataFrame:
        wanted = rows.groupBy("f.anchor", "f.content").agg(F.collect_list(F.struct("anchor2", "content2", F.col("f.least").alias("least"), F.col("f.start").alias("start"), F.col("f.n").alias("n"))).alias("wanted"))
        return map_arrow(contents.join(wanted, ["anchor", "content"]).select("words", "wanted"), cut_words, "anchor long, content long, least long, words binary")

    heavy = heavy_anchors(meet, "anchor2", "f.n") if len(grams) > 1 else None
    named = lambda df: df.select(F.col("anchor").alias("anchor2"), F.col("content").alias("content2"), "mins")
    found = [searched(words_of(meet if heavy is None else meet.join(heavy, "anchor2", "left_anti")), parts)]
    if heavy is not None:
        deeper = write_table(spark, words_of(meet.join(heavy, "anchor2", "left_semi")), "heavy-runs")
        found.append(finer(deeper, grams[1:], parts))
        drop_tables(spark, heavy, deeper)
    mins = reduce(DataFrame.unionByName, [alone, *map(named, found)])
    met = join_hot(runs2, mins, ["anchor2", "content2"], hot_keys(distinct, ["anchor2", "content2"]), ["content", "start"])
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "mins"))), lambda x: x["mins"]))
    out = write_table(spark, met.groupBy("anchor", "content").agg(whole.alias("mins")), "least-documents")
    drop_tables(spark, runs2, distinct, meet, *found)
    release(spark)
    return out


def cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words, wanted) -> anchor, content, least, words of each wanted run."""
    for b in batches:
        for raw, wanted in zip(b.column("words").to_pylist(), b.column("wanted").to_pylist()):
            words = np.frombuffer(raw, U64)
            for k in range(0, len(wanted), CUT_ROWS):
                found = [(w["anchor2"], w["content2"], w["least"], words[w["start"] : w["start"] + w["n"] + WINDOW - 1].tobytes()) for w in wanted[k : k + CUT_ROWS]]
                anchor, content, least, cut = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(content, pa.int64()), pa.array(least, pa.int64()), pa.array(cut, pa.binary())], names=["anchor", "content", "least", "words"])


#: Runs cut out at once.
CUT_ROWS = 2_000


def hot_keys(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than HOT_RUNS copies and more than 1 in HOT_SHARE of all, so at most HOT_SHARE of them, with the tasks they are
    dealt to."""
    total = counted.agg(F.sum("copies")).first()[0] or 0
    per = max(HOT_RUNS, total // HOT_SHARE)
    return counted.filter(F.col("copies") > per).select(*keys, F.ceil(F.col("copies") / per).cast("int").alias("parts"))


def _removed(n: int, spans: list[dict]) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    for s in spans:
        edge[s["start"]] += 1
        edge[min(n, s["start"] + s["n"] + WINDOW - 1)] -= 1
    return np.cumsum(edge[:n]) > 0


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with `spans` (null where nothing is removed). Texts of documents that stay whole aren't shuffled where the ids of the others
    are few enough to broadcast."""
    spark = docs.sparkSession
    spans = removals(docs)
    own = docs.columns
    keyed = docs.withColumn("tkey", F.xxhash64("text"))
    ids = write_table(spark, spans.select("doc_id").distinct(), "shortened")
    if ids.count() > BROADCAST_ROWS:
        return keyed.join(spans, ["doc_id", "tkey"], "left").select(*own, "spans")
    cut = keyed.join(F.broadcast(ids), "doc_id", "left_semi").join(spans, ["doc_id", "tkey"], "left").select(*own, "spans")
    return cut.unionByName(docs.join(F.broadcast(ids), "doc_id", "left_anti").select(*own, F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, texts in text_blocks(b):
                n_words, n_removed, sums = [], [], []
                for raw, spans in zip(texts, rows.column("spans").to_pylist()):
                    words = raw.split()
                    n_words.append(len(words))
                    if spans:
                        gone = _removed(len(words), spans)
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    n_removed.append(n_words[-1] - len(words))
                    sums.append(hashlib.sha256(b" ".join(words)).hexdigest())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sums, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_arrow(with_spans(docs.select("doc_id", "text")), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame) -> DataFrame:
    """docs with their texts without the repeated words; what stands between kept words stays as it is."""
    docs, named_back = set_aside(docs, ("spans", "tkey"))
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, texts in text_blocks(b):
                column, out = rows.column("text"), []
                for k, (raw, spans) in enumerate(zip(texts, rows.column("spans").to_pylist())):
                    if not spans:
                        out.append(column[k].as_py())
                        continue
                    words = Block([raw])
                    gone = np.flatnonzero(np.diff(_removed(len(words.begin), spans).astype(np.int8), prepend=0, append=0))
                    kept, last = [], 0
                    for p, q in zip(words.begin[gone[::2]].tolist(), words.end[gone[1::2] - 1].tolist()):
                        kept.append(raw[last:p])
                        last = q
                    out.append(b"".join([*kept, raw[last:]]).decode())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else rows.column(c) for c in names], names=names)

    return named_back(map_arrow(with_spans(docs), run, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, sha256(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT h, min(doc_id) AS lo FROM g GROUP BY h),
r AS (SELECT g.doc_id, g.i FROM g JOIN m USING (h) WHERE m.lo < g.doc_id),
x AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM r),
k AS (SELECT doc_id, list(p) AS ps FROM x GROUP BY doc_id),
o AS (SELECT d.doc_id, w, coalesce(ps, []) AS ps FROM d LEFT JOIN k USING (doc_id)),
u AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM o),
s AS (SELECT u.doc_id, string_agg(t, ' ' ORDER BY u.p) AS t FROM u LEFT JOIN x ON x.doc_id = u.doc_id AND x.p = u.p WHERE x.p IS NULL GROUP BY u.doc_id)
SELECT o.doc_id, CAST(len(o.w) AS BIGINT) AS n_words, CAST(len(o.ps) AS BIGINT) AS n_removed, sha256(coalesce(s.t, '')) AS kept_sha256 FROM o LEFT JOIN s USING (doc_id)
"""
