"""Ranked lexical search by a hierarchical tree of maxima over document ranges.

The documents of a task are cut into ranges; each range keeps, for the terms that the queries ask for, its documents' term
frequencies. Above the documents stands a tree: leaves of LEAF documents, then FANOUT children a node; a node holds, for each
term, the greatest impact that the term has in any of its documents. The summed bounds of a query's terms at a node are never
below the score of a document under it, so a best-first descent opens the node of the highest sum, and stops where no sum
reaches the k-th best score found; nodes of an equal sum are opened while they may hold a smaller doc_id.

The roots of the ranges are the tree's upper part: the ranges of the highest sums are searched first, over the whole corpus,
and the k-th best scores found there are a floor for all other ranges. So what tasks report doesn't grow with their number.

Terms are known by 64-bit hashes. Queries are taken in blocks of about BLOCK_TERMS terms; each block is one pass over the
documents. A null or empty text has no terms, neither as document nor as item; rows that repeat a doc_id are documents of
their own, a null doc_id comes after all others of its score; items that repeat an item_id are ranked each for itself; extra
columns don't matter; a very long text is one document; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .benchmark_filter import FOLD
from .common import U64, bounds, documents, map_arrow, span_hashes, text_blocks, write_table

K = 50
#: Terms, with repeats among items, of one block of queries.
BLOCK_TERMS = 200_000
#: Documents and postings at which a range ends.
RANGE_DOCS, RANGE_POSTINGS = 4096, 1 << 20
LEAF, FANOUT = 8, 8
#: Ranges that are searched first for an item.
FIRST_RANGES = 4
#: Rows of the table of ranges in one Arrow batch; a row is a range.
RANGE_ROWS = 8
#: Bits of the filter that a word's hash passes before it is looked up.
FILTER_BITS = 20


# --------------------------------------------------------------------------- words and queries
def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words laid end to end, bounds of each text's words)."""
    raw = b" ".join(texts).translate(FOLD)
    values = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff((values != 32).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    begin, end = edges[::2], edges[1::2]
    starts = bounds([len(t) + 1 for t in texts])[:-1]
    return span_hashes(values, begin, end), np.append(np.searchsorted(begin, starts), len(begin))


class Queries:
    """A block of items: their distinct terms by number, and the terms of each."""

    def __init__(self, texts: list[bytes]) -> None:
        hashes, at = word_hashes(texts)
        each = [np.unique(hashes[p:q]) for p, q in zip(at[:-1].tolist(), at[1:].tolist())]
        self.hashes = np.unique(np.concatenate(each)) if each else np.zeros(0, U64)
        self.terms = [np.searchsorted(self.hashes, x) for x in each]
        self.flat, self.at = np.concatenate(self.terms) if each else np.zeros(0, np.int64), bounds([len(x) for x in each])
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> U64(64 - FILTER_BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words that are terms, numbers of the terms)."""
        maybe = np.flatnonzero(self.filter[hashes >> U64(64 - FILTER_BITS)])
        number = np.searchsorted(self.hashes, hashes[maybe])
        good = self.hashes[np.minimum(number, len(self.hashes) - 1)] == hashes[maybe]
        return maybe[good], number[good]


# --------------------------------------------------------------------------- ranges
RANGE = "range_id long, n_docs long, n_words long, lengths array<long>, sizes array<int>, terms array<int>, tfs array<long>, held array<int>, dfs array<long>"


def ranges(docs: DataFrame, queries) -> DataFrame:
    """A row for each range of docs(doc_id, text): counts over all its documents; doc_id, length, number of postings and postings of
    those that hold a term, in order of doc_id; the terms held, with document frequencies. queries: broadcast Queries."""
    key = docs.schema["doc_id"]
    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(key.dataType)), *T._parse_datatype_string(RANGE).fields])
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, number = queries.value, TaskContext.get().partitionId() << 33
        n_terms = len(asked.hashes)
        parts: list[tuple] = []
        n_docs = n_words = held = postings = 0

        def row() -> pa.RecordBatch:
            ids = pa.concat_arrays([p[0] for p in parts]) if parts else pa.array([], key_type)
            length, sizes, terms, tfs = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(1, 5))
            order = pc.array_sort_indices(ids, null_placement="at_end").to_numpy().astype(np.int64)
            first = bounds(sizes)
            take = np.arange(len(terms)) + np.repeat(first[order] - bounds(sizes[order])[:-1], sizes[order])
            df = np.bincount(terms, minlength=n_terms)
            some = np.flatnonzero(df)
            values = [ids.take(pa.array(order)), number, n_docs, n_words, length[order], sizes[order], terms[take], tfs[take], some, df[some]]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) if np.isscalar(v) else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v, f.type.value_type)) for v, f in zip(values, arrow)], schema=arrow)

        for b in batches:
            for part, texts in text_blocks(b):
                hashes, at = word_hashes(texts)
                length = np.diff(at)
                n_docs, n_words = n_docs + int((length > 0).sum()), n_words + int(length.sum())
                place, term = asked.find(hashes)
                doc = np.searchsorted(at, place, side="right") - 1
                pair, tf = np.unique(doc * n_terms + term, return_counts=True)
                sizes = np.bincount(pair // n_terms, minlength=len(texts)) if len(pair) else np.zeros(len(texts), np.int64)
                some = np.flatnonzero(sizes)
                parts.append((part.column("doc_id").take(pa.array(some)), length[some], sizes[some], pair % n_terms, tf))
                held, postings = held + len(some), postings + len(pair)
                if held >= RANGE_DOCS or postings >= RANGE_POSTINGS:
                    yield row()
                    parts.clear()
                    number, n_docs, n_words, held, postings = number + 1, 0, 0, 0, 0
        if n_docs:
            yield row()

    key_type = arrow.field("doc_ids").type.value_type
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """What a term's weight is multiplied with, for postings of documents of these lengths."""
    if len(length) and int(length.max()) * 50 * n_docs >= 1 << 63:
        m = np.array([50 + 50 * int(x) * n_docs // n_words for x in length], np.int64)
    else:
        m = 50 + 50 * length * n_docs // n_words
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[first - first[0]])


class Tree:
    """The tree over one range. levels: from the leaves up, (bounds of each node's entries, terms, greatest impacts)."""

    def __init__(self, doc_ids: list, length: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_terms: int, n_docs: int, n_words: int) -> None:
        self.doc_ids, self.terms = doc_ids, terms.astype(np.int64)
        self.first = bounds(sizes)
        self.impact = impacts(tfs, np.repeat(length, sizes), n_docs, n_words)
        self.n_terms = n_terms
        self.root = np.zeros(n_terms, np.int64)
        np.maximum.at(self.root, self.terms, self.impact)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.opened = 0

    def grow(self) -> None:
        """Build the nodes; the root's maxima are there from the start."""
        node, term, high, nodes = np.repeat(np.arange(len(self.doc_ids)) // LEAF, np.diff(self.first)), self.terms, self.impact, -(-len(self.doc_ids) // LEAF)
        while True:
            key = node * self.n_terms + term
            order = np.argsort(key, kind="stable")
            key = key[order]
            begin = np.flatnonzero(np.diff(key, prepend=-1))
            key, high = key[begin], np.maximum.reduceat(high[order], begin)
            node, term = key // self.n_terms, key % self.n_terms
            self.levels.append((np.searchsorted(node, np.arange(nodes + 1)), term, high))
            if nodes == 1:
                return
            node, nodes = node // FANOUT, -(-nodes // FANOUT)

    def search(self, terms: np.ndarray, weight: np.ndarray, best: list[tuple], k: int, floor: int) -> None:
        """Put the documents among the k best into the heap `best` of (score, -doc_id); `weight` holds the weights of all terms of the
        query by number, and 0 for all others. floor: no lower score is wanted."""
        if not self.levels:
            self.grow()
        top = len(self.levels) - 1
        wait = [(-int((self.root[terms] * weight[terms]).sum()), 0, top, 0)]
        while wait:
            bound, at, level, node = heapq.heappop(wait)
            if not self._wanted(-bound, at, best, k, floor):
                if len(best) == k and -bound < best[0][0] or -bound < floor:
                    return
                continue
            self.opened += 1
            if level:
                first, terms_at, high = self.levels[level - 1]
                p, q = node * FANOUT, min((node + 1) * FANOUT, len(first) - 1)
                own = slice(first[p], first[q])
                for child, b in enumerate(_sums(weight[terms_at[own]] * high[own], first[p : q + 1]).tolist(), p):
                    at = child * LEAF * FANOUT ** (level - 1)
                    if b > 0 and self._wanted(b, at, best, k, floor):
                        heapq.heappush(wait, (-b, at, level - 1, child))
                continue
            p, q = node * LEAF, min((node + 1) * LEAF, len(self.doc_ids))
            own = slice(self.first[p], self.first[q])
            scores = _sums(weight[self.terms[own]] * self.impact[own], self.first[p : q + 1])
            for d in np.flatnonzero(scores >= max(floor, 1, best[0][0] if len(best) == k else 0)).tolist():
                found = (int(scores[d]), self._order(p + d))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)

    def _order(self, at: int) -> float | int:
        """Greater is better: smaller doc_ids, null last."""
        doc = self.doc_ids[at]
        return -math.inf if doc is None else -doc

    def _wanted(self, bound: int, at: int, best: list[tuple], k: int, floor: int) -> bool:
        """Whether documents from place `at` on, of this score at most, may still be among the best."""
        return bound >= floor and (len(best) < k or (bound, self._order(at)) > best[0])


class Task:
    """What a worker needs besides the ranges: queries, weights of terms and the corpus's counts."""

    def __init__(self, queries, weight: np.ndarray, n_docs: int, n_words: int) -> None:
        self.queries, self.weight, self.n_docs, self.n_words = queries, weight, n_docs, n_words

    def trees(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Tree, np.ndarray]]:
        """(range, its tree, the sums at its root for each item)."""
        asked = self.queries.value
        for b in batches:
            for i in range(b.num_rows):
                column = lambda c: b.column(c)[i].values  # noqa: B023, E731
                length, sizes, terms, tfs = (column(c).to_numpy() for c in ("lengths", "sizes", "terms", "tfs"))
                tree = Tree(column("doc_ids").to_pylist(), length, sizes, terms, tfs, len(self.weight), self.n_docs, self.n_words)
                yield b.column("range_id")[i].as_py(), tree, np.diff(np.concatenate([[0], np.cumsum((tree.root * self.weight)[asked.flat])])[asked.at])

    def search(self, tree: Tree, item: int, best: list[tuple], k: int, floor: int, dense: np.ndarray) -> None:
        terms = self.queries.value.terms[item]
        dense[terms] = self.weight[terms]
        tree.search(terms, dense, best, k, floor)
        dense[terms] = 0


def _small_rows(df: DataFrame, func, schema: str | T.StructType) -> DataFrame:
    return map_arrow(df, lambda batches: func(b.slice(i, RANGE_ROWS) for b in batches for i in range(0, b.num_rows, RANGE_ROWS)), schema)


def root_sums(table: DataFrame, task: Task) -> DataFrame:
    """item, range_id, bound: the sums at the roots, where they are above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, sums in task.trees(batches):
            some = np.flatnonzero(sums > 0)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(np.full(len(some), number), pa.int64()), pa.array(sums[some], pa.int64())], names=["item", "range_id", "bound"])

    return _small_rows(table, run, "item long, range_id long, bound long")


def searched(table: DataFrame, task: Task, k: int, chosen: dict[int, list[int]] | None = None, floors: np.ndarray | None = None) -> DataFrame:
    """item, doc_id, score: of each task's ranges the k best documents for each item. chosen: the items that a range is searched for
    (none: all); floors: score below which nothing is wanted, by item."""
    doc_type = table.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())])
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        dense = np.zeros(len(task.weight), np.int64)
        for number, tree, sums in task.trees(batches):
            low = np.ones(len(sums), np.int64) if floors is None else np.maximum(floors, 1)
            items = np.flatnonzero(sums >= low).tolist() if chosen is None else chosen.get(number, [])
            for item in items:
                task.search(tree, item, best.setdefault(item, []), k, int(low[item]), dense)
        for item, found in best.items():
            if found:
                rows = sorted(found, reverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(rows), pa.int64()), pa.array([None if d == -math.inf else -d for _, d in rows], arrow.field("doc_id").type), pa.array([s for s, _ in rows], pa.int64())], names=schema.names)

    return _small_rows(table, run, schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def term_weights(dfs: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in dfs.tolist()], np.int64)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of docs(doc_id, text) for each of items(item_id, text), scores above 0 alone."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    asked = items.select("item_id", text.alias("text"))
    total = asked.agg(F.sum(F.octet_length("text") / 4)).first()[0] or 0  # a word and the mark after it have four bytes or so
    n_blocks = int(total // BLOCK_TERMS) + 1
    out = None
    for block in range(n_blocks):
        own = asked if n_blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        found = _search_block(docs, own, k)
        out = found if out is None else out.unionByName(found)
    return out


def _search_block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    rows = items.collect()
    queries = spark.sparkContext.broadcast(Queries([r.text.encode() for r in rows]))
    schema = T.StructType([items.schema["item_id"], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())])
    if not len(queries.value.hashes):
        return spark.createDataFrame([], schema)
    table = write_table(spark, ranges(docs, queries), "ranges")
    n_docs, n_words = table.agg(F.sum("n_docs"), F.sum("n_words")).first()
    if not n_docs:
        return spark.createDataFrame([], schema)
    dfs = np.zeros(len(queries.value.hashes), np.int64)
    for r in table.select(F.explode(F.arrays_zip("held", "dfs")).alias("x")).groupBy("x.held").agg(F.sum("x.dfs").alias("df")).collect():
        dfs[r.held] = r.df
    task = Task(queries, np.where(dfs > 0, term_weights(dfs, n_docs), 0), n_docs, n_words)
    # the ranges whose roots have the highest sums, a few for each item
    first = Window.partitionBy("item").orderBy(F.desc("bound"), "range_id")
    chosen: dict[int, list[int]] = {}
    for r in root_sums(table, task).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= FIRST_RANGES).collect():
        chosen.setdefault(r.range_id, []).append(r.item)
    floors = np.zeros(len(rows), np.int64)
    seeds = spark.createDataFrame([(x,) for x in chosen] or [], "range_id long")
    for r in ranked(searched(table.join(F.broadcast(seeds), "range_id", "left_semi"), task, k, chosen), k).filter(F.col("rank") == k).collect():
        floors[r.item] = r.score
    best = ranked(searched(table, task, k, floors=floors), k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.LongType()), items.schema["item_id"]]))
    return best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format(t="text")} AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest({_WORDS.format(t="text")}) AS t FROM benchmark),
c AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_words FROM d WHERE len(w) > 0),
asked AS (SELECT DISTINCT t FROM b),
p AS (SELECT doc_id, r, n, t, count(*) AS tf FROM (SELECT doc_id, r, len(w) AS n, unnest(w) AS t FROM d) JOIN asked USING (t) GROUP BY doc_id, r, n, t),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS wt FROM p, c GROUP BY t, n_docs),
scores AS (
  SELECT item_id, doc_id, r, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + CAST((50 * n * n_docs) // n_words AS BIGINT))))) AS BIGINT) AS score
  FROM b JOIN p USING (t) JOIN weights USING (t), c GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""
