"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all benchmark items build one suffix automaton; document words stream through it, each step
keeping the longest match that ends at the word. A match of `window` words is an occurrence of a window, and an item
shorter than that matches as a whole. The spans so hit are removed where they pass a length or coverage limit.

The automaton's size is linear in the items' words. Over MAX_ITEM_BYTES of text the items are dealt into parts by a hash of
their id; a task then holds HELD_BYTES of its documents and streams them through one part's automaton after the other, so
the documents are read once, and nothing is written between, whatever the number of parts. Each automaton is built once,
in a task, and read from the shared folder; items never pass through the driver.

Nulls and empty texts have no words; an item without words is ignored; items with equal texts are all reported; repeated
rows and extra columns of documents are carried through; a very long text is streamed in parts, whole; an empty table of
documents or of items gives no hits.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, documents, map_arrow, new_path, open_folder, raw_texts, set_aside, worker_object, written

WINDOW = 10
#: Bytes of item text in one automaton (about 100 MB of a worker).
MAX_ITEM_BYTES = 1 << 20
#: Text that a task holds while the automata of several parts take turns.
HELD_BYTES = 32 << 20
#: Over this share of hit words a document holds little else, and its whole text goes.
MAX_COVERAGE = 0.8
#: A-Z to a-z; bytes that are no part of a word to a space. Every byte stays one byte, so positions are kept.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class ItemAutomaton:
    """Generalised suffix automaton over item words, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        split = [(key, [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]) for key, text in items]
        split = [(key, ids) for key, ids in split if ids]
        for _, ids in split:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.keys = [key for key, _ in split]
        #: State of a window's words -> numbers of the items that hold the window.
        self.window_at: dict[int, list[int]] = {}
        #: State of a short item's words -> lengths and numbers of items; other lengths of the state don't count.
        self.short_at: dict[int, list[tuple[int, int]]] = {}
        for number, (_, ids) in enumerate(split):
            v = size = 0
            for c in ids:
                v, size = self._step(v, size, c)
                if size >= window:
                    held = self.window_at.setdefault(self._at(v, window), [])
                    if not held or held[-1] != number:
                        held.append(number)
            if len(ids) < window:
                self.short_at.setdefault(v, []).append((len(ids), number))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _step(self, v: int, size: int, c: int) -> tuple[int, int]:
        nxt, link = self.next, self.link
        while v and c not in nxt[v]:
            v = link[v]
            size = self.length[v]
        if c in nxt[v]:
            return nxt[v][c], size + 1
        return 0, 0

    def _at(self, v: int, size: int) -> int:
        """State of the suffix of `size` words."""
        while self.length[self.link[v]] >= size:
            v = self.link[v]
        return v

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(hit spans [begin, end) merged and in order, items with an occurring window)."""
        get, nxt, link, length, window, short = self.vocab.get, self.next, self.link, self.length, self.window, self.short_at
        spans: list[list[int]] = []
        met: set[int] = set()  # states of windows; their items are looked up once
        few: set[int] = set()
        v = size = 0
        for i, w in enumerate(words):
            c = get(w)
            if c is None:
                v = size = 0
                continue
            while v and c not in nxt[v]:
                v = link[v]
                size = length[v]
            to = nxt[v].get(c)
            if to is None:
                v = size = 0
                continue
            v, size = to, size + 1
            reach = 0
            if size >= window:
                met.add(self._at(v, window))
                reach = window
            if short:
                u = v
                while u > 0:
                    for n, number in short.get(u, ()):
                        if n <= size:
                            few.add(number)
                            reach = max(reach, n)
                    u = link[u]
            if reach:
                begin = i + 1 - reach
                if spans and begin <= spans[-1][1]:
                    while spans and begin <= spans[-1][1]:
                        begin = min(begin, spans.pop()[0])
                spans.append([begin, i + 1])
        for state in met:
            few.update(self.window_at[state])
        return [(a, b) for a, b in spans], {self.keys[k] for k in few}


def write_automata(benchmark: DataFrame, window: int = WINDOW) -> tuple[str, list[int]]:
    """(folder, parts): one automaton for each part of the items, built in a task of its own."""
    spark = benchmark.sparkSession
    root = new_path(spark, "automata")
    written(spark).append(root)
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // MAX_ITEM_BYTES) + 1
    part = F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text", part.alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, attempt = None, [], TaskContext.get().taskAttemptId()

        def close() -> pa.RecordBatch:
            fs, folder = open_folder(root)
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/{now}.{attempt}") as f:
                f.write(pickle.dumps(ItemAutomaton(held, window), pickle.HIGHEST_PROTOCOL))
            fs.move(f"{folder}/{now}.{attempt}", f"{folder}/{now}")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32())], names=["part"])

        for b in batches:
            for key, text, k in zip(b.column("item_id").to_pylist(), raw_texts(b.column("text")), b.column("part").to_pylist()):
                if k != now and held:
                    yield close()
                    held = []
                now = k
                held.append((key, text))
        if held:
            yield close()

    parts = map_arrow(items.repartition(n, "part").sortWithinPartitions("part", "item_id"), run, "part int").collect()  # a number a part
    return root, sorted(r.part for r in parts)


def read_automaton(root: str, part: int) -> ItemAutomaton:
    fs, folder = open_folder(root)
    with fs.open_input_file(f"{folder}/{part}") as f:
        return pickle.loads(f.read())


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p, q in sorted(spans):
        if out and p <= out[-1][1]:
            out[-1] = (out[-1][0], max(q, out[-1][1]))
        else:
            out.append((p, q))
    return out


MINE = {"n_words": T.LongType(), "n_hit": T.LongType(), "spans": T.ArrayType(T.LongType()), "items": T.ArrayType(T.StringType())}


Told = Callable[[pa.RecordBatch, list[bytes], list[int], list[list[tuple[int, int]]], list[list[str]]], list[pa.Array]]


def _held(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Blocks of rows whose texts sum to about `limit` bytes."""
    held, size = [], 0
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()
        for i, j in blocks(lengths):
            held.append(b.slice(i, j - i))
            size += sum(lengths[i:j])
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def _scan(docs: DataFrame, benchmark: DataFrame, window: int, schema: T.StructType, told: Told) -> DataFrame:
    """docs through every part's automaton in one pass; told(rows, texts, n_words, spans, items) gives the columns of `schema`."""
    root, parts = write_automata(benchmark, window)
    limit = HELD_BYTES if len(parts) > 1 else 1  # one automaton: block by block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, limit):
            found: list[list[tuple[int, list, set]]] = [[] for _ in held]
            for part in parts or [None]:
                auto = ItemAutomaton([], window) if part is None else worker_object(("items", root, part), lambda: read_automaton(root, part))  # noqa: B023
                for k, rows in enumerate(held):
                    new = []
                    for text in raw_texts(rows.column("text")):
                        words = words_of(text)
                        new.append((len(words), *auto.matches(words)))
                    found[k] = [(n, _merged([*x, *y]) if x and y else x or y, a | b) for (n, x, a), (_, y, b) in zip(found[k], new)] if found[k] else new
            for rows, of in zip(held, found):
                n_words, spans, items = zip(*of)
                yield pa.RecordBatch.from_arrays(told(rows, raw_texts(rows.column("text")), list(n_words), list(spans), [sorted(x) for x in items]), names=schema.names)

    return map_arrow(docs, run, schema)


def _columns(n_words: list[int], spans: list, items: list[list[str]]) -> list[pa.Array]:
    return [pa.array(n_words, pa.int64()), pa.array([sum(q - p for p, q in s) for s in spans], pa.int64()), pa.array([[x for pq in s for x in pq] for s in spans], pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit, spans (begin and end of each hit run of words, flat) and items (sorted ids); own columns of these
    names give way."""
    keep = [f for f in docs.schema if f.name not in MINE]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, *[T.StructField(k, t) for k, t in MINE.items()]])
    return _scan(docs.select(*names), benchmark, window, schema, lambda rows, texts, n, spans, items: [*(rows.column(c) for c in names), *_columns(n, spans, items)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_length: int = 1, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """docs with their texts without the hit spans of `min_length` words or more; over a hit share of `max_coverage` the whole
    text goes. The columns are those of docs."""
    docs, named_back = set_aside(docs, MINE)
    names = docs.columns

    def clean(rows: pa.RecordBatch, texts: list[bytes], n_words: list[int], spans: list, items: list) -> list[pa.Array]:
        old, out = rows.column("text"), []
        for k, (raw, n, found) in enumerate(zip(texts, n_words, spans)):
            if not found:
                out.append(old[k].as_py())
            elif sum(q - p for p, q in found) > max_coverage * n:
                out.append("")
            else:
                out.append(cut(raw, [(p, q) for p, q in found if q - p >= min_length]).decode())
        return [pa.array(out, pa.string()) if c == "text" else rows.column(c) for c in names]

    return named_back(_scan(docs, benchmark, window, docs.schema, clean))


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them; the parts around keep their own marks."""
    folded = text.translate(FOLD)
    at, begins, ends = 0, [], []
    for w in folded.split():
        i = folded.index(w, at)
        begins.append(i)
        ends.append(at := i + len(w))
    out, last = [], 0
    for p, q in spans:
        out.append(text[last : begins[p]])
        last = ends[q - 1]
    out.append(text[last:])
    return b"".join(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(t="text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format(t="text")} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, 10 AS n, array_to_string(w[i:i+9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)
  UNION ALL
  SELECT item_id, len(w) AS n, array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 9),
sizes AS (SELECT DISTINCT n FROM grams),
occ AS (
  SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, occ.n, item_id FROM occ JOIN grams USING (g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
