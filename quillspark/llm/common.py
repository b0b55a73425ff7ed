"""What the training-data operators share: shared-folder tables, code shipping, words and tables of encoded words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.shipping import ship_code

#: Text handled at once inside a task; bounds the arrays and objects alive whatever the Arrow batch holds.
BLOCK_BYTES = 512 << 10
#: Entries of a worker's table of encoded words before it starts anew (about 50 bytes each).
MAX_ENCODED = 300_000
#: Words looked up at once, so that one very long text doesn't grow the table beyond its bound.
LOOKUP_WORDS = 100_000

#: Rows of one Arrow batch in the operators' own jobs, where the session keeps Spark's default of 10,000: rows here are whole texts.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

U64 = np.uint64


# --------------------------------------------------------------------------- session
def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine does for a
    local session (tests); a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        sc = spark.sparkContext
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = sc._quill_shared = getattr(sc, "_quill_shared", None) or "file://" + tempfile.mkdtemp(prefix="quill-shared-")
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quill/{name}-{uuid.uuid4().hex[:12]}"


def write_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back with the same schema."""
    path = new_path(spark, name)
    schema = df.schema
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._quill_path = path
    written(spark).append(path)
    return out


def written(spark: SparkSession) -> list[str]:
    """Paths of the tables written and not deleted so far, in order."""
    sc = spark.sparkContext
    if not hasattr(sc, "_quill_tables"):
        sc._quill_tables = []
    return sc._quill_tables


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches for a job that runs inside; the caller's setting is put back."""
    old = spark.conf.get(_BATCH)
    if old == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, old)


def drop_tables(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete written tables that nothing reads any more."""
    jvm, live = spark.sparkContext._jvm, written(spark)
    for t in tables:
        name = t if isinstance(t, str) else t._quill_path
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if name in live:
            live.remove(name)


def open_folder(root: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and folder of a path below shared_dir, for what isn't Parquet."""
    if "://" in root or root.startswith("file:"):
        return pafs.FileSystem.from_uri(root if "://" in root else "file://" + root[5:])
    return pafs.LocalFileSystem(), root


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, spread: list[str]) -> DataFrame:
    """Inner join with the rows of hot keys dealt to several tasks: hot(keys, parts) is small enough to broadcast, and `right`, with
    few rows a key, is repeated for each part."""
    hot = F.broadcast(hot.select(*keys, F.col("parts").alias("_parts")))
    one = F.coalesce("_parts", F.lit(1))
    dealt = left.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*spread), one)).drop("_parts")
    each = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), one.cast("long") - 1))).drop("_parts")
    return dealt.join(each, [*keys, "_part"]).drop("_part")


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner remove the shuffle files of finished jobs now instead of at the driver's next GC."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fanout(spark: SparkSession, df: DataFrame) -> int:
    """Partitions for a shuffle that carries df whole: the session's setting, or df's own splits if those are more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --------------------------------------------------------------------------- Arrow helpers
def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(sizes: list[int], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes sum to about `limit` bytes (one row at least)."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def text_blocks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, their texts) in blocks of a bounded number of bytes; only one block's texts are Python objects at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, j in blocks(sizes):
        part = batch.slice(i, j - i)
        yield part, raw_texts(part.column(column))


def _trim() -> None:
    """Give freed memory back to the machine: idle workers stay alive beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, func: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _asked.clear()
        yield from func(batches)
        if not _asked:  # another kind of stage: what earlier ones kept isn't wanted any more
            _kept.clear()
        _trim()

    return df.mapInArrow(run, schema)


def text_key(raw: bytes) -> int:
    """What Spark's xxhash64 gives for a string, so that rows are found again in a plan."""
    from xxhash import xxh64_intdigest

    k = xxh64_intdigest(raw, 42)
    return k - (1 << 64) if k >= 1 << 63 else k


def set_aside(docs: DataFrame, taken: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with own columns of taken names renamed, and what names them back."""
    low = {t.lower() for t in taken}
    clash = [c for c in docs.columns if c.lower() in low]
    if not clash:
        return docs, lambda df: df
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in clash}), lambda df: df.withColumnsRenamed({f"__own_{c}": c for c in clash})


# --------------------------------------------------------------------------- words
def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_kept: dict = {}
_asked: set = set()


def worker_object(key: tuple, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps from task to task, one at a time, until a task asks for another or for none: tables of
    encoded words gain from every task."""
    _asked.add(key)
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Value of each byte in a word's hash.
_BYTE = np.random.default_rng(20240301).integers(1, 2**64, 256, dtype=U64)
#: Bytes of text, or words, hashed at once.
SEGMENT = 1 << 19
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, mod 2**64. A worker keeps those of a segment."""

    def make(m: int) -> list[np.ndarray]:
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(m + 1, base, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p, out=p))
        return out

    if n > 2 * SEGMENT:
        return tuple(make(n))
    if not _powers:
        _powers.extend(make(2 * SEGMENT))
    return _powers[0], _powers[1]


_LENGTH = U64(0xD1B54A32D192ED03)


def span_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[begin:end] for spans in order of place that don't overlap, the same wherever a span lies.
    `values` are bytes."""
    out = np.empty(len(begin), U64)
    at = 0
    while at < len(begin):
        upto = max(at + 1, int(np.searchsorted(end, begin[at] + SEGMENT, side="right")))
        p, q = int(begin[at]), int(end[upto - 1])
        power, back = powers(q - p)
        total = np.zeros(q - p + 1, U64)
        np.cumsum(_BYTE[values[p:q]] * power[: q - p], out=total[1:])
        b, e = begin[at:upto] - p, end[at:upto] - p
        out[at:upto] = (total[e] - total[b]) * back[b]
        at = upto
    return mix64(out + (end - begin).astype(U64) * _LENGTH)


#: 1 for bytes of words, 0 for the six white characters.
_INSIDE = bytes(0 if c == 32 or 9 <= c <= 13 else 1 for c in range(256))


class Block:
    r"""Words ([^\x20\x09-\x0D]+) of some texts laid end to end, without a Python object a word: `begin` and `end` in `raw`,
    `first` (bounds of each text's words) and 64-bit `hashes`."""

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        raw = b" ".join(texts)
        self.raw = raw.lower() if lower else raw  # of bytes: A-Z only
        inside = np.frombuffer(raw.translate(_INSIDE), np.int8)
        edges = np.flatnonzero(np.diff(inside, prepend=np.int8(0), append=np.int8(0)))
        self.begin, self.end = edges[::2], edges[1::2]
        starts = bounds([len(t) + 1 for t in texts])[:-1]
        self.first = np.append(np.searchsorted(self.begin, starts), len(self.begin))

    @property
    def hashes(self) -> np.ndarray:
        return span_hashes(np.frombuffer(self.raw, np.uint8), self.begin, self.end)


_MARK = np.isin(np.arange(256), np.frombuffer(b"!#$%&*.,;:?", np.uint8))
_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 for c in range(256)])


def mark_cuts(raw: np.ndarray) -> np.ndarray:
    """Places of the marks that come right after a letter of ASCII or Latin-1: the split patterns of both BPE vocabularies always
    part there."""
    at = np.flatnonzero(_MARK[raw])
    at = at[at > 0]
    last, lead = raw[at - 1], raw[np.maximum(at - 2, 0)]
    return at[_LETTER[last] | ((lead == 0xC3) & (last >= 0x80) & (last < 0xC0) & (last != 0x97) & (last != 0xB7) & (at >= 2))]


def marks_apart(raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, bounds of each word's pieces): words cut at their marks (see mark_cuts)."""
    cuts = mark_cuts(np.frombuffer(raw, np.uint8))
    if not len(begin):
        return begin, end, np.zeros(1, np.int64)
    word = np.searchsorted(begin, cuts, side="right") - 1
    return np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([end, cuts])), bounds(1 + np.bincount(word, minlength=len(begin)))


class TokenTable:
    """Distinct-word table: each distinct word is encoded once, its ids are joined back by position. Words are known by their
    64-bit hashes, in arrays with open addressing; a table beyond `limit` words starts anew."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], limit: int = MAX_ENCODED, describe: Callable[[list[list[int]]], list] | None = None) -> None:
        self.encode, self.limit, self.describe = encode, limit, describe
        self._clear()

    def _clear(self) -> None:
        self.size = 0
        self._slots(1 << max(10, (2 * min(self.limit, 1 << 24)).bit_length()))
        self.ids, self.n_ids = np.zeros(1 << 16, np.int32), 0
        self.start, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        #: What `describe` says of each word's ids.
        self.notes: list = []

    def _slots(self, n: int) -> None:
        self.keys, self.at, self.shift = np.zeros(n, U64), np.full(n, -1, np.int32), U64(64 - (n.bit_length() - 1))

    def _find(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> self.shift).astype(np.int64)
        out = self.at[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (len(self.at) - 1)
            found = self.at[slot]
            out[todo] = found
            more = (found >= 0) & (self.keys[slot] != h[todo])
            todo, slot = todo[more], slot[more]
        return out

    def _insert(self, h: np.ndarray, rows: np.ndarray) -> None:
        slot, todo = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = self.at[slot] < 0
            self.at[slot[free]] = rows[todo[free]]
            placed = self.at[slot] == rows[todo]  # of several that want one slot the last stays
            self.keys[slot[placed]] = h[todo[placed]]
            todo, slot = todo[~placed], (slot[~placed] + 1) & (len(self.at) - 1)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _rows(self, raw: bytes, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = self._find(hashes)
        miss = np.flatnonzero(at < 0)
        if not len(miss):
            return at
        fresh, first = np.unique(hashes[miss], return_index=True)
        if self.size and self.size + len(fresh) > self.limit:
            self._clear()
            return self._rows(raw, begin, end, hashes)
        where = miss[first]
        lists = self.encode([raw[b:e] for b, e in zip(begin[where].tolist(), end[where].tolist())])
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.int32, int(n.sum()))
        old, new = self.size, self.size + len(fresh)
        self.ids = self._room(self.ids, self.n_ids + len(flat))
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.start, self.count = self._room(self.start, new), self._room(self.count, new)
        self.start[old:new], self.count[old:new] = self.n_ids + np.cumsum(n) - n, n
        self.n_ids, self.size = self.n_ids + len(flat), new
        if self.describe:
            self.notes.extend(self.describe(lists))
        if 2 * new > len(self.at):
            kept = self.at >= 0
            h, rows = self.keys[kept], self.at[kept]
            self._slots(1 << (4 * new).bit_length())
            self._insert(h, rows)
        self._insert(fresh, np.arange(old, new, dtype=np.int32))
        at[miss] = old + np.searchsorted(fresh, hashes[miss])
        return at

    def __call__(self, raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """(ids of all words in order, number of ids of each word, notes of each word if there are notes)."""
        hashes = span_hashes(np.frombuffer(raw, np.uint8), begin, end)
        out, counts, notes = [], [], []
        for k in range(0, len(begin), LOOKUP_WORDS):
            part = slice(k, k + LOOKUP_WORDS)
            at = self._rows(raw, begin[part], end[part], hashes[part])
            n = self.count[at].astype(np.int64)
            total = int(n.sum())
            out.append(self.ids[np.arange(total) + np.repeat(self.start[at] - (np.cumsum(n) - n), n)])
            counts.append(n)
            if self.describe:
                notes += map(self.notes.__getitem__, at.tolist())
        if not out:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), []
        return np.concatenate(out), np.concatenate(counts), notes


def bounds(counts: np.ndarray | list[int]) -> np.ndarray:
    """0 and the running sums."""
    return np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))]).astype(np.int64)


def long(c: str) -> F.Column:
    return F.col(c).cast("long")
