"""Token-id files with a minimal perfect hash index.

Documents are dealt by ranges of doc_id into shards, so the ids of the whole corpus lie in ascending doc_id order. A shard
file holds the raw ids (two bytes each where the vocabulary allows it, else four) and an index: a minimal perfect hash over
the shard's distinct keys (hash and displace; a bucket of one key names its slot) gives a slot, the slot holds a
fingerprint of the key, its first row and its number of rows. A keyed read is one hash, one slot and one slice.

Layout, little endian: 8 bytes magic, the numbers of HEAD, then the parts: ids, row_end (uint64, 0 and the running sums),
row_key (int64), seeds (int32), slots (fingerprint uint32, rows uint32, first uint64). A keyed read takes the head, one seed,
one slot, the ends of its rows and one slice of ids, whatever the size of the shard; the manifest's key bounds name the
shard. Files are written under a task-attempt name and renamed, so a lost or repeated task leaves one whole file.

A null doc_id comes first, as Spark sorts it, under a key of its own; repeated doc_ids are rows of one key in the order of
their texts, and may go over several shards; null and empty texts hold the end id alone; a very long text is one row, looked
up in parts. Only doc_id and text are read, so extra columns don't matter. An empty table makes no rows.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_characters, load_tokenizer
from .common import TokenTable, bounds, documents, fanout, map_arrow, mark_cuts, mix64, new_path, open_folder, small_batches, text_blocks, worker_object

MAGIC = b"QUILLTK2"
END_ID = 2
#: Stands for a null doc_id in row_key; flagged in the header, so a real row may have the same key.
NULL_KEY = np.iinfo(np.int64).min
KEYS_PER_BUCKET = 3
TRIES = 64
SLOT = np.dtype([("fingerprint", "<u4"), ("rows", "<u4"), ("first", "<u8")])
#: Letters of the common Latin ranges.
LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u01bf"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --------------------------------------------------------------------------- minimal perfect hash
def _hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket hash, position hash, fingerprint."""
    k = keys.astype(np.int64).view(np.uint64)
    a, b = mix64(k + np.uint64(0x9E3779B97F4A7C15)), mix64(k ^ np.uint64(0xD1B54A32D192ED03))
    return a, b, (mix64(a + b) >> np.uint64(32)).astype(np.uint32)


def _place(b: np.ndarray, d: np.ndarray | int, n: int) -> np.ndarray:
    """Position of position hashes under displacement d; each d hashes anew, so no two keys meet at all of them."""
    return (mix64(b + mix64(np.full(len(b), d, np.uint64) if np.isscalar(d) else d)) % np.uint64(n)).astype(np.int64)


def build_mph(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds of the buckets, slot of each key) for distinct keys. Largest buckets are placed first."""
    n = len(keys)
    m = n // KEYS_PER_BUCKET + 1
    a, b, _ = _hashes(keys)
    bucket = (a % np.uint64(m)).astype(np.int64)
    seeds, slot, taken = np.zeros(m, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=m)
    begin = bounds(size)
    singles: list[int] = []
    for x in np.argsort(-size, kind="stable").tolist():
        k = order[begin[x] : begin[x + 1]]
        if len(k) == 0:
            break
        if len(k) == 1:
            singles.append(x)
            continue
        d = 0
        while True:  # TRIES displacements at a time
            tries = np.repeat(np.arange(d, d + TRIES, dtype=np.uint64), len(k))
            rows = _place(np.tile(b[k], TRIES), tries, n).reshape(TRIES, len(k))
            good = ~taken[rows].any(1) & (np.diff(np.sort(rows, 1), axis=1) > 0).all(1)
            if good.any():
                d += int(good.argmax())
                at = rows[good.argmax()]
                break
            d += TRIES
        taken[at] = True
        slot[k], seeds[x] = at, d
    free = np.flatnonzero(~taken)
    for x, at in zip(singles, free.tolist()):
        slot[order[begin[x]]], seeds[x] = at, -at - 1
    return seeds, slot


def find_slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, fingerprint) of each key; a key that was not indexed gets a slot whose fingerprint differs (but 1 in 2**32)."""
    a, b, f = _hashes(keys)
    d = seeds[(a % np.uint64(len(seeds))).astype(np.int64)].astype(np.int64)
    return np.where(d < 0, -d - 1, _place(b, np.maximum(d, 0).astype(np.uint64), max(n, 1))), f


# --------------------------------------------------------------------------- files
def _file(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:06d}.ids"


#: After the magic: these numbers, 8 bytes each.
HEAD = ("rows", "keys", "null_rows", "ids", "buckets", "width", "row_end", "row_key", "seeds", "slots")
HEAD_BYTES = len(MAGIC) + 8 * len(HEAD)
#: Bytes of ids read at once when a shard is read whole.
READ_BYTES = 8 << 20


def write_shard(root: str, shard: int, keys: np.ndarray, counts: np.ndarray, payload: list[np.ndarray], null_rows: int, vocab: int, attempt: int) -> None:
    """keys in ascending order, nulls first as NULL_KEY; counts: ids of each row."""
    fs, folder = open_folder(root)
    fs.create_dir(folder, recursive=True)
    first = np.concatenate([[null_rows], null_rows + 1 + np.flatnonzero(np.diff(keys[null_rows:]))]) if len(keys) > null_rows else np.zeros(0, np.int64)
    distinct = keys[first.astype(np.int64)]
    seeds, slot = build_mph(distinct)
    slots = np.zeros(len(distinct), SLOT)
    slots["fingerprint"][slot] = _hashes(distinct)[2]
    slots["first"][slot] = first
    slots["rows"][slot] = np.diff(np.append(first, len(keys)))
    dtype = "<u2" if vocab <= 1 << 16 else "<u4"
    parts = {"row_end": bounds(counts).astype("<u8").tobytes(), "row_key": keys.astype("<i8").tobytes(), "seeds": seeds.astype("<i4").tobytes(), "slots": slots.tobytes()}
    n_ids = int(counts.sum())
    width = np.dtype(dtype).itemsize
    head = {"rows": len(keys), "keys": len(distinct), "null_rows": null_rows, "ids": n_ids, "buckets": len(seeds), "width": width}
    at = HEAD_BYTES + n_ids * width
    for k, v in parts.items():
        head[k] = at
        at += len(v)
    temp = f"{_file(folder, shard)}.{attempt}"
    with fs.open_output_stream(temp) as f:
        f.write(MAGIC + np.array([head[k] for k in HEAD], "<u8").tobytes())
        for x in payload:
            f.write(x.astype(dtype).tobytes())
        for v in parts.values():
            f.write(v)
    fs.move(temp, _file(folder, shard))


class Shard:
    """Reader of one shard file: by key, with a few small reads whatever the shard's size is, and whole. `read` counts bytes."""

    def __init__(self, root: str, shard: int) -> None:
        fs, folder = open_folder(root)
        self.file, self.read = fs.open_input_file(_file(folder, shard)), 0
        head = self._bytes(0, HEAD_BYTES)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"not a shard file: {_file(folder, shard)}")
        self.head = dict(zip(HEAD, np.frombuffer(head, "<u8", offset=len(MAGIC)).tolist()))
        self.dtype = np.dtype("<u2" if self.head["width"] == 2 else "<u4")

    def _bytes(self, at: int, n: int) -> bytes:
        self.read += n
        return self.file.read_at(n, at)

    def _part(self, name: str, dtype: str | np.dtype, begin: int, n: int) -> np.ndarray:
        """n values of a part from `begin` on."""
        dtype = np.dtype(dtype)
        return np.frombuffer(self._bytes(self.head[name] + begin * dtype.itemsize, n * dtype.itemsize), dtype)

    def ids(self, begin: int, end: int) -> np.ndarray:
        w = self.dtype.itemsize
        return np.frombuffer(self._bytes(HEAD_BYTES + begin * w, (end - begin) * w), self.dtype)

    def get(self, key: int | None) -> list[np.ndarray]:
        """Ids of each row of a key: one seed, one slot, the ends of its rows and one slice of ids are read."""
        first, n = 0, self.head["null_rows"]
        if key is not None:
            if not self.head["keys"]:
                return []
            a, b, f = _hashes(np.array([key], np.int64))
            seed = int(self._part("seeds", "<i4", int(a[0] % np.uint64(self.head["buckets"])), 1)[0])
            at = -seed - 1 if seed < 0 else int(_place(b, seed, self.head["keys"])[0])
            slot = self._part("slots", SLOT, at, 1)[0]
            if slot["fingerprint"] != f[0]:
                return []
            first, n = int(slot["first"]), int(slot["rows"])
        if not n:
            return []
        ends = self._part("row_end", "<u8", first, n + 1).astype(np.int64)
        ids = self.ids(int(ends[0]), int(ends[-1]))
        return np.split(ids, (ends[1:-1] - ends[0]).tolist())

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, bounds of its ids) of every row, rows in the order in which the index gives them for ascending keys."""
        nulls, n = self.head["null_rows"], self.head["rows"]
        keys, ends = self._part("row_key", "<i8", 0, n), self._part("row_end", "<u8", 0, n + 1).astype(np.int64)
        seeds, slots = self._part("seeds", "<i4", 0, self.head["buckets"]), self._part("slots", SLOT, 0, self.head["keys"])
        uniq, count = np.unique(keys[nulls:], return_counts=True)
        if len(uniq):
            at, f = find_slots(uniq, seeds, len(slots))
            found = slots[at]
            good = (found["fingerprint"] == f) & (found["rows"] == count) & (found["first"] == nulls + bounds(count)[:-1])
            if not good.all():
                raise ValueError("the index doesn't give its rows")
        return keys, ends

    def checksums(self, ends: np.ndarray) -> np.ndarray:
        """crc32 of the ids of each row as little-endian 32-bit numbers, in reads of READ_BYTES or one row."""
        out, row, per = np.zeros(len(ends) - 1, np.int64), 0, READ_BYTES // self.dtype.itemsize
        while row < len(out):
            upto = max(row + 1, int(np.searchsorted(ends, ends[row] + per, side="right")) - 1)
            raw = memoryview(self.ids(int(ends[row]), int(ends[upto])).astype("<u4").tobytes())
            at = (4 * (ends[row : upto + 1] - ends[row])).tolist()
            out[row:upto] = [zlib.crc32(raw[p:q]) for p, q in zip(at[:-1], at[1:])]
            row = upto
        return out


# --------------------------------------------------------------------------- operators
_WHITE_BYTE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])


def pieces_of(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces begin of texts laid end to end (`starts`: where each text begins). A token never goes on from a character
    into white space, so a text is cut before each run of white space, after a single white character that is no space, and
    before a mark after a letter. Runs with white space beyond ASCII before or after them are left alone."""
    n = len(raw)
    white = _WHITE_BYTE[raw]
    cut = white.copy()
    cut[1:] &= ~white[: n - 1]
    at = np.flatnonzero(cut)
    at = at[at > 0]
    odd = at[raw[at - 1] >= 0x80]
    odd = odd[odd >= 2]
    z, y, x = raw[odd - 1], raw[odd - 2], raw[np.maximum(odd - 3, 0)]
    wide = (y == 0xC2) & ((z == 0x85) | (z == 0xA0)) | (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)) | (x == 0xE2) & (y == 0x81) & (z == 0x9F) | (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
    cut[odd[wide]] = False
    first = np.zeros(n, bool)
    first[starts] = True
    lone = np.flatnonzero(white[: n - 1] & (cut | first)[: n - 1] & (raw[: n - 1] != 32)) + 1
    cut[lone[~white[lone] & ((raw[lone] < 0x80) | (raw[lone] == 0xC3))]] = True
    cut[mark_cuts(raw)] = True  # at the first place of a text there is a cut anyhow
    cut |= first
    return np.flatnonzero(cut)


class Encoder:
    """Ids of one worker's texts: every distinct piece is encoded once. Plain words, with the space before them, are one
    pre-token and go to the library's BPE model; any other piece goes through its whole pipeline."""

    def __init__(self, path: str, special: bool = True) -> None:
        """special: strings of special tokens inside texts are those tokens; else they are plain text."""
        tok = load_tokenizer(path)
        tok.encode_special_tokens = not special
        self.vocab = tok.get_vocab_size(with_added_tokens=True)
        model, written = tok.model, {chr(b): c for b, c in byte_characters().items()}
        plain, table, space = re.compile(f" ?[{LATIN}]+").fullmatch, str.maketrans(written), written[" "]

        def encode(pieces: list[bytes]) -> list[list[int]]:
            texts = [p.decode() for p in pieces]
            out: list = [None] * len(texts)
            for i, x in enumerate(texts):
                if plain(x):
                    out[i] = [t.id for t in model.tokenize(x.replace(" ", space) if x.isascii() else pieces[i].decode("latin-1").translate(table))]
            rest = [i for i, ids in enumerate(out) if ids is None]
            for i, e in zip(rest, tok.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
                out[i] = e.ids
            return out

        self.table = TokenTable(encode)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, bounds of each text's ids)."""
        raw, at = b"".join(texts), bounds([len(t) for t in texts])
        if not raw:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        begin = pieces_of(np.frombuffer(raw, np.uint8), at[:-1][at[:-1] < len(raw)])
        ids, n, _ = self.table(raw, begin, np.append(begin[1:], len(raw)))
        return ids, bounds(n)[np.searchsorted(begin, at)]


#: Characters of a text that its place among rows of one doc_id depends on when rows are dealt to shards.
DEALT_CHARS = 32


def write_store(docs: DataFrame, root: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the shards of docs(doc_id, text) below root; returns the manifest (shard, rows, ids, null_rows, lo, hi), one row a
    file: lo and hi are its least and greatest key."""
    spark, path = docs.sparkSession, path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ctx = None, TaskContext.get()
        keys, counts, payload, nulls = [], [], [], 0
        for b in batches:
            encoder = encoder or worker_object(("byte-bpe", path), lambda: Encoder(path))
            nulls += b.column(0).null_count
            keys.append(b.column(0).fill_null(NULL_KEY).to_numpy(zero_copy_only=False).astype(np.int64))
            for _, texts in text_blocks(b):
                ids, at = encoder.encode(texts)
                ids = np.insert(ids, at[1:], end_id)
                counts.append(np.diff(at) + 1)
                payload.append(ids.astype(np.uint16 if encoder.vocab <= 1 << 16 else np.uint32))
        if not keys:
            return
        k, n = np.concatenate(keys), np.concatenate(counts)
        write_shard(root, ctx.partitionId(), k, n, payload, nulls, encoder.vocab, ctx.taskAttemptId())
        ends = [int(k[nulls]), int(k[-1])] if nulls < len(k) else [None, None]
        yield pa.RecordBatch.from_pylist([dict(zip(MANIFEST.names, [ctx.partitionId(), len(k), int(n.sum()), nulls, *ends]))], MANIFEST)

    # rows of one doc_id, or of none, may be many: they are dealt on by their texts
    dealt = docs.select("doc_id", "text").repartitionByRange(fanout(spark, docs), F.col("doc_id"), F.substring("text", 1, DEALT_CHARS)).sortWithinPartitions("doc_id", "text")
    return map_arrow(dealt, run, "shard int, rows long, ids long, null_rows long, lo long, hi long")


MANIFEST = pa.schema([("shard", pa.int32()), ("rows", pa.int64()), ("ids", pa.int64()), ("null_rows", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def read_store(spark: SparkSession, root: str, manifest: list[tuple]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored row, each told by its shard's index."""
    manifest = sorted(manifest, key=lambda m: m[0])
    starts, shards = bounds([m[2] for m in manifest])[:-1].tolist(), [m[0] for m in manifest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                shard = Shard(root, shards[k])
                keys, ends = shard.whole()
                named = pa.array(keys, mask=np.arange(len(keys)) < shard.head["null_rows"])
                yield pa.RecordBatch.from_arrays([named, pa.array(starts[k] + ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(shard.checksums(ends), pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(spark.range(0, len(shards), 1, max(1, len(shards))), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


class Store:
    """Keyed access from anywhere that reaches the store: the shards that may hold a key are known by their key bounds."""

    def __init__(self, root: str, manifest: list[tuple]) -> None:
        self.root = root
        self.nulls = [m[0] for m in manifest if m[3]]
        keyed = sorted((m[4], m[5], m[0]) for m in manifest if m[4] is not None)
        self.lo, self.hi, self.shard = ([m[k] for m in keyed] for k in range(3))

    def shards(self, key: int | None) -> list[int]:
        if key is None:
            return self.nulls
        return self.shard[bisect.bisect_left(self.hi, key) : bisect.bisect_right(self.lo, key)]

    def get(self, key: int | None) -> list[np.ndarray]:
        """Ids of each row of the key."""
        return [x for s in self.shards(key) for x in Shard(self.root, s).get(key)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "token-store")
    with small_batches(spark):
        manifest = [tuple(r) for r in write_store(documents(spark, sf_dir), root).collect()]  # one row a file
    return read_store(spark, root, manifest)
