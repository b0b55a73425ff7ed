"""Alignment of two tokenizers over the same texts, as a sweep of end events.

Every token ends at a byte; the ends of tokenizer A and of tokenizer B are the events of a document. Blocks of events of both
sides lie together by document, sorted by document, offset and side, and stream through a machine whose state is one open
group: where both sides end a group is closed, and between two ends that follow one another the token of A and the token of B
that are open there are linked. Blocks that come from two tables are united and dealt by document first (align()); those that
token_events() makes from the texts are already there, document by document, so nothing is shuffled. Counts of linked id pairs
are summed in each task and then over the corpus; the sums go back to the documents by lookup in each worker up to
MAX_PAIRS pairs, and by a join with hot pairs dealt to several tasks beyond that.

Null and empty texts, and texts whose tokens of either side don't join to their bytes (a U+2581 in the text, say), have no
tokens: zeros, and an empty string for the digest. Rows that repeat doc_id and text get equal rows; a null doc_id is a key like
any other; extra columns don't matter, only doc_id and text are read; a very long text goes through in blocks, and a single
group of its tokens is all that must fit in memory; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quality, token_store
from .bpe import byte_characters, load_tokenizer
from .common import TokenTable, bounds, documents, fanout, join_hot, map_arrow, open_folder, release, small_batches, text_blocks, text_key, worker_object, write_table

#: Tokens of one event block.
BLOCK_TOKENS = 1 << 16
#: Pending tokens of both sides from which closed groups are passed on while blocks still come.
FLUSH_TOKENS = 1 << 17
#: Distinct id pairs that a worker looks up in its own copy of the sums (16 bytes each).
MAX_PAIRS = 4_000_000
#: Distinct pairs and links that a task sums up before it merges them.
MERGE_PAIRS = 1_000_000
#: Slices of B ids, each of whose pairs are summed by one task.
SLICES = 256
#: A pair of more than a share of 1 in so many links is dealt to several tasks.
HOT_SHARE = 1000
#: U+2581, which stands for a space in pieces.
SPACE_PIECE = "▁"


# --------------------------------------------------------------------------- both tokenizers
class Vocabulary:
    """Bytes of each id's token."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.width = np.array([len(t) for t in tokens], np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.start = bounds(self.width)[:-1]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        width = self.width[ids]
        total = int(width.sum())
        return self.flat[np.arange(total) + np.repeat(self.start[ids] - (np.cumsum(width) - width), width)]


def vocabularies(path_a: str, path_b: str) -> tuple[Vocabulary, Vocabulary]:
    """Bytes of the tokens of a byte-level vocabulary and of one of pieces."""
    import sentencepiece

    tok, back = load_tokenizer(path_a), {c: b for b, c in byte_characters().items()}
    names = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size(with_added_tokens=True))]
    sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    a = Vocabulary([bytes(back[c] for c in x) if all(c in back for c in x) else x.encode() for x in names])
    return a, Vocabulary([bytes([int(x[1:-1], 16)]) if sp.is_byte(i) else x.replace(SPACE_PIECE, " ").encode() for i, x in enumerate(pieces)])


class PairEncoder:
    """Ids of both sides of one worker's texts, each text with a space before it; every distinct piece is encoded once a side."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = token_store.Encoder(path_a, special=False)
        self.bytes_a, self.bytes_b = vocabularies(path_a, path_b)
        sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        space = sp.piece_to_id(SPACE_PIECE)

        def encode(parts: list[bytes]) -> list[list[int]]:
            """Parts that begin with a space, which the library itself puts there, or with a line feed, before which it puts one too many."""
            found = sp.encode([(p[1:] if p[0] == 32 else p).decode() for p in parts], num_threads=1)
            return [[space] if p == b" " else ids if p[0] == 32 else ids[1:] for p, ids in zip(parts, found)]

        self.b = TokenTable(encode)

    def encode(self, texts: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], list[bool]]:
        """(ids and bounds of each text's) of A and of B, and whether the tokens of both sides join to space+text."""
        spaced = [b" " + t for t in texts]
        raw, at = b"".join(spaced), bounds([len(t) for t in spaced])
        a_ids, a_at = self.a.encode(spaced)
        begin = piece_cuts(np.frombuffer(raw, np.uint8), at[:-1])
        b_ids, n, _ = self.b(raw, begin, np.append(begin[1:], len(raw)))
        b_at = bounds(n)[np.searchsorted(begin, at)]
        whole = np.ones(len(texts), bool)
        for ids, first, vocabulary in ((a_ids, a_at, self.bytes_a), (b_ids, b_at, self.bytes_b)):
            if not np.array_equal(vocabulary.joined(ids), np.frombuffer(raw, np.uint8)):
                whole &= [vocabulary.joined(ids[p:q]).tobytes() == t for p, q, t in zip(first[:-1].tolist(), first[1:].tolist(), spaced)]
        return (a_ids, a_at), (b_ids, b_at), [bool(ok) and bool(t) for ok, t in zip(whole, texts)]


def piece_cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where side B's tokens always part: the texts' first bytes, a run of spaces after anything else than U+2581 (no piece
    has one in its middle), and line feeds (in no piece)."""
    before = np.concatenate([[0], raw[:-1]])
    cut = (raw == 32) & (before != 32) | (raw == 10)
    at = np.flatnonzero(cut & (raw == 32) & (before == 0x81))
    at = at[at >= 3]
    cut[at[(raw[at - 2] == 0x96) & (raw[at - 3] == 0xE2)]] = False
    cut[starts] = True
    return np.flatnonzero(cut)


EVENTS = "tkey long, side int, begin long, ids binary"
Widths = tuple[np.ndarray, np.ndarray]


def id_type(widths: Widths) -> str:
    """How blocks hold ids: two bytes each where both vocabularies allow it."""
    return "<u2" if max(map(len, widths)) <= 1 << 16 else "<u4"


def token_events(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Event blocks of docs(doc_id, text): side (0: A, 1: B), byte offset at which the block begins, ids of its tokens (see id_type), whose
    widths in bytes tell their ends. Both sides of a document lie in one partition. A document without tokens has one empty
    block."""
    path_a, path_b = path_a or token_store.default_path(), path_b or quality.default_path()
    key = docs.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            encoder = worker_object(("pair", path_a, path_b), lambda: PairEncoder(path_a, path_b))
            kind = id_type((encoder.bytes_a.width, encoder.bytes_b.width))
            for part, texts in text_blocks(b):
                sides, out = None, []
                *sides, good = encoder.encode(texts)
                for k, t in enumerate(texts):
                    tkey = text_key(t)
                    if not good[k]:
                        out.append((k, tkey, 0, 0, b""))
                        continue
                    for side, (ids, at) in enumerate(sides):
                        width = (encoder.bytes_b if side else encoder.bytes_a).width
                        begin, last = 0, int(at[k + 1])
                        for p in range(int(at[k]), last, BLOCK_TOKENS):
                            own = ids[p : min(p + BLOCK_TOKENS, last)]
                            out.append((k, tkey, side, begin, own.astype(kind).tobytes()))
                            begin += int(width[own].sum())
                row, *rest = zip(*out)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, t) for x, t in zip(rest, kinds))], names=["doc_id", "tkey", "side", "begin", "ids"])

    return map_arrow(docs.select("doc_id", "text"), run, T.StructType([key, *T._parse_datatype_string(EVENTS).fields]))


# --------------------------------------------------------------------------- the machine
class Groups:
    """What the machine passes on: whole groups of one document, in order. Ids and ends of both sides, and the ends that both have."""

    def __init__(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], shared: np.ndarray) -> None:
        self.a_ids, self.a_ends = a
        self.b_ids, self.b_ends = b
        self.shared = shared

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the token of A, number of the token of B, end) of each pair whose byte ranges overlap: one for every stretch
        between two ends that follow one another."""
        ends = np.union1d(self.a_ends, self.b_ends)
        return np.searchsorted(self.a_ends, ends), np.searchsorted(self.b_ends, ends), ends

    def laid_out(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(group of each token of A, of B, place of each token of A, of B) where the groups are written one after the other, A first."""
        ga, gb = np.searchsorted(self.shared, self.a_ends), np.searchsorted(self.shared, self.b_ends)
        return ga, gb, np.arange(len(ga)) + np.searchsorted(gb, ga), np.arange(len(gb)) + np.searchsorted(ga, gb, side="right")


class Machine:
    """Sweeps the event blocks of one document after the other. Its state: what follows the last end that both sides share."""

    def __init__(self) -> None:
        self.sides: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        self.ends, self.pending = [0, 0], 0

    def add(self, side: int, ids: np.ndarray, widths: np.ndarray) -> None:
        keep = widths > 0
        if not keep.all():
            ids, widths = ids[keep], widths[keep]
        if len(ids):
            ends = self.ends[side] + np.cumsum(widths, dtype=np.int64)
            self.sides[side].append((ids, ends))
            self.ends[side], self.pending = int(ends[-1]), self.pending + len(ids)

    def closed(self, upto: int | None = None) -> Groups | None:
        """The groups that end at `upto` or before, where all events up to there are in."""
        if not (self.sides[0] and self.sides[1]):
            return None
        (a_ids, a_ends), (b_ids, b_ends) = [tuple(map(np.concatenate, zip(*s))) if len(s) > 1 else s[0] for s in self.sides]
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
        if upto is not None:
            shared = shared[shared <= upto]
        if not len(shared):
            self.sides = [[(a_ids, a_ends)], [(b_ids, b_ends)]]
            return None
        na, nb = np.searchsorted(a_ends, shared[-1]) + 1, np.searchsorted(b_ends, shared[-1]) + 1
        self.sides = [[(a_ids[na:], a_ends[na:])] if na < len(a_ids) else [], [(b_ids[nb:], b_ends[nb:])] if nb < len(b_ids) else []]
        self.pending -= int(na + nb)
        return Groups((a_ids[:na], a_ends[:na]), (b_ids[:nb], b_ends[:nb]), shared)


def swept(batches: Iterable[pa.RecordBatch], widths: Widths) -> Iterator[tuple[tuple, Groups | None, int]]:
    """((doc_id, tkey), groups, 0) as they close, then (key, None, copies) at the document's end: how many rows repeat it. copies is
    negative where the two sides don't end together."""
    key = machine = None
    copies, last, kind = 0, None, id_type(widths)

    def finish() -> Iterator[tuple[tuple, Groups | None, int]]:
        if found := machine.closed():
            yield key, found, 0
        yield key, None, -copies if machine.pending else copies

    for b in batches:
        for doc, tkey, side, begin, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tkey", "side", "begin", "ids"))):
            if key != (doc, tkey) or machine is None:
                if machine is not None:
                    yield from finish()
                key, machine, copies, last = (doc, tkey), Machine(), 0, None
                first = (side, begin)
            copies += (side, begin) == first
            if (side, begin) == last:  # the block of a row that repeats this one
                continue
            last = (side, begin)
            if machine.pending > FLUSH_TOKENS and (found := machine.closed(begin)):
                yield key, found, 0
            own = np.frombuffer(ids, kind).astype(np.int64)
            machine.add(side, own, widths[side][own])
    if machine is not None:
        yield from finish()


def sorted_events(events: DataFrame, dealt: bool = True) -> DataFrame:
    """Event blocks of a document together and in order; dealt: by a shuffle, for blocks that come from several tables."""
    if dealt:
        events = events.repartition(fanout(events.sparkSession, events), "doc_id", "tkey")
    return events.sortWithinPartitions("doc_id", "tkey", "begin", "side")


def links(events: DataFrame, widths: Widths, dealt: bool = True) -> DataFrame:
    """A row for each linked pair of tokens: their numbers in the document, ids, and the byte range that both cover."""
    schema = T.StructType([events.schema["doc_id"], *T._parse_datatype_string("tkey long, a int, b int, a_id int, b_id int, begin long, end long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, before, held = [0, 0], 0, []
        for key, g, copies in swept(batches, widths):
            if g is None:
                if copies > 0:
                    yield from held * copies
                seen, before, held = [0, 0], 0, []
                continue
            a, b, ends = g.links()
            n = len(ends)
            columns = [[key[0]] * n, [key[1]] * n, a + seen[0], b + seen[1], g.a_ids[a], g.b_ids[b], np.concatenate([[before], ends[:-1]]), ends]
            held.append(pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, arrow.types)], names=schema.names))
            seen, before = [seen[0] + len(g.a_ids), seen[1] + len(g.b_ids)], int(ends[-1])

    arrow = _arrow_schema(schema)
    return map_arrow(sorted_events(events, dealt), run, schema)


def groups(events: DataFrame, widths: Widths, dealt: bool = True) -> DataFrame:
    """A row for each group: its number, ids of both sides, and byte range."""
    schema = T.StructType([events.schema["doc_id"], *T._parse_datatype_string("tkey long, number int, a_ids array<int>, b_ids array<int>, begin long, end long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, before, held = 0, 0, []
        for key, g, copies in swept(batches, widths):
            if g is None:
                if copies > 0:
                    yield from held * copies
                number, before, held = 0, 0, []
                continue
            n = len(g.shared)
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.searchsorted(ends, g.shared) + 1), pa.int32()), pa.array(ids, pa.int32())) for ids, ends in ((g.a_ids, g.a_ends), (g.b_ids, g.b_ends))]
            columns = [pa.array([key[0]] * n, arrow.types[0]), pa.array([key[1]] * n, pa.int64()), pa.array(np.arange(number, number + n), pa.int32()), *lists, pa.array(np.concatenate([[before], g.shared[:-1]]), pa.int64()), pa.array(g.shared, pa.int64())]
            held.append(pa.RecordBatch.from_arrays(columns, schema=arrow))
            number, before = number + n, int(g.shared[-1])

    arrow = _arrow_schema(schema)
    return map_arrow(sorted_events(events, dealt), run, schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


# --------------------------------------------------------------------------- digests
class Writer:
    """Decimal ids of groups, `a1,a2|b1;a3|b2`, without a Python object a token."""

    def __init__(self, size: int) -> None:
        n = np.arange(size)
        self.n = np.maximum(1, np.floor(np.log10(np.maximum(n, 1))).astype(np.int64) + 1)
        self.n += 10**self.n <= n
        wide = int(self.n.max(initial=1))
        self.digits = np.zeros((size, wide + 1), np.uint8)
        for k in range(wide):
            has = k < self.n
            self.digits[has, k] = 48 + n[has] // 10 ** (self.n[has] - 1 - k) % 10
        self.column = np.arange(wide + 1)

    def __call__(self, g: Groups) -> bytes:
        """The groups, each with the mark that ends it."""
        ga, gb, pa_, pb = g.laid_out()
        total = len(ga) + len(gb)
        ids, mark = np.empty(total, np.int64), np.full(total, 44, np.uint8)
        ids[pa_], ids[pb] = g.a_ids, g.b_ids
        mark[pa_[np.searchsorted(ga, np.arange(len(g.shared)), side="right") - 1]] = 124
        mark[pb[np.searchsorted(gb, np.arange(len(g.shared)), side="right") - 1]] = 59
        rows, n = self.digits[ids], self.n[ids]
        rows[np.arange(total), n] = mark
        return rows[self.column <= n[:, None]].tobytes()


def _merged(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(pairs) == 1:
        return pairs[0], counts[0]
    keys, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(counts), len(keys)).astype(np.int64)


ALIGNED = "tkey long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"


def alignments(events: DataFrame, widths: Widths, dealt: bool = True) -> DataFrame:
    """A row for each document: token, group and link counts, the digest of its groups, and its distinct linked id pairs (a * size of
    B + b, in order) with their numbers of links. widths: bytes of each id's token in the two vocabularies."""
    sizes = len(widths[0]), len(widths[1])
    schema = T.StructType([events.schema["doc_id"], *T._parse_datatype_string(ALIGNED).fields])
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = Writer(max(sizes))
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows))
            lists = [pa.ListArray.from_arrays(pa.array(bounds([len(x) for x in c]), pa.int32()), pa.array(np.concatenate(c), pa.int64())) for c in columns[-2:]]
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns[:-2], arrow.types)), *lists], schema=arrow)

        n, digest, pairs, counts = [0, 0, 0, 0], None, [], []
        for key, g, copies in swept(batches, widths):
            if g is not None:
                a, b, ends = g.links()
                k, c = np.unique(g.a_ids[a].astype(np.int64) * sizes[1] + g.b_ids[b], return_counts=True)
                pairs.append(k)
                counts.append(c)
                if sum(map(len, pairs)) > MERGE_PAIRS:
                    k, c = _merged(pairs, counts)
                    pairs, counts = [k], [c]
                text = written(g)
                if digest is None:
                    digest, text, tail = hashlib.sha256(), text, b""
                digest.update(tail + text[:-1])
                tail = text[-1:]
                n = [x + y for x, y in zip(n, (len(g.a_ids), len(g.b_ids), len(g.shared), len(ends)))]
                continue
            if copies < 0:
                n, digest, pairs, counts = [0, 0, 0, 0], None, [], []
            rows.append((*key, abs(copies), *n, digest.hexdigest() if digest else "", *_merged(pairs, counts)))
            held += len(rows[-1][-1]) + 10
            n, digest, pairs, counts = [0, 0, 0, 0], None, [], []
            if held > MERGE_PAIRS:
                yield out()
                rows.clear()
                held = 0
        if rows:
            yield out()

    return map_arrow(sorted_events(events, dealt), run, schema)


def align(a: DataFrame, b: DataFrame, widths: Widths) -> DataFrame:
    """alignments() of two tables of event blocks (doc_id, tkey, begin, ids), one for each tokenizer."""
    cut = lambda df, side: df.select("doc_id", "tkey", F.lit(side).alias("side"), "begin", "ids")
    return alignments(cut(a, 0).unionByName(cut(b, 1)), widths)


SUMS = "slice int, pairs array<long>, n array<long>"


def _packed(number: int, *values: np.ndarray) -> list[pa.Array]:
    return [pa.array([number], pa.int32()), *(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in values)]


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """A row for each slice of B ids: its pairs in order, n (links corpus-wide that hold each) and best (no pair of the same B id has
    more). Tasks pass on their own sums, an array for each slice; a slice's pairs are bounded by the vocabularies."""

    def told(pairs: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k, n = _merged(pairs, counts)
        number = k % size_b % SLICES
        order = np.argsort(number, kind="stable")
        first = np.searchsorted(number[order], np.arange(SLICES + 1)).tolist()
        for i, (p, q) in enumerate(zip(first[:-1], first[1:])):
            if q > p:
                yield pa.RecordBatch.from_arrays(_packed(i, k[order[p:q]], n[order[p:q]]), names=["slice", "pairs", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, held = [], [], 0
        for b in batches:
            lists, weight = b.column("pairs"), np.repeat(b.column("copies").to_numpy(), b.column("pairs").value_lengths().to_numpy())
            pairs.append(lists.flatten().to_numpy())
            counts.append(b.column("links").flatten().to_numpy() * weight)
            held += len(weight)
            if held > MERGE_PAIRS:
                k, c = _merged(pairs, counts)
                pairs, counts, held = [k], [c], 0
                if len(k) > MERGE_PAIRS:
                    yield from told(pairs, counts)
                    pairs, counts = [], []
        if pairs:
            yield from told(pairs, counts)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pairs, counts = None, [], []

        def out() -> pa.RecordBatch:
            k, n = _merged(pairs, counts)
            b = k % size_b
            most = np.zeros(size_b, np.int64)
            np.maximum.at(most, b, n)
            return pa.RecordBatch.from_arrays(_packed(at, k, n, n == most[b]), names=["slice", "pairs", "n", "best"])

        for b in batches:
            for i, number in enumerate(b.column("slice").to_pylist()):
                if number != at:
                    if pairs:
                        yield out()
                    at, pairs, counts = number, [], []
                pairs.append(b.column("pairs")[i].values.to_numpy())
                counts.append(b.column("n")[i].values.to_numpy())
                if len(pairs) > 64:
                    k, n = _merged(pairs, counts)
                    pairs, counts = [k], [n]
        if pairs:
            yield out()

    sums = map_arrow(aligned.select("copies", "pairs", "links"), summed, SUMS)
    return map_arrow(sums.repartition(SLICES, "slice").sortWithinPartitions("slice"), merged, SUMS + ", best array<boolean>")


class Lookup:
    """The sums of all pairs, in arrays."""

    def __init__(self, root: str) -> None:
        fs, folder = open_folder(root)
        table = pads.dataset(folder, filesystem=fs, format="parquet").to_table(columns=["pairs", "n", "best"])
        pair, n, best = (pc.list_flatten(table[c]).to_numpy() for c in ("pairs", "n", "best"))
        order = np.argsort(pair)
        self.pair, self.n, self.best = pair[order], n[order], best[order]


def _told(aligned: DataFrame, root: str) -> DataFrame:
    keep = [f for f in aligned.schema if f.name not in ("pairs", "links", "copies")]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = worker_object(("pairs", root), lambda: Lookup(root))
            at = np.searchsorted(known.pair, b.column("pairs").flatten().to_numpy())
            held, first = b.column("links").flatten().to_numpy(), bounds(b.column("pairs").value_lengths().to_numpy())
            best, total = (bounds(x)[first] for x in (held * known.best[at], held * known.n[at]))
            rows = pa.array(np.repeat(np.arange(b.num_rows), b.column("copies").to_numpy()))
            columns = [*(b.column(c) for c in names), pa.array(np.diff(best), pa.int64()), pa.array(np.diff(total), pa.int64())]
            yield pa.RecordBatch.from_arrays([c.take(rows) for c in columns], names=[*names, "n_best", "count_sum"])

    return map_arrow(aligned, run, T.StructType([*keep, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]))


def _joined(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join: pairs of a large share of all links are dealt to several tasks."""
    counts = counts.select(F.explode(F.arrays_zip("pairs", "n", "best")).alias("x")).select(F.col("x.pairs").alias("pair"), "x.n", "x.best")
    rows = aligned.withColumn("_row", F.monotonically_increasing_id())
    each = rows.select("_row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    total = counts.agg(F.sum("n").alias("total"))
    hot = counts.crossJoin(F.broadcast(total)).filter(F.col("n") * HOT_SHARE > F.col("total")).select("pair", F.ceil(F.col("n") * HOT_SHARE / F.col("total")).alias("parts"))
    sums = join_hot(each, counts, ["pair"], hot, ["_row"]).groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    out = rows.join(sums, "_row", "left").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.na.fill(0, ["n_best", "count_sum"]).drop("_row", "_copy", "pairs", "links", "copies")


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, tkey, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum."""
    spark = docs.sparkSession
    path_a, path_b = path_a or token_store.default_path(), path_b or quality.default_path()
    widths = tuple(v.width.astype(np.int32) for v in vocabularies(path_a, path_b))
    with small_batches(spark):
        aligned = write_table(spark, alignments(token_events(docs, path_a, path_b), widths, dealt=False), "aligned")
        counts = write_table(spark, pair_counts(aligned, len(widths[1])), "pairs")
    release(spark)
    n_pairs = counts.agg(F.sum(F.size("pairs"))).first()[0] or 0
    return _told(aligned, counts._quill_path) if n_pairs <= MAX_PAIRS else _joined(aligned, counts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(documents(spark, sf_dir)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
