"""Media columns in Matroska: texts stored as sound, and media parsed into packet tables.

media() writes each payload as one uncompressed 8-bit track into a Matroska file: header, seek head, info, tracks, clusters of
laced blocks, cues. parse() reads any Matroska file: variable-length EBML numbers, elements of unknown size, void and checksum
elements, simple blocks and block groups, all four kinds of lacing, cues, several tracks. packets() gives a row for each frame
with its track, timestamp and byte range; the frames themselves stay in the column and are cut out of it by their ranges. Every
row is written and read where it lies, so nothing is shuffled.

Null and empty texts are a payload of padding alone; equal texts give equal files; repeated rows and extra columns are carried
through, and own columns named like a result give way; a very long text is one file of many clusters (relative timestamps are
16 bits, so a cluster ends well before they do); an empty table gives an empty result. Null media have no packets. Media that
end or go wrong in the middle give the packets before that place, and `damage` tells the place.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import blocks, documents, map_arrow, text_blocks

#: Samples of a frame: 12 ms at RATE. Payloads are padded to whole frames with PAD.
FRAME, RATE, PAD = 576, 48_000, 255
FRAME_MS = FRAME * 1000 // RATE
LACED, BLOCKS_IN_CLUSTER = 8, 16

# Element ids of EBML and Matroska (RFC 8794, RFC 9559).
EBML, EBML_VERSION, EBML_READ, MAX_ID, MAX_SIZE, DOCTYPE, DOCTYPE_VERSION, DOCTYPE_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, SEEK_HEAD, SEEK, SEEK_ID, SEEK_POSITION = 0x18538067, 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC
INFO, SCALE, DURATION, MUXER, WRITER = 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, NUMBER, UID, KIND, LACING, DEFAULT_DURATION, CODEC, AUDIO, SAMPLING, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x23E383, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TAGS, CHAPTERS, ATTACHMENTS = 0x1254C367, 0x1043A770, 0x1941A469
#: What ends a segment, or a cluster, of unknown size.
TOP = {EBML, SEGMENT}
LEVEL_1 = TOP | {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS}
LACINGS = ("none", "xiph", "fixed", "ebml")


# --------------------------------------------------------------------------- writing
def vint(n: int, width: int = 0) -> bytes:
    """A variable-length number: as many leading zeros as bytes follow the first; all ones means unknown, so it isn't used."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def uint(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def element(kind: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return uint(kind) + vint(len(body)) + body


def laced(sizes: list[int], lacing: str) -> bytes:
    """The sizes of a block's frames, the last one's left out: their count less one, then nothing, sums of 255s, or differences."""
    out = bytes([len(sizes) - 1])
    if lacing == "xiph":
        return out + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if lacing == "ebml" and len(sizes) > 1:
        out += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            out += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return out


def simple_block(track: int, at: int, frames: list[bytes], lacing: str = "") -> bytes:
    """Frames of one track, `at` milliseconds after the cluster begins."""
    sizes = [len(f) for f in frames]
    lacing = lacing or ("none" if len(frames) == 1 else "fixed" if len({*sizes}) == 1 else "ebml")
    flags = 0x80 | LACINGS.index(lacing) << 1
    return vint(track) + struct.pack(">hB", at, flags) + (laced(sizes, lacing) if lacing != "none" else b"") + b"".join(frames)


_HEAD = element(EBML, *(element(k, uint(v)) for k, v in ((EBML_VERSION, 1), (EBML_READ, 1), (MAX_ID, 4), (MAX_SIZE, 8))), element(DOCTYPE, b"matroska"), element(DOCTYPE_VERSION, uint(4)), element(DOCTYPE_READ, uint(2)))
_TRACKS = element(TRACKS, element(TRACK, element(NUMBER, uint(1)), element(UID, uint(1)), element(KIND, uint(2)), element(LACING, uint(1)), element(DEFAULT_DURATION, uint(FRAME_MS * 1_000_000)), element(CODEC, b"A_PCM/INT/LIT"), element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)), element(CHANNELS, uint(1)), element(DEPTH, uint(8)))))


def padded(raw: bytes) -> bytes:
    """raw with PAD up to a positive multiple of FRAME."""
    return raw + bytes([PAD]) * (FRAME - len(raw) if not raw else -len(raw) % FRAME)


def write(payload: bytes, lacing: str = "") -> bytes:
    """A Matroska file of one 8-bit track that holds `payload` in frames of FRAME bytes."""
    frames = [payload[k : k + FRAME] for k in range(0, len(payload), FRAME)]
    info = element(INFO, element(SCALE, uint(1_000_000)), element(DURATION, struct.pack(">d", len(frames) * FRAME_MS)), element(MUXER, b"quillspark"), element(WRITER, b"quillspark"))
    per = LACED * BLOCKS_IN_CLUSTER
    clusters, starts = [], []
    for first in range(0, len(frames), per):
        starts.append(first * FRAME_MS)
        laid = range(first, min(first + per, len(frames)), LACED)
        clusters.append(element(CLUSTER, element(TIMESTAMP, uint(first * FRAME_MS)), *(element(SIMPLE_BLOCK, simple_block(1, (k - first) * FRAME_MS, frames[k : min(k + LACED, first + per)], lacing)) for k in laid)))
    # positions are counted from the segment's first byte; the seek head's own are of fixed width, so that its size is known
    seek = lambda *at: element(SEEK_HEAD, *(element(SEEK, element(SEEK_ID, uint(k)), element(SEEK_POSITION, p.to_bytes(8, "big"))) for k, p in zip((INFO, TRACKS, CUES), at)))
    lead = len(seek(0, 0, 0))
    at = [lead + len(info) + len(_TRACKS)]
    for c in clusters:
        at.append(at[-1] + len(c))
    cues = element(CUES, *(element(CUE, element(CUE_TIME, uint(t)), element(CUE_POSITIONS, element(CUE_TRACK, uint(1)), element(CUE_CLUSTER, uint(p)))) for t, p in zip(starts, at)))
    return _HEAD + element(SEGMENT, seek(lead, lead + len(info), at[-1]), info, _TRACKS, *clusters, cues)


# --------------------------------------------------------------------------- reading
class Damage(ValueError):
    """The file ends or goes wrong here."""


def read_vint(raw: bytes, at: int, end: int, keep_mark: bool = False) -> tuple[int, int]:
    """(value, place after it); -1 for the value that means unknown."""
    if at >= end or not raw[at]:
        raise Damage(at)
    width = 9 - raw[at].bit_length()
    if at + width > end:
        raise Damage(at)
    n = int.from_bytes(raw[at : at + width], "big")
    if keep_mark:
        return n, at + width
    n ^= 1 << 7 * width
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def elements(raw: bytes, at: int, end: int, ends: set[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, place, begin and end of the data) of the elements in raw[at:end]; `ends`: ids that end a parent of unknown size.
    An element of unknown size is given the parent's end."""
    while at < end:
        place = at
        kind, at = read_vint(raw, at, end, keep_mark=True)
        if kind in ends:
            return
        size, at = read_vint(raw, at, end)
        if size >= 0 and at + size > end:
            yield kind, place, at, end  # what is there of it
            raise Damage(place)
        yield kind, place, at, end if size < 0 else at + size
        if size < 0:
            at = _end_of_unknown(raw, kind, at, end)
        else:
            at += size


def _end_of_unknown(raw: bytes, kind: int, at: int, end: int) -> int:
    stops = TOP if kind == SEGMENT else LEVEL_1
    while at < end:
        inner, data = read_vint(raw, at, end, keep_mark=True)
        if inner in stops:
            return at
        size, data = read_vint(raw, data, end)
        at = _end_of_unknown(raw, inner, data, end) if size < 0 else data + size
    return min(at, end)


def _uint(raw: bytes, p: int, q: int) -> int:
    return int.from_bytes(raw[p:q], "big")


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp ns, duration ns or None, offset, size, key frame, lacing, cluster's place)."""

    scale: int = 1_000_000
    duration: float | None = None
    segment: int = 0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)
    clusters: list[tuple[int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    damage: int | None = None


_TRACK_FIELDS = {NUMBER: "number", KIND: "kind", DEFAULT_DURATION: "frame_ns", CHANNELS: "channels", DEPTH: "depth"}


def _track(raw: bytes, p: int, q: int, into: dict) -> dict:
    for kind, _, a, b in elements(raw, p, q):
        if kind in _TRACK_FIELDS:
            into[_TRACK_FIELDS[kind]] = _uint(raw, a, b)
        elif kind == CODEC:
            into["codec"] = raw[a:b].rstrip(b"\0").decode("ascii", "replace")
        elif kind == SAMPLING and b - a in (4, 8):
            into["rate"] = struct.unpack(">f" if b - a == 4 else ">d", raw[a:b])[0]
        elif kind == AUDIO:
            _track(raw, a, b, into)
    return into


def frame_sizes(raw: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """(sizes of a block's frames, place of the first)."""
    if not lacing:
        return [end - at], at
    if at >= end:
        raise Damage(at)
    n, at = raw[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % n:
            raise Damage(at)
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if lacing == 1:
            size = 0
            while True:
                if at >= end:
                    raise Damage(at)
                size, at = size + raw[at], at + 1
                if raw[at - 1] < 255:
                    break
        else:
            start = at
            size, at = read_vint(raw, at, end)
            if k:
                size += sizes[-1] - ((1 << 7 * (at - start) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damage(at)
    return sizes, at


def _block(out: Media, raw: bytes, p: int, q: int, cluster: tuple[int, int], key: bool | None, lasts: int | None) -> None:
    """A block's frames; `key` is None where the block's own flag tells."""
    track, at = read_vint(raw, p, q)
    if at + 3 > q:
        raise Damage(p)
    when, flags = struct.unpack_from(">hB", raw, at)
    sizes, at = frame_sizes(raw, at + 3, q, flags >> 1 & 3)
    step = out.tracks.get(track, {}).get("frame_ns") or (lasts * out.scale // len(sizes) if lasts else None)
    start = (cluster[0] + when) * out.scale
    for k, n in enumerate(sizes):
        out.packets.append((track, start + k * (step or 0), step, at, n, bool(flags & 0x80) if key is None else key, LACINGS[flags >> 1 & 3], cluster[1]))
        at += n


def _cluster(out: Media, raw: bytes, place: int, p: int, q: int) -> None:
    when = (0, place)
    out.clusters.append(when)
    for kind, _, a, b in elements(raw, p, q, LEVEL_1):
        if kind == TIMESTAMP:
            out.clusters[-1] = when = (_uint(raw, a, b), place)
        elif kind == SIMPLE_BLOCK:
            _block(out, raw, a, b, when, None, None)
        elif kind == GROUP:
            body, lasts, key = None, None, True
            for k, _, c, d in elements(raw, a, b):
                if k == BLOCK:
                    body = c, d
                elif k == BLOCK_DURATION:
                    lasts = _uint(raw, c, d)
                elif k == REFERENCE:
                    key = False
            if body:
                _block(out, raw, *body, when, key, lasts)


def _cues(out: Media, raw: bytes, p: int, q: int) -> None:
    for cue, _, a, b in elements(raw, p, q):
        when, found = 0, []
        for kind, _, c, d in elements(raw, a, b) if cue == CUE else ():
            if kind == CUE_TIME:
                when = _uint(raw, c, d)
            elif kind == CUE_POSITIONS:
                at = {k: _uint(raw, x, y) for k, _, x, y in elements(raw, c, d)}
                found.append((at.get(CUE_TRACK, 0), at.get(CUE_CLUSTER, 0)))
        out.cues += [(when * out.scale, track, out.segment + place) for track, place in found]


def _info(out: Media, raw: bytes, p: int, q: int) -> None:
    for kind, _, a, b in elements(raw, p, q):
        if kind == SCALE:
            out.scale = _uint(raw, a, b)
        elif kind == DURATION and b - a in (4, 8):
            out.duration = struct.unpack(">f" if b - a == 4 else ">d", raw[a:b])[0]


def _tracks(out: Media, raw: bytes, p: int, q: int) -> None:
    for kind, _, a, b in elements(raw, p, q):
        if kind == TRACK:
            track = _track(raw, a, b, {})
            out.tracks[track.get("number", 0)] = track


_TABLES = {INFO: _info, TRACKS: _tracks, CUES: _cues}


def _read(raw: bytes, clusters: bool) -> Media:
    out = Media()
    try:
        if raw[:4] != uint(EBML):
            raise Damage(0)
        for kind, _, p, q in elements(raw, 0, len(raw)):
            if kind != SEGMENT:
                continue
            out.segment = p
            for k, place, a, b in elements(raw, p, q, TOP):
                if k in _TABLES:
                    _TABLES[k](out, raw, a, b)
                elif k == CLUSTER and clusters:
                    _cluster(out, raw, place, a, b)
        if not out.segment:
            raise Damage(len(raw))
    except Damage as e:
        out.damage = int(e.args[0])
    return out


def parse(raw: bytes) -> Media:
    """All of a file; where it is damaged, what comes before."""
    return _read(raw, clusters=True)


def seek(raw: bytes, ns: int, track: int = 1) -> list[tuple]:
    """A track's packets in the cluster that the cues name for a time; of the other clusters only their heads are read."""
    out = _read(raw, clusters=False)
    named = [(when, place) for when, t, place in out.cues if t == track and when <= ns]
    if named:
        kind, _, p, q = next(elements(raw, max(named)[1], len(raw)))
        if kind == CLUSTER:
            _cluster(out, raw, max(named)[1], p, q)
    return [x for x in out.packets if x[0] == track]


# --------------------------------------------------------------------------- operators
def media(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """docs with each text as a Matroska file in a binary column."""
    schema = T.StructType([*[f for f in docs.schema if f.name != out], T.StructField(out, T.BinaryType())])
    keep = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_blocks(b, text):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([write(padded(t)) for t in texts], pa.binary())], names=[*keep, out])

    return map_arrow(docs, run, schema)


def _files(b: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for i, j in blocks(pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()):
        part = b.slice(i, j - i)
        yield part, part.column(column).to_pylist()


PACKET = T.StructType([T.StructField("track", T.LongType()), T.StructField("timestamp_ns", T.LongType()), T.StructField("duration_ns", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("size", T.LongType()), T.StructField("key", T.BooleanType()), T.StructField("lacing", T.StringType()), T.StructField("cluster", T.LongType())])
_PACKET = pa.schema([("track", pa.int64()), ("timestamp_ns", pa.int64()), ("duration_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("key", pa.bool_()), ("lacing", pa.string()), ("cluster", pa.int64())])
#: Packets of one Arrow batch.
PACKET_ROWS = 10_000


def packets(df: DataFrame, keys: list[str], column: str = "media") -> DataFrame:
    """A row for each frame: the key columns, its number in the file (`packet`), its track, timestamp, duration (null: unknown), byte
    range, key-frame flag, lacing and its cluster's place. frame() cuts a frame out of the media."""
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("packet", T.LongType()), *PACKET.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, files in _files(b, column):
                for i, raw in enumerate(files):
                    found = parse(raw).packets if raw else []
                    for k in range(0, len(found), PACKET_ROWS):
                        rows = found[k : k + PACKET_ROWS]
                        own = part.slice(i, 1).take(pa.array([0] * len(rows)))
                        yield pa.RecordBatch.from_arrays([*(own.column(c) for c in keys), pa.array(range(k, k + len(rows)), pa.int64()), *(pa.array(x, t.type) for x, t in zip(zip(*rows), _PACKET))], names=schema.names)

    return map_arrow(df.select(*keys, column), run, schema)


def frame(column: str | Column = "media") -> Column:
    """The bytes of a packet, where packets() was joined to the media."""
    return F.substring(column, F.col("offset").cast("int") + 1, F.col("size").cast("int"))


FILE = "clusters long, tracks array<struct<number:long,kind:long,codec:string,rate:double,channels:long,depth:long,frame_ns:long>>, cues array<struct<timestamp_ns:long,track:long,cluster:long>>, duration_ns long, damage long"


def _arrow(rows: list[tuple], schema: pa.Schema) -> list[pa.Array]:
    return [pa.array(x, f.type) for x, f in zip(zip(*rows), schema)]


def files(df: DataFrame, keys: list[str], column: str = "media") -> DataFrame:
    """A row for each file: clusters, tracks, cues (times and places of clusters), duration and the place of damage, if any. Null media
    have no clusters, tracks or cues."""
    added = T._parse_datatype_string(FILE)
    schema, arrow = T.StructType([*[df.schema[k] for k in keys], *added.fields]), to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, raws in _files(b, column):
                rows = []
                for m in (parse(raw) if raw is not None else Media() for raw in raws):
                    tracks = [(n, t.get("kind"), t.get("codec"), t.get("rate"), t.get("channels"), t.get("depth"), t.get("frame_ns")) for n, t in sorted(m.tracks.items())]
                    rows.append((len(m.clusters), [dict(zip(("number", "kind", "codec", "rate", "channels", "depth", "frame_ns"), t)) for t in tracks], [dict(zip(("timestamp_ns", "track", "cluster"), c)) for c in m.cues], None if m.duration is None else round(m.duration * m.scale), m.damage))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), *_arrow(rows, arrow)], names=schema.names)

    return map_arrow(df.select(*keys, column), run, schema)


def payload_of(raw: bytes, found: Media, track: int = 1) -> bytes:
    """A track's frames end to end, in order of time."""
    own = sorted((x for x in found.packets if x[0] == track), key=lambda x: x[1])
    return b"".join(raw[x[3] : x[3] + x[4]] for x in own)


def feature(found: Media, payload: bytes) -> str:
    """What a file's tables and samples say: packets, clusters, cues that name a cluster of their time, milliseconds; least, greatest and
    summed sample, sum of steps between neighbours, crossings of the middle."""
    at = {place: when * found.scale for when, place in found.clusters}
    good = sum(at.get(place) == when for when, _, place in found.cues)
    ends = max((x[1] + (x[2] or 0) for x in found.packets), default=0)
    s = np.frombuffer(payload, np.uint8).astype(np.int16)
    steps, high = np.abs(np.diff(s)), s >= 128
    return f"packets={len(found.packets)};clusters={len(found.clusters)};cues={good};ms={ends // 1_000_000};min={s.min(initial=255)};max={s.max(initial=0)};sum={int(s.sum(dtype=np.int64))};steps={int(steps.sum(dtype=np.int64))};crossings={int((high[1:] != high[:-1]).sum())}"


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(df: DataFrame, keys: list[str], column: str = "media") -> DataFrame:
    """A row for each file: digests of the payload read back from its packets, and of the file. Null media have nulls."""
    added = T._parse_datatype_string(DIGEST)
    schema, arrow = T.StructType([*[df.schema[k] for k in keys], *added.fields]), to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, raws in _files(b, column):
                rows = []
                for raw in raws:
                    if raw is None:
                        rows.append((None,) * len(arrow))
                        continue
                    found = parse(raw)
                    back = payload_of(raw, found)
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(found, back)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), *_arrow(rows, arrow)], names=schema.names)

    return map_arrow(df.select(*keys, column), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return digests(media(docs).drop("text"), ["doc_id", "n_bytes"])
